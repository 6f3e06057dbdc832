"""Trie of conversation prefixes, merged family by family first.

Conversations are rebuilt from their family: ``conv_id`` c starts with turns of the family's base c - c % FAMILY and goes
on with its own. A node of the trie is a distinct sequence of first turns. The conversation of the smallest id that goes
through a node owns it; a conversation's own nodes are then one chain, from some depth down to its end, which hangs below
a node of another chain.

1. Turns become digests and byte counts where they are read; texts are not moved.
2. Families are cogrouped by base id: base first, each conversation in order of its turns. A stream over the sorted rows
   needs the base's first turns alone to rebuild the others, and combines what a family shares in a small trie.
3. Only the families' combined nodes are shuffled, and merged by the digest of their path.
4. Sums over subtrees need neither levels nor pairs of nodes: a chain's totals go to each chain above it once, at the
   depth where its path leaves that chain. A path meets no more chains than it has nodes, so these rows are no more than
   the rebuilt turns. Sums along a chain, in stretches of bounded depth, do the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import materialize, release

FAMILY = 5
#: A conversation takes fewer turns of its base than this.
HEADS = 9
#: Nodes of a family's trie held in memory; more are passed on in parts, which the merge by path adds up.
HELD_NODES = 20_000
#: Depths of a chain, and ids of a list, that one window or one text covers.
STRETCH = 4_096

_NODES = "path binary, depth long, bytes long, first long, n long, members array<long>, ends array<long>"


def base_of(conv_id: Column, family: int = FAMILY) -> Column:
    return conv_id - conv_id % family


def heads_of(conv_id: Column) -> Column:
    """How many of its base's turns a conversation starts with."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def turns(conversations: DataFrame, family: int = FAMILY) -> DataFrame:
    """(conv_id, base, turn, what, bytes, h) of every turn of a conversation with an id, its content as a digest."""
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    what = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    c = F.col("conv_id").cast("long")
    return conversations.where(c.isNotNull()).select(c.alias("conv_id"), base_of(c, family).alias("base"), F.col("turn"), what.alias("what"), F.octet_length(text).cast("long").alias("bytes"), heads_of(c).alias("h"))


class _Family:
    """The trie of one family as it is read: (path, depth) to bytes of the last text, members and ends."""

    def __init__(self, held: int):
        self.held, self.nodes, self.out = held, {}, {name: [] for name in ("path", "depth", "bytes", "first", "n", "members", "ends")}

    def step(self, path: bytes, depth: int, size: int, conv: int) -> None:
        node = self.nodes.get(path)
        if node is None:
            if len(self.nodes) >= self.held:
                self.pass_on()
            node = self.nodes[path] = (depth, size, [], [])
        node[2].append(conv)

    def end(self, path: bytes, conv: int) -> None:
        self.nodes[path][3].append(conv)

    def pass_on(self) -> None:
        for path, (depth, size, members, ends) in self.nodes.items():
            for name, value in zip(self.out, (path, depth, size, min(members), len(members), members, ends), strict=True):
                self.out[name].append(value)
        self.nodes = {}

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict(self.out, schema=schema)
        self.out = {name: [] for name in self.out}
        return out


def _family_tries(held: int):
    schema = pa.schema([("path", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, family, conv, heads, at = _Family(held), None, None, [], 0
        path, depth = b"", 0

        def add(what: bytes, size: int) -> None:
            nonlocal path, depth
            path, depth = hashlib.sha256(path + what).digest(), depth + 1
            trie.step(path, depth, size, conv)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "base", "what", "bytes", "h")]
            for c, base, what, size, h in zip(*columns, strict=True):
                if c != conv or base != family:
                    if conv is not None:
                        trie.end(path, conv)
                    if base != family:
                        trie.pass_on()
                        family, heads = base, []
                    conv, path, depth, at = c, b"", 0, 0
                    trie.step(path, 0, 0, c)
                    if c != base:
                        for head in heads[:h]:
                            add(*head)
                if c == base:
                    if len(heads) < HEADS:
                        heads.append((what, size))
                    add(what, size)
                elif at >= h:
                    add(what, size)
                at += 1
            if len(trie.out["path"]) > held:
                yield trie.batch(schema)
        if conv is not None:
            trie.end(path, conv)
        trie.pass_on()
        yield trie.batch(schema)

    return stream


def family_nodes(conversations: DataFrame, family: int = FAMILY, held: int = HELD_NODES) -> DataFrame:
    """Combined nodes of every family: path, depth, bytes of the last text, smallest member, members and those that end here.

    Turns go in order of ``turn``, null first, turns of equal numbers in order of their content's digest, rows alike as
    often as they stand.
    """
    own_base = F.col("conv_id") == F.col("base")
    rows = turns(conversations, family).repartition("base").sortWithinPartitions("base", own_base.desc(), "conv_id", F.col("turn").asc_nulls_first(), "what")
    return rows.select("conv_id", "base", "what", "bytes", "h").mapInArrow(_family_tries(held), _NODES)


def _chain_sums(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of each node summed over the node and all below it in its chain, stretch by stretch."""
    cell = F.expr(f"depth div {STRETCH}")
    nodes = nodes.withColumn("cell", cell)
    stretches = nodes.groupBy("conv_id", "cell").agg(*[F.sum(c).alias(f"{c}_all") for c in columns])
    below = Window.partitionBy("conv_id").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    after = stretches.select("conv_id", "cell", *[F.coalesce(F.sum(f"{c}_all").over(below), F.lit(0)).alias(f"{c}_after") for c in columns])
    within = Window.partitionBy("conv_id", "cell").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = nodes.withColumns({c: F.sum(c).over(within) for c in columns}).join(after, ["conv_id", "cell"])
    return summed.withColumns({c: F.col(c) + F.col(f"{c}_after") for c in columns}).drop("cell", *[f"{c}_after" for c in columns])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, depth, end) rows as texts of up to STRETCH ids of one node each."""
    owner, held = None, []

    def flush(out: list) -> None:
        if held:
            out.append((*owner, held[0], ",".join(map(str, held))))
            held.clear()

    for batch in batches:
        out: list = []
        for c, d, end in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if (c, d) != owner or len(held) >= STRETCH:
                flush(out)
                owner = (c, d)
            held.append(end)
        yield _batch(out, _PIECE)
    out = []
    flush(out)
    yield _batch(out, _PIECE)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts of each node as one digest; a node's texts pass by one after the other."""
    owner, running = None, None
    for batch in batches:
        out = []
        for c, d, _, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if (c, d) == owner:
                running.update(b"," + text.encode())
                continue
            if owner is not None:
                out.append((*owner, running.hexdigest()))
            owner, running = (c, d), hashlib.sha256(text.encode())
        yield _batch(out, _DIGEST)
    if owner is not None:
        yield _batch([(*owner, running.hexdigest())], _DIGEST)


_PIECE = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ids in ascending order, comma-joined, for (conv_id, depth, end) rows.

    A digest reads its ids one after the other, however many there are. Sorting them and writing them as text is split by
    ranges of ids; what passes through one task, as a stream, is a text for every STRETCH ids.
    """
    order = ["conv_id", "depth", "end"]
    cut = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "conv_id long, depth long, first long, ids string")
    return cut.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, family: int = FAMILY, held: int = HELD_NODES) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id take no part. Null roles and texts count as empty; a conversation whose own turns all fall away
    and whose base is absent ends at the root. Without conversations there is no node. A negative id's remainder has its
    sign, as in SQL. Very long texts are read as digests; extra columns are ignored.
    """
    parts = materialize(family_nodes(conversations, family, held), "family-nodes")
    merged = materialize(parts.groupBy("path").agg(F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes")), "nodes")
    owned = materialize(parts.select("path", "members", "ends").join(merged.select("path", "conv_id", "depth"), "path").drop("path"), "owned")
    runs = owned.select(F.explode("members").alias("of"), "conv_id", "depth").groupBy("of", "conv_id").agg(F.max("depth").alias("depth"))
    chains = merged.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    chains = materialize(chains.withColumnRenamed("conv_id", "of"), "chains")
    above = materialize(runs.where(F.col("of") != F.col("conv_id")).join(chains, "of"), "above")
    hung = above.where(F.col("depth") == F.col("top") - 1)
    children = hung.groupBy("conv_id", "depth").agg(F.count("*").alias("hung"))
    tails = chains.select(F.col("of").alias("conv_id"), F.col("bottom").alias("depth")).join(children, ["conv_id", "depth"], "left_anti").select(F.col("conv_id").alias("of"), F.lit(1).alias("leaf"))
    got = above.join(tails, "of", "left").groupBy("conv_id", "depth").agg(F.sum("saved").alias("got_saved"), F.sum(F.coalesce("leaf", F.lit(0))).alias("got_leaves"))
    own = merged.select("conv_id", "depth", "n_convs", "bytes").join(chains.select(F.col("of").alias("conv_id"), "top", "bottom"), "conv_id")
    own = own.join(hung.select(F.col("of").alias("conv_id"), F.col("conv_id").alias("hangs_below")), "conv_id", "left")
    own = own.join(children, ["conv_id", "depth"], "left").join(got, ["conv_id", "depth"], "left")
    n_children = F.coalesce("hung", F.lit(0)) + (F.col("depth") < F.col("bottom")).cast("long")
    nodes = own.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("hangs_below")).alias("parent_conv_id"), "n_convs", n_children.alias("n_children"),
        (F.coalesce("got_leaves", F.lit(0)) + (n_children == 0).cast("long")).alias("n_leaves"), (F.coalesce("got_saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    digests = id_digests(owned.select("conv_id", "depth", F.explode("ends").alias("end")))
    summed = _chain_sums(nodes, ["n_leaves", "saved_tokens"]).join(digests, ["conv_id", "depth"], "left")
    out = summed.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    out = materialize(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie")
    release(parts, merged, owned, chains, above)
    return out
