"""Merkle manifest of a dataset: a digest of all rows, and a proof for every row that can be checked without the others.

Rows are leaves. The leaves of a group, in order of their key, fold pairwise into the group's root, and the groups' roots,
in order of the groups, into the root of the dataset.

1. Every leaf gets its coordinate: its position among its group's leaves, and their number.
2. Blocks of 2 ** TIER consecutive nodes build TIER levels at once, and their tops are the nodes of the next tier. All
   nodes stand in materialised tables by (group, level, position).
3. A leaf's siblings of its own tier stand in its block. Those above are the same for all leaves of the block, whose node
   looks them up once, by coordinates alone: position and group size say which it needs. It explodes those of its own tier
   only, joins the node table and orders them, and takes the others from its block's node in turn. So a node is asked for
   by 2 ** (TIER - 1) rows at most, where a lookup of all levels by every leaf would ask for the uppermost nodes half as
   often as there are rows.
4. A row is verified by folding its digest with its siblings up to the root.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.ranks import ranked
from lodestone.llm.scratch import materialize, release

#: Levels that one block builds: blocks hold 2 ** TIER nodes.
TIER = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_STEPS = "array<struct<level:int,left:boolean,digest:string>>"


@dataclass
class Manifest:
    """``leaves`` has the columns of the input that were kept, group, idx, n and leaf; ``proofs`` these without n, subroot and steps; ``root`` is null for a dataset without rows."""

    leaves: DataFrame
    proofs: DataFrame
    root: str | None


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def row_digest(fields: list[Column]) -> Column:
    """Digest of a row's fields: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value, so that no two rows read alike."""
    shown = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown])


def group_key(value: Column) -> Column:
    """The group as text without nulls: null comes first, others in the order of their UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def depth(n: Column) -> Column:
    """Levels above n leaves: none above a lone one."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _above(nodes: Column) -> Column:
    """The nodes one level up: every two neighbours, and a last one alone."""
    last = F.floor((F.size(nodes) - 1) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def _tier(nodes: DataFrame, first: int, tier: int) -> DataFrame:
    """All nodes of the levels ``first`` + 1 to ``first`` + ``tier`` over the nodes of level ``first``, with the group's n."""
    step = F.expr(f"shiftright(idx, {tier})").alias("block")
    blocks = nodes.groupBy("group", "n", step).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("held")).withColumn("level0", F.col("held.digest"))
    for k in range(1, tier + 1):
        blocks = blocks.withColumn(f"level{k}", _above(F.col(f"level{k - 1}")))

    def placed(k: int) -> Column:
        return F.transform(f"level{k}", lambda d, i: F.struct(F.lit(first + k).alias("level"), (F.shiftleft("block", tier - k) + i).alias("idx"), d.alias("digest")))

    coordinates = [placed(k) for k in range(1, tier + 1)]
    return blocks.select("group", "n", F.inline(F.concat(*coordinates))).where(F.col("level") <= depth(F.col("n")))


def _tree(leaves: DataFrame, tier: int) -> tuple[list[DataFrame], int]:
    """Node tables of (group, n, level, idx, digest), the leaves' own first, and the number of tiers."""
    deepest = leaves.agg(F.max(depth(F.col("n")))).first()[0] or 0
    tiers = max(1, math.ceil(deepest / tier))
    levels = [leaves.select("group", "n", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"))]
    for t in range(tiers):
        below = levels[-1].where((F.col("level") == t * tier) & (depth(F.col("n")) > t * tier))
        levels.append(materialize(_tier(below, t * tier, tier), "nodes"))
    return levels, tiers


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(group, digest) of each group's uppermost node."""
    return reduce(DataFrame.unionByName, [x.where(F.col("level") == depth(F.col("n"))) for x in levels]).select("group", "digest")


def _within_blocks(leaves: DataFrame, held: DataFrame, tier: int, kept: list[str]) -> DataFrame:
    """(group, idx, leaf, kept columns, subroot, steps) of leaves; the siblings of their own tier stand in their block, and ``held`` has the steps above it."""
    step = F.expr(f"shiftright(idx, {tier})").alias("block")
    blocks = leaves.groupBy("group", step).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "leaf", *kept))).alias("held")).withColumn("level0", F.col("held.leaf"))
    for k in range(1, tier):
        blocks = blocks.withColumn(f"level{k}", _above(F.col(f"level{k - 1}")))
    rows = blocks.join(held, ["group", "block"]).select("group", "n", "subroot", "steps", *[f"level{k}" for k in range(tier)], F.posexplode("held").alias("place", "item"))

    def own(k: int) -> Column:
        at = F.shiftright("place", k)
        # a level that the whole group doesn't have gives no step; a last node has no sibling
        return F.when(depth(F.col("n")) > k, F.struct(F.lit(k).alias("level"), (at % 2 == 1).alias("left"), F.get(F.col(f"level{k}"), at.bitwiseXOR(F.lit(1))).alias("digest")))

    steps = F.concat(F.array_compact(F.array(*[own(k) for k in range(tier)])), F.col("steps"))
    return rows.select("group", *[F.col(f"item.{c}").alias(c) for c in ("idx", "leaf", *kept)], "subroot", steps.alias("steps"))


def _lookups(levels: list[DataFrame], tiers: int, tier: int, above: DataFrame, leaves: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``_within_blocks`` for all leaves, and the table behind them; ``above`` has a group's subroot, and its steps from there on."""
    parents = None
    for t in reversed(range(tiers)):
        low = t * tier
        items = levels[t].where((F.col("level") == low) & ((depth(F.col("n")) > low) | F.lit(t == 0))).select("group", "n", "idx")
        ended = above.join(items.where((F.col("idx") == 0) & (depth(F.col("n")) <= low + tier)), "group", "left_semi").select("group", F.lit(0).cast("long").alias("block"), "subroot", "steps")
        held = ended if parents is None else ended.unionByName(parents.withColumnRenamed("idx", "block"))
        if t == 0:
            break
        top = F.least(depth(F.col("n")), F.lit(low + tier))
        asked = items.where(top > low).select("group", "n", F.col("idx").alias("item"), F.explode(F.sequence(F.lit(low), top - 1)).alias("level"))
        place = F.expr(f"shiftright(item, level - {low})")
        count = F.expr("shiftright(n + shiftleft(1L, level) - 1, level)")
        asked = asked.withColumn("place", place).withColumn("idx", F.when(place.bitwiseXOR(F.lit(1)) < count, place.bitwiseXOR(F.lit(1))))
        nodes = levels[t].unionByName(levels[t + 1]).where((F.col("level") >= low) & (F.col("level") < low + tier)).select("group", "level", "idx", "digest")
        found = asked.join(nodes, ["group", "level", "idx"], "left")
        steps = found.groupBy("group", F.col("item").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("level", (F.col("place") % 2 == 1).alias("left"), "digest"))).alias("own"))
        whole = items.join(steps, ["group", "idx"], "left").withColumn("block", F.expr(f"shiftright(idx, {tier})")).join(held, ["group", "block"])
        own = F.coalesce(F.col("own"), F.expr(f"cast(array() as {_STEPS})"))
        whole = whole.select("group", "idx", "subroot", F.concat(own, F.col("steps")).alias("steps"))
        used, parents = parents, materialize(whole, "proofs")
        if used is not None:
            release(used)
    behind = materialize(held, "held")
    if parents is not None:
        release(parents)
    return _within_blocks(leaves, behind, tier, kept), behind


def build(rows: DataFrame, key: str, group: str, leaf: Column, kept: list[Column] = (), tier: int = TIER) -> Manifest:
    """Tree and proofs of ``rows``, whose leaves are the digests ``leaf``, in order of ``key`` within each ``group``.

    Null keys come first; rows that repeat a key are leaves of their own, in order of their digests, so the root depends
    on the rows alone, not on their order. A null group is a group. Without rows there is no root. Columns ``kept`` go along
    with the leaves under names of their own.
    """
    named = rows.select(group_key(F.col(f"`{group}`")).alias("group"), F.col(f"`{key}`").alias("key"), leaf.alias("leaf"), *kept)
    leaves = ranked(named, "group", ["key", "leaf"])
    levels, tiers = _tree(leaves, tier)
    subroots = ranked(_tops(levels).select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("digest").alias("leaf")), "group", ["name"])
    upper, more = _tree(subroots, tier)
    top = _tops(upper).first()
    ends = subroots.limit(1).select("group", F.lit(None).cast("string").alias("subroot"), F.expr(f"cast(array() as {_STEPS})").alias("steps"))
    outer, behind = _lookups(upper, more, tier, ends, subroots, [])
    above = materialize(subroots.select("idx", F.col("name").alias("group"), F.col("leaf").alias("subroot")).join(outer.select("idx", "steps"), "idx").drop("idx"), "groups")
    proofs, _ = _lookups(levels, tiers, tier, above, leaves, [c for c in leaves.columns if c not in ("group", "idx", "n", "leaf")])
    release(*levels[1:], *upper[1:], subroots, behind, above)
    return Manifest(leaves, proofs, top and top["digest"])


def siblings(steps: Column) -> Column:
    """The digests of a proof, from the leaf up to the root."""
    return F.transform(F.filter(steps, lambda s: s["digest"].isNotNull()), lambda s: s["digest"])


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.when(s["digest"].isNull(), at).when(s["left"], F.concat(s["digest"], at)).otherwise(F.concat(at, s["digest"])), 256))


def document_manifest(docs: DataFrame, tier: int = TIER) -> Manifest:
    """Manifest of a documents table by language; leaves keep doc_id and ``tampered``, the digest of a row whose n_chars one in seven had raised by 1."""
    fields = [F.col(f) for f in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = [F.when(hit, F.col(f) + 1).otherwise(F.col(f)) if f == "n_chars" else F.col(f) for f in FIELDS]
    return build(docs, "doc_id", "lang", row_digest(fields), [row_digest(changed).alias("tampered")], tier)


def audited(manifest: Manifest) -> DataFrame:
    """One row for each leaf: its own digest, its proof's, and the root that its tampered or else its own digest folds to."""
    root = F.lit(manifest.root).cast("string")
    rows = manifest.proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(F.array_join(siblings(F.col("steps")), ""), 256).alias("proof_sha256"), folded(F.col("tampered"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
