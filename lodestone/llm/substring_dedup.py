"""Repeated byte strings by a sorted array of sampled suffixes.

Of the suffixes of all texts only those are sorted whose first ``GRAM`` bytes have the smallest hash in some stretch of
``LENGTH`` bytes. Equal stretches pick the same suffix at the same offset, so every repeated stretch is a suffix that
sorts beside its twins, with equal bytes in front of it.

1. Of equal texts only the first goes on; the others are wholly repeats.
2. Suffixes whose first ``GRAM`` bytes stand at one place only need nothing more. The rest get their bytes on both sides.
3. Splitters, sampled with the number of buckets, range-partition them by their leading ``GRAM`` bytes. Suffixes that lead
   alike come to one bucket, and equal stretches lead alike, so comparing across such a boundary never finds more. Each
   bucket is sorted by multikey quicksort on 8-byte tokens; common lengths of neighbours cut it into runs of equal
   stretches at every offset.
4. Suffixes that lead alike more than ``ALIKE`` times, as those of boilerplate, would make a bucket of any size. Every one of
   their stretches is sorted as a suffix of its own, whole, then by id and position, so splitters can stand anywhere, also
   between equal ones; a bucket then compares its first stretch with the last one before it, across the boundary.
   Stretches that repeat inside a task's batch are settled there.
5. Of a run all but the first, by id and position, are removed; spans are joined back to their texts.

Texts are dealt by id once: the join with their wanted suffixes and the join with their spans are parts of one plan and
share that exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import materialize
from lodestone.llm.textarrays import groups, mix

LENGTH = 100
#: Bytes that a pick is known by. With 24 of them prose repeats by chance, the more the larger the corpus.
GRAM = 32
#: Positions among which a stretch picks, and bytes in front of its pick at most.
PICKS = LENGTH - GRAM + 1
REACH = LENGTH - GRAM
#: Suffixes that may lead alike in one bucket, records that a bucket holds on average, stretches that one of whole stretches
#: holds, and records that are sorted at once, more only where they lead alike. None of them changes results.
ALIKE, BUCKET_RECORDS, BUCKET_STRETCHES, SORTED_RECORDS = 100_000, 40_000, 200_000, 16_384
#: Leading bytes sampled for each bucket, and from one group of texts at most: what comes to the driver grows with the buckets alone.
SAMPLED_LEADS, GROUP_LEADS = 8, 64
#: Rows that multikey quicksort hands over to a plain sort.
FEW = 96
_WEIGHTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


def _tokens(raw: bytes) -> np.ndarray:
    """The big-endian 8-byte token from each position of ``raw``, which must not be shorter than that."""
    return np.ndarray((len(raw) - 7,), dtype=">u8", buffer=raw, strides=(1,)).astype(np.uint64)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from running minima of blocks in both directions."""
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


class Picked:
    """Suffixes that the stretches of some texts pick: place in the group, text, key and leading token, and the span of offsets picked at."""

    def __init__(self, texts: list[bytes | None]):
        self.raw = raw = b"".join(t or b"" for t in texts)
        sizes = np.fromiter((len(t or b"") for t in texts), dtype=np.int64, count=len(texts))
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        empty = np.zeros(0, dtype=np.int64)
        if len(raw) < LENGTH:
            self.at = self.text = self.least = self.most = empty
            self.key = empty.astype(np.uint64)
            self.lead = np.zeros(0, dtype=f"S{GRAM}")
            return
        token = _tokens(raw)
        n = len(raw) - GRAM + 1
        order = token[:n] * np.uint64(_WEIGHTS[0])
        for j in range(1, GRAM // 8):
            order += token[8 * j : 8 * j + n] * np.uint64(_WEIGHTS[j])
        order = mix(order)
        # equal hashes: the last place; texts share a group, so only differences of places count
        ranked = (order & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
        pick = (_LOW - (_sliding_min(ranked, PICKS) & _LOW)).astype(np.int64)
        new = np.flatnonzero(np.diff(pick, prepend=-1))
        # runs of stretches that pick one place, cut to those inside a text
        last = np.append(new[1:], len(pick)) - 1
        at = pick[new]
        text = np.searchsorted(self.stop, at, "right")
        low, high = np.maximum(new, self.start[text]), np.minimum(last, self.stop[text] - LENGTH)
        inside = low <= high
        self.at, self.text = at[inside], text[inside]
        self.most, self.least = self.at - low[inside], self.at - high[inside]
        self.key = order[self.at]
        # bytes that end in zeros compare as if they were cut there, alike on all sides
        self.lead = np.ascontiguousarray(np.stack([token[self.at + 8 * j] for j in range(GRAM // 8)], axis=1).astype(">u8")).view(f"S{GRAM}").ravel()

    @property
    def position(self) -> np.ndarray:
        return self.at - self.start[self.text]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place): each pick's first bytes, hashed, and a hash of text and position."""
    for batch in batches:
        digest = batch.column("d").to_numpy().view(np.uint64)
        for part, texts in groups(batch):
            p = Picked(texts)
            place = mix(mix(p.position.astype(np.uint64)) + digest[part][p.text])
            yield pa.record_batch([pa.array(p.key.view(np.int64)), pa.array(place.view(np.int64))], names=["key", "place"])


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, digest = batch.column("id").to_numpy(), batch.column("d").to_numpy()
        for part, texts in groups(batch):
            p = Picked(texts)
            yield pa.record_batch([pa.array(p.key.view(np.int64)), pa.array(ids[part][p.text]), pa.array(digest[part][p.text]), pa.array(p.position.astype(np.int32))], names=["key", "id", "d", "position"])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in groups(batch):
            lead = Picked(texts).lead
            thinned = lead[np.linspace(0, len(lead) - 1, min(GROUP_LEADS, len(lead))).astype(int)] if len(lead) else lead
            yield pa.record_batch([pa.array(thinned.tolist(), pa.binary())], names=["lead"])


def splitters(docs: DataFrame, buckets: int) -> np.ndarray:
    """Leading bytes at which buckets end, from a sample of texts that grows with the number of buckets alone."""
    total, wanted = docs.count(), SAMPLED_LEADS * buckets
    sample = docs.sample(min(1.0, wanted / max(1, total)), seed=7).mapInArrow(_leads, "lead binary").limit(2 * GROUP_LEADS * wanted)
    leads = np.sort(np.array(sample.toArrow().column("lead").to_pylist(), dtype=f"S{GRAM}"))
    return np.unique(leads[np.linspace(0, len(leads) - 1, buckets + 1).astype(int)[1:-1]]) if len(leads) else leads


def _record_rows(ends: np.ndarray):
    """The wanted picks of each text with their bytes on both sides, and their bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digest, all_wanted = batch.column("id").to_numpy(), batch.column("d").to_numpy(), batch.column("wanted")
            for part, texts in groups(batch):
                p = Picked(texts)
                position, bounds = p.position, np.searchsorted(p.text, np.arange(len(texts) + 1))
                keep = np.zeros(len(position), dtype=bool)
                for i, wanted in enumerate(all_wanted[part]):
                    own = slice(bounds[i], bounds[i + 1])
                    keep[own] = np.isin(position[own], wanted.values.to_numpy())
                at, least, most, text = p.at[keep], p.least[keep], p.most[keep], p.text[keep]
                body = [p.raw[a:b] for a, b in zip((at - most).tolist(), (at + LENGTH - least).tolist(), strict=True)]
                bucket = np.searchsorted(ends, p.lead[keep], "right").astype(np.int32)
                yield pa.record_batch([pa.array(bucket), pa.array(ids[part][text]), pa.array(digest[part][text]), pa.array(position[keep]), pa.array(least.astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(body, pa.binary())], names=["bucket", "id", "d", "position", "least", "most", "body"])

    return rows


_RECORD = "bucket int, id long, d long, position long, least int, most int, body binary"


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Rows of ``width`` bytes: ``size`` bytes from ``start`` in steps of 1 or -1, then zeros."""
    out = np.zeros((len(start), width), dtype=np.uint8)
    for at in range(0, len(start), 4096):
        part = slice(at, at + 4096)
        inside = np.arange(width)[None, :] < size[part, None]
        out[part][inside] = flat[(start[part, None] + step * np.arange(width)[None, :])[inside]]
    return out


def multikey_order(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lexicographic order of rows of tokens, then by size, by multikey quicksort.

    A stretch of rows that agree so far is parted in three at its median token: smaller and larger ones go on at the same
    depth, equal ones at the next token. Stretches of up to ``FEW`` rows are sorted by what is left of them at once.
    """
    order = np.arange(len(tokens))
    depths = tokens.shape[1]
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2:
            continue
        rows = order[low:high]
        if high - low <= FEW or depth == depths:
            order[low:high] = rows[np.lexsort((size[rows], *tokens[rows, depth:].T[::-1]))]
            continue
        token = tokens[rows, depth]
        pivot = np.partition(token, len(token) // 2)[len(token) // 2]
        less, more = token < pivot, token > pivot
        a, b = int(less.sum()), int(more.sum())
        order[low:high] = np.concatenate([rows[less], rows[~less & ~more], rows[more]])
        todo += [(low, low + a, depth), (low + a, high - b, depth + 1), (high - b, high, depth)]
    return order


def repeats(left: np.ndarray, right: np.ndarray, size: np.ndarray, least: np.ndarray, most: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """(records, REACH + 1) flags: the stretch with that many bytes in front also stands at a place of smaller rank.

    left holds the bytes in front, nearest first, and right those from the suffix on, ``size`` of them.
    """
    order = multikey_order(np.ascontiguousarray(right).view(">u8").astype(np.uint64), size)
    right, size, left, least, most, rank = right[order], size[order], left[order], least[order], most[order], rank[order]
    common = np.zeros(len(order), dtype=np.int64)
    differs = right[1:] != right[:-1]
    common[1:] = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), right.shape[1]), np.minimum(size[1:], size[:-1]))
    flags = np.zeros((len(order), REACH + 1), dtype=bool)
    ahead = np.zeros(len(order), dtype=np.uint64)
    for offset in range(REACH + 1):
        if offset:
            ahead = mix(ahead * np.uint64(3) + left[:, offset - 1] + np.uint64(1))
        run = np.cumsum(common < LENGTH - offset)
        valid = np.flatnonzero((least <= offset) & (offset <= most))
        if len(valid) < 2:
            continue
        r = run[valid]
        same = r[1:] == r[:-1]
        twin = np.append(same, False) | np.append(False, same)
        valid, r = valid[twin], r[twin]
        if len(valid) < 2:
            continue
        by = np.lexsort((rank[valid], ahead[valid], r))
        valid, r, h = valid[by], r[by], ahead[valid[by]]
        new = np.ones(len(valid), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        first = rank[valid[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        flags[valid, offset] = rank[valid] != first
    out = np.zeros_like(flags)
    out[order] = flags
    return out


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove, from one bucket of records."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    del held
    ids, digest, position, least, most = (table.column(c).to_numpy() for c in ("id", "d", "position", "least", "most"))
    body = table.column("body").chunk(0)
    offsets = np.frombuffer(body.buffers()[1], dtype=np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    flat = np.frombuffer(body.buffers()[2], dtype=np.uint8)
    by = np.lexsort((position, digest, ids))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (ids[by][1:] != ids[by][:-1]) | (digest[by][1:] != digest[by][:-1]) | (position[by][1:] != position[by][:-1])
    rank = np.zeros(len(by), dtype=np.int64)
    rank[by] = np.cumsum(new)
    start, size = offsets[:-1] + most, (LENGTH - least).astype(np.int64)
    lead = np.ascontiguousarray(_gathered(flat, start, np.full(len(start), GRAM), GRAM)).view(">u8").astype(np.uint64)
    order = multikey_order(lead, np.zeros(len(lead), dtype=np.int64))
    lead = lead[order]
    cuts = np.append(np.flatnonzero((lead[1:] != lead[:-1]).any(axis=1)) + 1, len(order))
    del lead, by, new
    at = 0
    while at < len(order):
        stop = int(cuts[min(np.searchsorted(cuts, at + SORTED_RECORDS), len(cuts) - 1)])
        rows = order[at:stop]
        left = _gathered(flat, start[rows] - 1, most[rows].astype(np.int64), REACH, -1)
        right = _gathered(flat, start[rows], size[rows], 8 * -(-LENGTH // 8))
        flags = repeats(left, right, size[rows], least[rows], most[rows], rank[rows])
        edge = np.diff(flags.astype(np.int8), prepend=0, append=0, axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        row = rows[row]
        yield pa.record_batch([pa.array(ids[row]), pa.array(digest[row]), pa.array(position[row] - high + 1), pa.array(position[row] - low + LENGTH)], names=["id", "d", "from", "to"])
        at = stop
    pa.default_memory_pool().release_unused()


def _order_of(body: np.ndarray, ids: np.ndarray, digest: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of stretches (rows of LENGTH bytes) by their bytes, then by id and position, and which of them open a run of equal ones."""
    by_place = np.lexsort((start, digest, ids))
    place = np.empty(len(ids), dtype=np.int64)
    place[by_place] = np.arange(len(ids))
    tokens = np.zeros((len(body), 8 * -(-LENGTH // 8)), dtype=np.uint8)
    tokens[:, :LENGTH] = body
    order = multikey_order(tokens.view(">u8").astype(np.uint64), place)
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = (body[order][1:] != body[order][:-1]).any(axis=1)
    return order, opens


_STRETCH = "body binary, id long, d long, from long, again boolean"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every stretch of records as a row; those that a batch holds before are known to repeat, and go on without their bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            least, most, position = (part.column(c).to_numpy().astype(np.int64) for c in ("least", "most", "position"))
            raw = part.column("body").to_pylist()
            size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
            origin = np.cumsum(size) - size
            n = most - least + 1
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            body = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(raw), dtype=np.uint8), LENGTH)[origin[row] + step]
            ids, digest = (part.column(c).to_numpy()[row] for c in ("id", "d"))
            start = position[row] - most[row] + step
            order, opens = _order_of(body, ids, digest, start)
            held = body[order][opens].tobytes()
            bodies = np.full(len(order), None, dtype=object)
            bodies[opens] = [held[i : i + LENGTH] for i in range(0, len(held), LENGTH)]
            yield pa.record_batch([pa.array(bodies, pa.binary()), pa.array(ids[order]), pa.array(digest[order]), pa.array(start[order]), pa.array(~opens)], names=["body", "id", "d", "from", "again"])


_RUN = "part int, edge boolean, first binary, last binary, id long, d long, from long, again boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket of whole stretches: each with whether it repeats one before it in the bucket, and the bucket's own first and last bytes.

    The rows that equal the bucket's first are marked as its edge: they may repeat one of the bucket before.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    part = TaskContext.get().partitionId()
    body = np.frombuffer(b"".join(table.column("body").to_pylist()), dtype=np.uint8).reshape(-1, LENGTH)
    ids, digest, start = (table.column(c).to_numpy() for c in ("id", "d", "from"))
    order, opens = _order_of(body, ids, digest, start)
    edge = np.cumsum(opens) == 1
    first, last = body[order[0]].tobytes(), body[order[-1]].tobytes()
    for at in range(0, len(order), 65_536):
        cut, n = order[at : at + 65_536], min(65_536, len(order) - at)
        ends = [pa.array([x if at == 0 else None] + [None] * (n - 1), pa.binary()) for x in (first, last)]
        yield pa.record_batch([pa.array(np.full(n, part, dtype=np.int32)), pa.array(edge[at : at + n]), *ends, pa.array(ids[cut]), pa.array(digest[cut]), pa.array(start[cut]), pa.array(~opens[at : at + n])], names=["part", "edge", "first", "last", "id", "d", "from", "again"])


def _repeated_stretches(records: DataFrame, count: int) -> DataFrame:
    """(id, d, from) of the stretches of records that stand before, from whole stretches in sorted buckets."""
    stretches = materialize(records.mapInArrow(_stretches, _STRETCH), "stretches")
    buckets = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * PICKS // BUCKET_STRETCHES))
    sorted_ = stretches.where("not again").select("body", "id", "d", "from").repartitionByRange(buckets, "body", "id", "d", "from")
    found = materialize(sorted_.mapInArrow(_runs, _RUN), "runs")
    # a row for each bucket: the run at its edge goes on from the last bucket before it whose last stretch is the same
    ends = found.where("first is not null").select("part", "first", "last")
    before = F.lag("last").over(Window.orderBy("part"))
    goes_on = ends.withColumn("goes_on", F.col("first").eqNullSafe(before)).where("goes_on").select("part", "goes_on")
    settled = found.join(goes_on, "part", "left").where("again or (edge and coalesce(goes_on, false))").select("id", "d", "from")
    return stretches.where("again").select("id", "d", "from").unionByName(settled)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for spans in batch.column("spans"):
            merged: list[list[int]] = []
            for a, b in sorted((s["from"], s["to"]) for s in spans.as_py()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            out.append([{"from": a, "to": b} for a, b in merged])
        yield pa.record_batch([batch.column("id"), batch.column("d"), pa.array(out, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], names=["id", "d", "spans"])


def _cut(keep: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_spans = batch.column("doc_id"), batch.column("spans")
            for part, texts in groups(batch):
                kept, sizes, count = [], [], []
                for raw, spans in zip(texts, all_spans[part].to_pylist(), strict=True):
                    at, parts = 0, []
                    for s in spans or []:
                        parts.append(raw[at : s["from"]])
                        at = s["to"]
                    parts.append(raw[at:])
                    kept.append(b"".join(parts))
                    sizes.append(len(raw))
                    count.append(len(spans or []))
                removed = [a - len(b) for a, b in zip(sizes, kept, strict=True)]
                columns = [ids[part], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.record_batch([*columns, pa.array(kept, pa.binary())], names=[*names, "kept"]) if keep else pa.record_batch(columns, names=names)

    return rows


def _removals(docs: DataFrame) -> DataFrame:
    """(id, d, spans) of the texts with spans to remove; docs has doc_id, id, d (a hash of the text) and text."""
    rows = docs.select("id", "d", F.md5("text").alias("content"), F.octet_length("text").cast("long").alias("size")).where(F.col("size") >= LENGTH)
    # of texts that stand in several rows alone, and written, so that the join deals both sides anew and can split a text of many copies
    firsts = materialize(rows.groupBy("content").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("content", "first"), "firsts")
    copies = materialize(rows.join(firsts, "content").where("id > first").select("id", "d", "size").distinct(), "copies")

    # written, so that the join below deals both sides anew and a key of many suffixes can be split over tasks
    places = docs.mapInArrow(_places, "key long, place long").groupBy("key").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("n"))
    repeated = materialize(places.where("low <> high").select("key", (F.col("n") > ALIKE).alias("alike")), "repeated")
    seeds = docs.mapInArrow(_seeds, "key long, id long, d long, position int").join(repeated, "key").join(copies, ["id", "d"], "left_anti")
    wanted = materialize(seeds.groupBy("id", "d", "alike").agg(F.sort_array(F.collect_set("position")).alias("wanted")), "seeds")

    sizes = {r.alike: r.n for r in wanted.groupBy("alike").agg(F.sum(F.size("wanted")).alias("n")).collect()}
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes.get(False, 0) // BUCKET_RECORDS))
    ends = splitters(docs, buckets)

    def records(alike: bool) -> DataFrame:
        side = wanted.where(F.col("alike") == alike).select("id", "d", "wanted")
        # all columns of docs, so that the exchange is the one that the last join reads
        return docs.join(side, ["id", "d"]).select("doc_id", "id", "d", "text", "wanted").mapInArrow(_record_rows(ends), _RECORD)

    spans = records(False).repartitionById(buckets, F.col("bucket")).mapInArrow(_bucket, "id long, d long, from long, to long")
    if True in sizes:
        again = _repeated_stretches(records(True), sizes[True])
        spans = spans.unionByName(again.select("id", "d", "from", (F.col("from") + LENGTH).alias("to")))
    found = spans.groupBy("id", "d").agg(F.collect_list(F.struct("from", "to")).alias("spans")).mapInArrow(_merged, "id long, d long, spans array<struct<from:bigint,to:bigint>>")
    whole = copies.select("id", "d", F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("size").alias("to"))).alias("spans"))
    return found.unionByName(whole)


def deduplicated(docs: DataFrame, keep: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and with ``keep`` the bytes that stay as ``kept``, for each row of (doc_id, text, ...).

    Removed is every byte in a stretch of LENGTH bytes that also starts earlier: at a smaller doc_id, or earlier in the
    text. Null texts are empty; texts below LENGTH bytes lose nothing. A null doc_id comes after all others; rows that
    repeat a doc_id and text are one document, and different texts of one doc_id follow one another by a hash. Very long
    texts are read whole, one at a time; no rows give no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.xxhash64("text").alias("d"), "text")
    rows = keyed.join(_removals(keyed), ["id", "d"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_cut(keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)
