"""Exact top-k search by inner product, by a three-phase uniform threshold.

A vector is cut into LISTS slices of neighbouring components; the inner product of a slice is its local score, and a score
is the sum of its local scores.

1. Every task gathers, for each query and slice, the entries of the k + 1 best local scores among its vectors. These
   entries' scores are scores of the table, so the (k + 1)-th best of a query is a cutoff that no result falls below.
2. The cutoff divided by the number of slices is sent to all tasks: a vector that reaches the cutoff has a local score
   that reaches this share. All entries that do are collected; the others' local scores are bounded by the share, and
   entries whose bound falls below the cutoff are left out.
3. Scores of what remains are resolved exactly, and the best k + 1 of each task are merged.

Vectors that are equal are one class with the k + 1 smallest of their ids, as no other id of them can be among the best;
queries that are equal are one search. k + 1, because a query's own row is taken out in the end. Queries go in blocks of
bounded size, each against all vectors, which stay where they are: entries never leave the task that holds their vector,
but for the best ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import materialize, release

K = 10
SCALE = 1024
EVERY = 100
#: Slices of a vector. More of them give smaller shares of the cutoff, so that more entries reach it.
LISTS = 2
#: Bytes of the queries that are sent to all tasks at once.
QUERY_BYTES = 8 << 20
#: Vectors of one task, and scores that it holds at a time.
TASK_VECTORS = 8_192
HELD_SCORES = 1 << 21

_NO_ID = np.iinfo(np.int64).max


def quantised(embedding: Column) -> Column:
    """floor(SCALE * x) of each component as a long, at most the largest long; null for vectors that are null or hold a null or non-finite component."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole, F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE)))


def _products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows with all queries, in the fastest type whose sums stay exact."""
    largest = vectors.shape[1] * max((abs(int(x)) for a in (vectors,) for x in (a.min(initial=0), a.max(initial=0))), default=0) * max((abs(int(x)) for x in (queries.min(initial=0), queries.max(initial=0))), default=0)
    for kind, most in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if largest < most:
            return vectors.astype(kind) @ queries.T.astype(kind)
    return vectors.astype(object) @ queries.T.astype(object)


class _Best:
    """The best ``most`` rows of each query, by score and then by smallest id, as entries come in."""

    def __init__(self, most: int):
        self.most, self.query, self.score, self.order, self.row = most, *[np.zeros(0, dtype=np.int64) for _ in range(4)]

    def add(self, query: np.ndarray, score: np.ndarray, order: np.ndarray, row: np.ndarray) -> None:
        query, score, order, row = (np.concatenate([a, b]) for a, b in ((self.query, query), (self.score, score), (self.order, order), (self.row, row)))
        by = np.lexsort((order, -score, query))
        starts = np.flatnonzero(np.diff(query[by], prepend=-1))
        rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
        by = by[rank < self.most]
        self.query, self.score, self.order, self.row = query[by], score[by], order[by], row[by]

    def floor(self, queries: int) -> np.ndarray:
        """The score that an entry must reach to be among the best, by query."""
        out = np.full(queries, -np.inf)
        full = np.flatnonzero(np.bincount(self.query, minlength=queries) >= self.most)
        out[full] = self.score[np.searchsorted(self.query, full, "right") - 1]
        return out


def _whole(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; those beyond the type are its ends."""
    if scores.dtype == object:
        info = np.iinfo(np.int64)
        return np.array([min(max(int(s), info.min), info.max) for s in scores], dtype=np.int64)
    return scores.astype(np.int64)


def _chunks(batch: pa.RecordBatch, dims: int, queries: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) of a batch, in parts whose scores fit; shorter vectors are filled up with zeros."""
    values = batch.column("x")
    lengths = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(lengths), dims), dtype=np.int64)
    matrix[np.arange(dims)[None, :] < lengths[:, None]] = flat
    rows = max(1, HELD_SCORES // max(1, queries))
    for at in range(0, len(matrix), rows):
        yield at, matrix[at : at + rows]


def _slices(dims: int, lists: int) -> list[slice]:
    edges = np.linspace(0, dims, lists + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _gather(sent, dims: int, lists: int, most: int):
    """Phase 1: scores of the entries that have the best local scores of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        local, seen, scores, before = [_Best(most) for _ in range(lists)], [], [], 0
        for batch in batches:
            for first, matrix in _chunks(batch, dims, len(queries)):
                parts = [_products(matrix[:, s], queries[:, s]) for s in _slices(dims, lists)]
                for best, part in zip(local, parts, strict=True):
                    least = best.floor(len(queries))
                    if len(part) > most:
                        least = np.maximum(least, np.partition(part, len(part) - most, axis=0)[len(part) - most].astype(np.float64))
                    row, query = np.nonzero(part >= least)
                    best.add(query, _whole(part[row, query]), before + first + row, np.zeros(len(row), dtype=np.int64))
                rows = np.unique(np.concatenate([b.order[b.order >= before + first] for b in local])) - before - first
                total = reduce(np.add, [p[rows] for p in parts])
                seen.append(rows + before + first)
                scores.append(total)
            before += len(batch)
        out = _Best(most)
        if seen:
            at = np.concatenate(seen)
            pairs = np.unique(np.concatenate([b.query * max(1, before) + b.order for b in local]))
            query, row = pairs // max(1, before), pairs % max(1, before)
            where = np.searchsorted(at, row)
            edges = np.cumsum([0, *[len(s) for s in seen]])
            which = np.searchsorted(edges, where, "right") - 1
            value = np.array([scores[c][w - edges[c], q] for c, w, q in zip(which, where, query, strict=True)], dtype=object if any(s.dtype == object for s in scores) else np.float64)
            out.add(query, _whole(value), row, row)
        yield pa.RecordBatch.from_pydict({"query": pa.array(out.query, pa.int64()), "score": pa.array(out.score, pa.int64())})

    return run


def _resolve(sent, cutoffs, keys, dims: int, lists: int, most: int):
    """Phases 2 and 3: entries that reach their share of the cutoff, bounded, then resolved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, cutoff = sent.value, cutoffs.value
        share = np.ceil(cutoff / lists)
        for batch in batches:
            best = _Best(most)
            ids = batch.column("ids")
            least_id = pa.compute.fill_null(pa.compute.list_element(ids, 0), _NO_ID).to_numpy(zero_copy_only=False) if len(batch) else np.zeros(0, dtype=np.int64)
            for first, matrix in _chunks(batch, dims, len(queries)):
                parts = [_products(matrix[:, s], queries[:, s]) for s in _slices(dims, lists)]
                row, query = np.nonzero(reduce(np.maximum, parts) >= share)
                entries = [p[row, query] for p in parts]
                bound = reduce(np.add, [np.maximum(e, share[query]) for e in entries])
                left = bound >= cutoff[query]
                row, query, total = row[left], query[left], reduce(np.add, [e[left] for e in entries])
                reached = total >= cutoff[query]
                row, query = row[reached], query[reached]
                best.add(query, _whole(total[reached]), least_id[first + row], first + row)
            held = pa.array(best.row, pa.int64())
            yield pa.RecordBatch.from_pydict({"query": pa.array(keys.value[best.query], pa.string()), "score": pa.array(best.score, pa.int64()), "key": batch.column("key").take(held), "ids": ids.take(held)})

    return run


def _classes(rows: DataFrame, most: int, task_vectors: int) -> DataFrame:
    """(key, x, ids): distinct vectors with the ``most`` smallest ids of each, null last."""
    by_id = Window.partitionBy("key").orderBy(F.col("id").asc_nulls_last())
    few = rows.select("key", "x", "id").withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= most)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"])
    classes = few.groupBy("key").agg(F.first("x").alias("x"), ids.alias("ids"))
    tasks = max(1, math.ceil(rows.count() / task_vectors))
    return materialize(classes.repartition(tasks), "vectors")


def _block_results(classes: DataFrame, block: DataFrame, dims: int, lists: int, most: int) -> DataFrame:
    """(query, found) of one block of query classes: the ``most`` best (score, vec_id, key) of each, best first."""
    spark = classes.sparkSession
    held = block.select("key", "x").toArrow()
    values = held.column("x").combine_chunks()
    matrix = np.zeros((held.num_rows, dims), dtype=np.int64)
    lengths = np.diff(values.offsets.to_numpy())
    matrix[np.arange(dims)[None, :] < lengths[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
    sent = spark.sparkContext.broadcast(matrix)
    keys = spark.sparkContext.broadcast(np.array(held.column("key").to_pylist(), dtype=object))
    lists_of = classes.select("x").mapInArrow(_gather(sent, dims, lists, most), "query long, score long")
    last = lists_of.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("rank") <= most)
    cutoff = np.full(len(matrix), -np.inf)
    for row in last.where(F.col("rank") == most).select("query", "score").collect():
        cutoff[row["query"]] = row["score"]
    cutoffs = spark.sparkContext.broadcast(cutoff)
    entries = classes.mapInArrow(_resolve(sent, cutoffs, keys, dims, lists, most), "query string, score long, key string, ids array<long>")
    each = entries.select("query", "score", "key", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    found = each.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id", "key"))).alias("found"))
    out = materialize(found, "found")
    for table in (sent, keys, cutoffs):
        table.unpersist()
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", embedding: str = "embedding", lists: int = LISTS, query_bytes: int = QUERY_BYTES, task_vectors: int = TASK_VECTORS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest integer inner product for each row that ``is_query`` holds for, all but the row itself.

    Ties go to the smaller id, rows without an id behind them. Rows that repeat an id, or a whole row, are rows of their
    own: each is found, and each query row has its results. Null vectors and those with a null or non-finite component
    take no part. Shorter vectors count as filled up with zeros. Components and scores beyond a long are its ends. Without queries or with a single row
    there are no results. Extra columns are ignored.
    """
    most = k + 1
    x = quantised(F.col(f"`{embedding}`"))
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("x").isNotNull())
    rows = materialize(rows.withColumn("key", F.md5(F.array_join("x", ",").cast("binary"))), "quantised")
    asked = rows.where("asks").select("id", "key")
    classes = _classes(rows, most, task_vectors)
    dims = max(1, classes.agg(F.max(F.size("x"))).first()[0] or 0)
    asking = materialize(classes.select("key", "x").join(asked.select("key").distinct(), "key", "left_semi"), "queries")
    blocks = max(1, math.ceil(asking.count() * dims * 8 / query_bytes))
    block_of = F.pmod(F.xxhash64("key"), F.lit(blocks))
    results = [_block_results(classes, asking.where(block_of == b), dims, lists, most) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, results)
    held = asked.select(F.col("id").alias("query_id"), F.col("key").alias("query")).join(found, "query")
    own = F.array_position(F.transform("found", lambda f: (f["key"] == F.col("query")) & f["vec_id"].eqNullSafe(F.col("query_id"))), F.lit(True))
    others = F.slice(F.filter(F.col("found"), lambda f, i: i + 1 != F.col("own")), 1, k)
    ranked = held.withColumn("own", own).select("query_id", F.posexplode(others).alias("at", "hit"))
    out = materialize(ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")), "top")
    release(rows, classes, asking, *results)
    return out


def nearest(embeddings: DataFrame) -> DataFrame:
    """The best K rows for every row whose id EVERY divides."""
    return top_k(embeddings, F.col("vec_id") % EVERY == 0)
