"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words is shared by all grades; ordered thresholds cut its sum into grades:
P(grade <= k) = sigmoid(threshold[k] - weights . features). The model gives an expected grade and tail probabilities.
It is fitted on at most ``SAMPLE`` rated documents, those of the smallest hashes of doc_id, and applied to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textarrays import ALNUM, SPACED, groups, mix, words_of

BUCKETS = 1 << 18
#: Bound of the rated documents that the model is fitted on.
SAMPLE = 12_000
GRADES = 3
PASSES = 200
PENALTY = 1e-3
#: Kept: the tail probability of the best grade is at least this.
LEAST_TAIL = 0.4


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) triples: presence of each word, and shares of words by last byte and by upper-case start."""
    words = words_of(texts, ALNUM)
    text = np.repeat(np.arange(len(texts)), words.counts())
    bucket = (words.hashes() & np.uint64(BUCKETS - 1)).astype(np.int64)
    pairs = np.unique(text * BUCKETS + bucket)
    shapes = words_of(texts, SPACED)
    owner = np.repeat(np.arange(len(texts)), shapes.counts())
    last = shapes.data[shapes.end - 1].astype(np.int64) if len(shapes.end) else np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(b" ".join(t or b"" for t in texts), dtype=np.uint8)
    upper = (raw[shapes.start] >= 65) & (raw[shapes.start] <= 90) & (shapes.end - shapes.start > 1)
    if len(upper):
        upper &= (raw[np.minimum(shapes.start + 1, len(raw) - 1)] >= 65) & (raw[np.minimum(shapes.start + 1, len(raw) - 1)] <= 90)
    kind = (mix(last.astype(np.uint64) + np.uint64(1 << 20) + (upper.astype(np.uint64) << np.uint64(10))) & np.uint64(BUCKETS - 1)).astype(np.int64)
    shape, n = np.unique(owner * BUCKETS + kind, return_counts=True)
    value = 4.0 * n / np.maximum(1, shapes.counts())[shape // BUCKETS]
    both = np.concatenate([pairs, shape])
    return both // BUCKETS, both % BUCKETS, np.concatenate([np.ones(len(pairs)), value]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, passes: int = PASSES, rate: float = 0.3, penalty: float = PENALTY) -> Model:
    """Maximum likelihood under an absolute-value penalty, by adaptive proximal gradient steps over all rows.

    The penalty leaves a weight at 0 unless its word moves the likelihood of enough documents, so the many words that
    tell nothing don't add up over long texts. Rows are in ascending order.

    The slope of a weight is at most the mean of its feature's values, so features whose mean is below the penalty can
    never leave 0 and are left out at the start; the second half goes on with the weights that the first one found.
    """
    n = len(grade)
    able = np.bincount(bucket, weights=np.abs(value), minlength=BUCKETS) > penalty * n
    row, bucket, value = (x[able[bucket]] for x in (row, bucket, value))
    w, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    share = np.clip(np.array([(grade <= k).mean() for k in range(GRADES - 1)]), 0.01, 0.99)
    cut = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(GRADES - 1))
    cut_squares = np.full(GRADES - 1, 1e-8)
    for step in range(2 * passes):
        if step == passes:
            # what the penalty left goes on with a tenth of it, so that it isn't kept small
            kept, penalty = w != 0, penalty / 10
            row, bucket, value = (x[kept[bucket]] for x in (row, bucket, value))
            squares, cut_squares = np.full(BUCKETS, 1e-8), np.full(GRADES - 1, 1e-8)
        score = np.bincount(row, weights=w[bucket] * value, minlength=n)
        edges = np.concatenate([[-np.inf], cut, [np.inf]])
        up, down = _sigmoid(edges[grade + 1] - score), _sigmoid(edges[grade] - score)
        p = np.maximum(up - down, 1e-12)
        slope = 1 - up - down
        g = np.bincount(bucket, weights=slope[row] * value, minlength=BUCKETS) / n
        g_cut = np.array([(np.where(grade == k, -up * (1 - up) / p, 0) + np.where(grade == k + 1, down * (1 - down) / p, 0)).mean() for k in range(GRADES - 1)])
        squares += g * g
        cut_squares += g_cut * g_cut
        pace = rate / np.sqrt(squares)
        w -= pace * g
        w = np.sign(w) * np.maximum(np.abs(w) - pace * penalty, 0)
        cut = np.maximum.accumulate(cut - rate * g_cut / np.sqrt(cut_squares))
    return Model(w.astype(np.float32), cut)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Graded rating of the two labels: 0 toxic, 1 poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 1, 2).otherwise(1)


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in groups(batch):
            row, bucket, value = features(texts)
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(len(texts) + 1))
            bucket, value = bucket[order].astype(np.int32), value[order]
            yield pa.record_batch([batch.column("doc_id")[part], batch.column("grade")[part], pa.array([bucket[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.array([value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["doc_id", "grade", "buckets", "shares"])


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the rated documents, ``sample`` of them at most. Ratings or documents that are null, or that have no partner, don't count; without any, all grades are alike."""
    ratings = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    chosen = ratings.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    got = rows.select("doc_id", F.col("grade").cast("int").alias("grade"), "text").mapInArrow(_rated, "doc_id long, grade int, buckets binary, shares binary").toArrow().sort_by("doc_id")
    bucket = [np.frombuffer(v.as_buffer(), dtype=np.int32) for v in got.column("buckets").combine_chunks()]
    value = [np.frombuffer(v.as_buffer(), dtype=np.float32) for v in got.column("shares").combine_chunks()]
    if not bucket:
        return Model(np.zeros(BUCKETS, dtype=np.float32), np.zeros(GRADES - 1))
    return fit(np.repeat(np.arange(len(bucket)), [len(b) for b in bucket]), np.concatenate(bucket), np.concatenate(value), got.column("grade").to_numpy().astype(np.int64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, expected_grade, tail_1, tail_2, kept) for each row of (doc_id, text, ...): tail_k is P(grade >= k).

    Null and empty texts have no features and get the grades of a sum of 0. Equal texts get equal scores, and repeated
    rows and null ids a row each. Very long texts are read whole. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in groups(batch):
                row, bucket, value = features(texts)
                score = np.bincount(row, weights=model.weights[bucket] * value, minlength=len(texts)).astype(np.float64)
                tails = model.tails(score)
                yield pa.record_batch([batch.column("doc_id")[part], pa.array(score), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(tails[:, 1] >= LEAST_TAIL)], names=["doc_id", "score", "expected_grade", "tail_1", "tail_2", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc_id long, score double, expected_grade double, tail_1 double, tail_2 double, kept boolean")
