from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, key string, x int, rank int, score string, query long, ids string"


def rows_of(vectors):
    return [(i, v, 1, "k", 2, 3, "s", 4, "i") for i, v in vectors]


def brute(vectors, k, every):
    """All scores of each query row against all other rows."""
    whole = [(i, [math.floor(topk.SCALE * float(np.float32(x))) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(whole):
        if q is None or q % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for j, (i, b) in enumerate(whole) if j != at))[:k]
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scored, 1)]
    return sorted(out, key=repr)


def got(table, **more):
    every = more.pop("every", topk.EVERY)
    found = topk.top_k(table, F.col("vec_id") % every == 0, **more)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize(("lists", "query_bytes", "task_vectors", "held"), [(2, 1 << 20, 8192, 1 << 21), (3, 1 << 20, 50, 64), (5, 8 * 12 * 7, 100, 1), (1, 1 << 20, 8192, 1 << 21)])
def test_matches_brute_force(spark, monkeypatch, lists, query_bytes, task_vectors, held):
    monkeypatch.setattr(topk, "HELD_SCORES", held)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    vectors = [(i, (centres[i % 6] + 0.3 * rng.normal(size=12)).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(150)] + [(2000 + i, [0.0] * 12) for i in range(60)] + [(3000 + i, [-x for x in vectors[3][1]]) for i in range(20)]
    random.Random(1).shuffle(vectors)
    assert got(spark.createDataFrame(rows_of(vectors), SCHEMA), k=5, every=10, lists=lists, query_bytes=query_bytes, task_vectors=task_vectors) == brute(vectors, 5, 10)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    vectors = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (100, [1.0, 2.0]), (200, None), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (600, []), (700, [0.5]),
        (None, [1.0, 2.0]), (None, [1.0, 2.0]), (None, [9.0, 9.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (-100, [-1.0, -2.0]), (5, [1e-9, -1e-9]),
    ]
    table = spark.createDataFrame(rows_of(vectors), SCHEMA)
    assert got(table) == brute(vectors, 10, 100)
    assert got(table, k=3) == brute(vectors, 3, 100)
    assert got(table, k=40) == brute(vectors, 40, 100)


def test_empty_tables_and_a_single_row(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame(rows_of([(100, [1.0])]), SCHEMA)) == []
    assert got(spark.createDataFrame(rows_of([(1, [1.0]), (2, [2.0])]), SCHEMA)) == []
    assert got(spark.createDataFrame(rows_of([(100, None), (2, [2.0])]), SCHEMA)) == []


def test_large_components_stay_exact(spark):
    """Products beyond 2 ** 24, beyond 2 ** 53, and sums beyond a long."""
    for scale in (3e3, 1e5):
        vectors = [(i, [scale * (1 + i % 7), -scale * (i % 5), scale / (1 + i)]) for i in range(0, 300, 10)]
        assert got(spark.createDataFrame(rows_of(vectors), SCHEMA)) == brute(vectors, 10, 100)
    huge = [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0])]
    assert got(spark.createDataFrame(rows_of(huge), SCHEMA)) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_third_of_rows_alike(spark):
    """A vector that a third of all rows share is one class; each of its rows still has results, without its own."""
    vectors = [(i, [0.5, 0.25, -0.5] if i % 3 == 0 else [math.sin(i), math.cos(i), math.sin(2 * i)]) for i in range(3000)]
    assert got(spark.createDataFrame(rows_of(vectors), SCHEMA)) == brute(vectors, 10, 100)


def test_long_vectors(spark):
    rng = np.random.default_rng(9)
    vectors = [(i * 50, rng.normal(size=5000).tolist()) for i in range(20)]
    assert got(spark.createDataFrame(rows_of(vectors), SCHEMA), k=4) == brute(vectors, 4, 100)
