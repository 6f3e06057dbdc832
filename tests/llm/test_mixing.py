from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from llm.conftest import ODD, prose, spaced

from lodestone.llm import mixing


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        budget = left - sum(2 * sizes[s] for s in full)
        goal = {s: 2 * sizes[s] if s in full else budget * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if goal[s] > 2 * sizes[s]}
        if not over:
            return goal
        full |= over


def check(docs, tolerance=0.02, settled=mixing.SETTLED):
    rows = mixing.mix(docs, settled).collect()
    source = {d.doc_id: d.source for d in docs.collect()}
    size = {d.doc_id: len(spaced(d.text)) for d in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == size
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = source[r.doc_id]
        total[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
    want = expected_targets(dict(total))
    for s in total:
        assert abs(target[s] - want[s]) <= 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= max(tolerance * target[s], 8), s
    assert all(r.source_size == total[source[r.doc_id]] for r in rows)
    return rows


def test_targets_and_totals(table):
    rng = random.Random(1)
    rows = [(prose(rng, rng.choice([1, 5, 30, 200, 900])), rng.choice(["a", "b", "ü", "Z", None, "big", "big", "big", "big"])) for _ in range(400)]
    docs = table(rows)
    first = check(docs)
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_rates_are_the_balanced_ones(spark):
    """Rates of a source are exponential in size, cut at the bound, and meet the target; bisection finds the same tilt."""
    rng = random.Random(3)
    sizes = {k: [rng.choice([1, 3, 10, 80, 500]) for _ in range(60)] for k in "abcd"}
    histogram = spark.createDataFrame([(k, s, n) for k, own in sizes.items() for s, n in Counter(own).items()], "key_ string, size_ long, n long")
    goals = mixing.targets(histogram)
    target = {r.key_: r.target for r in goals.collect()}
    assert target == pytest.approx(expected_targets({k: sum(v) for k, v in sizes.items()}))
    for r in mixing.rates(histogram, goals).collect():
        own = sizes[r.key_]
        if r.tilt is None:
            assert target[r.key_] == pytest.approx(2 * sum(own))
            continue
        mean = sum(own) / len(own)
        low, high = -500.0, 500.0
        for _ in range(200):
            tilt = (low + high) / 2
            low, high = (tilt, high) if sum(s * min(2.0, math.exp(min(50.0, tilt * s / mean))) for s in own) <= target[r.key_] else (low, tilt)
        assert r.mean == pytest.approx(mean) and r.tilt == pytest.approx(low, abs=1e-6)


def test_many_sources_null_ids_and_repeats(spark):
    rows = [(i if i % 5 else None, "w " * (1 + i % 7), f"s{i % 300:03d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    want = expected_targets({s: sum(len(t.split()) for _, t, k in rows if k == s) for _, _, s in rows})
    assert len(got) == 900 and {r.key_[1:]: r.target for r in got} == pytest.approx(want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_rows_alike_are_rounded_apart(spark):
    """Many rows without an id and of one size, of one text and of many, and rows that repeat one id: each source meets its target."""
    rows = [(None, "w " * 10, "a")] * 9000 + [(None, f"w{i} " * 14, "b") for i in range(6000)] + [(7, "v " * 12, "c")] * 5000 + [(i, "u " * 11, "d") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = mixing.mix(docs, 200).collect()
    taken, target = {}, {r.key_: r.target for r in got}
    for r in got:
        taken[r.key_] = taken.get(r.key_, 0) + r.taken
    assert len(got) == len(rows) and taken == pytest.approx(target, rel=0.01)
    again = mixing.mix(docs.repartition(3), 200)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    repeated = mixing.mixed_documents(docs, 200).groupBy("source").count().collect()
    assert {f"a{r.source}": r["count"] * {"a": 10, "b": 14, "c": 12, "d": 11}[r.source] for r in repeated} == taken


def test_rows_alike_that_many_tasks_number(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ALIKE_ROWS", 7)
    rows = mixing._numbered(spark.createDataFrame([(1, "x")] * 50 + [(2, "y")] * 7 + [(None, None)] * 8, "doc_id long, text_ string")).collect()
    assert sorted((str(r.doc_id), r.number) for r in rows) == sorted([("1", i) for i in range(50)] + [("2", i) for i in range(7)] + [("None", i) for i in range(8)])


def test_mostly_hashed_rounding(table):
    rng = random.Random(2)
    check(table([(prose(rng, rng.randrange(1, 40)), rng.choice("abc")) for _ in range(3000)]), 0.03, 300)


def test_odd_and_empty(table):
    rows = mixing.mix(table(ODD)).collect()
    assert all(r.taken == 0 for r in rows if r.size == 0) and len(rows) == len(ODD)
    assert mixing.mix(table([])).count() == 0
    assert [r.taken for r in mixing.mix(table([None, ""])).collect()] == [0, 0]


def test_documents_are_repeated(table):
    docs = table([("a b c", "x"), ("d e", "x"), ("f", "y"), (None, None)])
    taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, n in taken.items() for _ in range(n))
