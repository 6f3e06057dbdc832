from __future__ import annotations

import hashlib
import random

import pytest
from llm.conftest import ODD, alnum, prose

from lodestone.llm import decontaminate


def expected(docs, items):
    windows: dict[tuple, set[str]] = {}
    for item in items:
        w = alnum(item.text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item.item_id))
    out = []
    for doc in docs:
        w, hit, held = alnum(doc.text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    held |= windows[k]
        out.append((doc.doc_id, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.fixture
def benchmark_table(spark):
    rng = random.Random(1)
    items = [prose(rng, n) for n in (5, 8, 13, 14, 40, 60, 1, 12)]
    items += [items[4], "Q " + items[5], None, "", "...", items[4] + " " + items[4]]
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


@pytest.mark.parametrize("in_memory", [True, False])
def test_matches_brute_force(table, benchmark_table, in_memory):
    rng = random.Random(2)
    items = [r.text for r in benchmark_table.collect() if r.text]
    texts = list(ODD)
    for _ in range(80):
        words = prose(rng, rng.randrange(0, 120)).split()
        source = rng.choice(items).split()
        a = rng.randrange(len(source))
        at = rng.randrange(len(words) + 1)
        words[at:at] = source[a : a + rng.choice([11, 12, 13, 20, 60])]
        texts.append(rng.choice([" ", ", ", "\n"]).join(words).upper())
    docs = table(texts)
    got = decontaminate.contamination(docs, benchmark_table, in_memory)
    assert sorted(tuple(r) for r in got.collect()) == expected(docs.collect(), benchmark_table.collect())


@pytest.mark.parametrize("limit", ["INDEX_BYTES", "INDEX_ITEMS", None])
def test_dropping(table, benchmark_table, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(decontaminate, limit, 3)
    bad = next(r.text for r in benchmark_table.collect() if r.item_id == 4)
    docs = table(["fine words only", bad, None, "x " * 2000 + bad])
    kept = decontaminate.drop_contaminated(docs, benchmark_table)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


@pytest.mark.parametrize("in_memory", [True, False])
def test_null_and_repeated_ids_and_a_very_long_text(spark, benchmark_table, in_memory):
    bad = next(r.text for r in benchmark_table.collect() if r.item_id == 4)
    rows = spark.createDataFrame([(None, bad), (None, bad), (3, "y " * 300_000 + bad), (3, None), (3, bad)], "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(rows, benchmark_table, in_memory).collect()]
    assert sorted(got, key=str) == sorted([(None, 40, 40, True), (None, 40, 40, True), (3, 300_040, 40, False), (3, 0, 0, False), (3, 40, 40, True)], key=str)


def test_empty_tables(spark, table, benchmark_table):
    none = spark.createDataFrame([], benchmark_table.schema)
    assert decontaminate.contamination(table([]), benchmark_table).count() == 0
    assert decontaminate.contamination(table(["a b"]), none).first().n_hit == 0
    assert decontaminate.contamination(table(["a b"]), none, in_memory=False).first().n_words == 2
