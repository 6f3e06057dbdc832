from __future__ import annotations

import random

import numpy as np
import pytest
from llm.conftest import ODD, lower, prose, spaced

import corpus_pipeline
from lodestone.llm import near_dedup, setsketch
from lodestone.llm.components import components


def expected(rows) -> dict[int, tuple[int, int]]:
    sets = {}
    for row in rows:
        w = spaced(lower(row.text))
        sets[row.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def check(docs):
    want = expected(docs.collect())
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(want)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_match_brute_force(table):
    rng = random.Random(1)
    base = [prose(rng, rng.randrange(5, 300)) for _ in range(40)]
    texts = [edited(rng, rng.choice(base), rng.choice([0, 0.005, 0.02, 0.03])) for _ in range(200)]
    check(table(base + texts))


@pytest.mark.parametrize(("rows", "way"), [(2048, None), (50, "shingles"), (50, "buckets")])
def test_large_near_group_without_a_centre(table, monkeypatch, rows, way):
    """Members at similarities around the threshold: many components in one bucket, links that the leaders don't see, either way."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows)
    if way:
        costs = iter([0, 1] if way == "shingles" else [1, 0])
        monkeypatch.setattr(near_dedup, "_comparisons", lambda named: next(costs))
    rng = random.Random(2)
    base = prose(rng, 150)
    check(table([edited(rng, base, rng.choice([0.005, 0.015, 0.02, 0.03])) for _ in range(250)]))


def test_pages_of_one_template(table, monkeypatch):
    """Pages that share a template but fall short of the threshold fill buckets; among them are a few that are linked."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 20)
    rng = random.Random(12)
    template = prose(rng, 140)
    texts = [template + " " + prose(rng, 45, 10**6) for _ in range(150)]
    texts += [edited(rng, t, 0.008) for t in texts[:20]]
    check(table(texts))


def test_odd_texts(table):
    check(table(ODD))


def test_empty_table_and_null_or_repeated_ids(spark, table):
    assert near_dedup.near_duplicates(table([])).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (5, "a b c"), (5, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(rows).na.fill(-1).collect())
    assert got == [(-1, 0, -1, False), (-1, 1, 3, False), (3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False)]


def test_one_id_with_different_texts_loses_no_link(spark):
    """Each text of a repeated id is compared by itself, and the id joins what its texts are linked with."""
    rng = random.Random(11)
    texts = [prose(rng, 200, 10**6) for _ in range(6)]
    near = [t + " more" for t in texts]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[2]), (7, near[1]), (8, near[2]), (3, near[0]), (9, texts[3]), (9, ""), (2, texts[4]), (4, near[4]), (4, texts[5]), (6, near[5]), (None, texts[4]), (None, prose(rng, 50, 10**6))]
    want = {5: 3, 7: 3, 8: 3, 3: 3, 9: 9, 2: 2, 4: 2, 6: 2}
    for order in (rows, rows[::-1]):
        got = near_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want and len(got) == len(rows)
        assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["2", "None"]


def test_dropping_keeps_one_of_each_group(table):
    docs = table(["a b c d e f g", "A B C D E F G", "q r s t u v"])
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 1300, dtype=np.uint64)
    a, b = values[:1000], values[300:]
    m = 2048
    ra, rb = setsketch.sketch(a, m), setsketch.sketch(b, m)
    assert (setsketch.merge(ra, rb) == setsketch.sketch(values, m)).all()
    near = setsketch.estimate_jaccard(ra[None], rb[None], np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(near - 700 / 1300) < 0.05
    assert (setsketch.sketch(values[:0], m) == 0).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_other_thresholds_and_the_pipelines(table):
    """Pairs of similarity 4 / 5 and 36 / 44, and one of 36 / 46."""
    words = [f"a{i}" for i in range(200)]
    texts = [words[:8], words[:9], words[20:60], words[20:68], words[100:140], words[100:150]]
    docs = table([" ".join(t) for t in texts])
    at_80 = {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 80).collect()} == at_80
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {i: i for i in at_80}
    assert sorted(r.doc_id for r in corpus_pipeline.dedup(None, docs, "").collect()) == [0, 2, 4, 5]
