from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from llm.conftest import ODD, prose

from lodestone.llm import substring_dedup


def expected(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(((r.doc_id, r.text or "") for r in rows), key=lambda x: x[0]):
        raw = text.encode()
        hit = bytearray(len(raw))
        for i in range(len(raw) - 99):
            stretch = raw[i : i + 100]
            if stretch in seen:
                hit[i : i + 100] = b"\1" * 100
            seen.add(stretch)
        kept = bytes(b for b, h in zip(raw, hit, strict=True) if not h)
        spans = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        out[doc_id] = (len(raw), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.deduplicated(docs).collect()}
    assert got == expected(docs.collect())


@pytest.mark.parametrize(("alike", "stretches"), [(100_000, 200_000), (3, 200_000), (3, 150)])
def test_matches_brute_force(table, monkeypatch, alike, stretches):
    monkeypatch.setattr(substring_dedup, "ALIKE", alike)
    monkeypatch.setattr(substring_dedup, "BUCKET_STRETCHES", stretches)
    rng = random.Random(5)
    shared = [prose(rng, n) for n in (12, 20, 25, 30, 60, 200)]
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randrange(1, 80)) for _ in range(4)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(5), rng.choice(shared))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], texts[10] + " tail", "x" + texts[11], "z" * 350, "ab" * 200, "z" * 99, "z" * 100, "ü" * 120]
    check(table(texts))


def test_small_buckets_give_the_same(table, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_RECORDS", 5)
    monkeypatch.setattr(substring_dedup, "SORTED_RECORDS", 2)
    rng = random.Random(6)
    one = prose(rng, 50)
    check(table([one, prose(rng, 30) + one, one + prose(rng, 30), "short"]))


def test_equal_stretches_over_several_buckets(table, monkeypatch):
    """More copies of one passage than a bucket holds: the run of equal stretches crosses boundaries."""
    monkeypatch.setattr(substring_dedup, "ALIKE", 2)
    monkeypatch.setattr(substring_dedup, "BUCKET_STRETCHES", 20)
    rng = random.Random(8)
    passage = prose(rng, 30)
    check(table([f"{prose(rng, 6)} {passage} {prose(rng, 5)}" for _ in range(60)]))


def test_multikey_order():
    rng = np.random.default_rng(4)
    for rows, values in ((0, 3), (1, 3), (5000, 2), (3000, 50), (400, 1)):
        tokens, size = rng.integers(0, values, (rows, 6), dtype=np.uint64), rng.integers(0, 9, rows)
        order = substring_dedup.multikey_order(tokens, size)
        got = [(*tokens[i].tolist(), int(size[i])) for i in order]
        assert sorted(order.tolist()) == list(range(rows)) and got == sorted(got)


def test_very_long_text(table):
    rng = random.Random(9)
    long = prose(rng, 200_000, 10**6)
    rows = substring_dedup.deduplicated(table([long, "short", long[600_000:700_000], None])).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {0: 0, 1: 0, 2: 100_000, 3: 0}


def test_odd_texts_and_empty_table(table):
    check(table(ODD))
    assert substring_dedup.deduplicated(table([])).count() == 0


def test_null_and_repeated_ids(spark):
    text = "q" * 30 + "r" * 90
    rows = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.deduplicated(rows).collect())
    assert got == [(-1, 120), (4, 0), (4, 0), (9, 120)]


def test_grams_tell_passages_that_share_24_bytes_apart():
    """Texts that share no more than 24 bytes, as prose does by chance, have no pick in common."""
    rng = np.random.default_rng(1)
    shared = b"common words of prose 24"
    keys = [set(substring_dedup.Picked([rng.integers(97, 123, 300, dtype=np.uint8).tobytes() + shared + rng.integers(97, 123, 300, dtype=np.uint8).tobytes()]).key.tolist()) for _ in range(60)]
    assert len(shared) == 24 and sum(map(len, keys)) == len(set().union(*keys))
