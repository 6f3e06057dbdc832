from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from llm.conftest import ODD

from lodestone.llm import manifest


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields) -> str:
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, at):
    """(left, sibling) up to the root; a lone node has none."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append((at % 2 == 1, level[other] if other < len(level) else None))
        at //= 2
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    upper = levels_of([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = path(trees[g], i) + path(upper, n)
            doc_id, source, lang, n_chars, text = row
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            at = leaf_of((doc_id, source, lang, n_chars + 1 if hit and n_chars is not None else n_chars, text))
            for left, sibling in steps:
                at = h(at) if sibling is None else h(sibling, at) if left else h(at, sibling)
            out.append((doc_id, leaf, trees[g][-1][0], upper[-1][0], h(*[s for _, s in steps if s]), at, at == upper[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx int, leaf string, level string, group int, n string, block int, steps int, key string"


def got(spark, rows, tier=manifest.TIER):
    table = spark.createDataFrame([(*r, 1, "x", "y", 2, "z", 3, 4, "k") for r in rows], SCHEMA)
    found = manifest.audited(manifest.document_manifest(table, tier))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize(("sizes", "tier"), [([9, 1, 5, 2], 2), ([40, 17, 64, 65], 3), ([300], 6), ([1], 2), ([1, 1], 2), ([2] * 11, 1)])
def test_matches_brute_force(spark, monkeypatch, sizes, tier):
    monkeypatch.setattr(manifest.ranked, "__defaults__", (7,))
    rng = random.Random(sum(sizes))
    rows = [(rng.randrange(10_000), f"s{i % 3}", f"l{g}", i, f"text {i} of {g}") for g, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    assert got(spark, rows, tier) == brute(rows)


def test_nulls_repeats_and_odd_texts(spark):
    rows = [(i % 5, None if i % 4 else "s", [None, "", "é", "z", "=", "日"][i % 6], None if i % 3 else i, t) for i, t in enumerate(ODD * 3)]
    rows += [(None, None, None, None, None)] * 3 + [(7, "s", "en", 1, "same")] * 40 + [(None, "s", "en", 1, f"t{i}") for i in range(5)] + [(-4, "s", "en", -9, "x" * 300_000)]
    assert got(spark, rows) == brute(rows)


def test_tampering_is_found(spark):
    rows = [(i, "s", f"l{i % 2}", i if i % 11 else None, f"t{i}") for i in range(200)]
    found = {r[0]: r for r in got(spark, rows)}
    for doc_id, _, _, n_chars, _ in rows:
        assert found[doc_id][6] == (zlib.crc32(str(doc_id).encode()) % 7 != 0 or n_chars is None)


def test_no_rows(spark):
    assert got(spark, []) == []


def test_no_coordinate_is_asked_by_many(spark, monkeypatch):
    """A lookup joins every node with no more rows than half a block."""
    asked, kind = [], type(spark.range(0))
    join = kind.join

    def seen(self, other, on=None, how=None):
        if on == ["group", "level", "idx"]:
            asked.append(self.where("idx is not null").groupBy(*on).count())
        return join(self, other, on, how)

    monkeypatch.setattr(kind, "join", seen)
    monkeypatch.setattr(manifest, "release", lambda *tables: None)
    got(spark, [(i, "s", "en", i, "t") for i in range(700)], tier=3)
    assert asked and max(r["count"] for a in asked for r in a.collect()) <= 4


def test_leaves_ask_for_no_coordinates(spark, monkeypatch):
    """A leaf's own siblings stand in its block, and its columns go along: no row of all leaves is looked up or joined back."""
    asked, kind = [], type(spark.range(0))
    join = kind.join

    def seen(self, other, on=None, how=None):
        asked.append(self.count())
        return join(self, other, on, how)

    monkeypatch.setattr(kind, "join", seen)
    monkeypatch.setattr(manifest, "release", lambda *tables: None)
    table = spark.createDataFrame([(i, "s", "en", i, "t", 1, "x", "y", 2, "z", 3, 4, "k") for i in range(500)], SCHEMA)
    manifest.audited(manifest.document_manifest(table, 3))
    # below the sort, which joins its tasks' offsets
    assert [n for n in asked if n >= 500] == [500]
