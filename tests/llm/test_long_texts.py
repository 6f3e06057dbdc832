from __future__ import annotations

import zlib

import pytest

from lodestone.llm import mixing, near_dedup, quality_rules, secrets, sharding
from lodestone.llm.textarrays import GROUP_BYTES

#: Longer than a group of texts that is worked on at once.
WORDS = 150_000
LONG = " ".join(f"w{i}" for i in range(WORDS)) + "\nsecret = abcdefgh12"


@pytest.fixture(scope="module")
def docs(spark):
    """A very long text in rows without an id, with one, and with the same one again; a row without anything; a short one."""
    assert len(LONG) > 2 * GROUP_BYTES
    return spark.createDataFrame([(None, LONG, "s"), (5, LONG, "s"), (5, LONG, "s"), (None, None, None), (7, "short text", "t")], "doc_id long, text string, source string")


def test_secrets(docs):
    at = LONG.index("secret")
    assert sorted((r.n_assign, r.spans) for r in secrets.secrets(docs).collect()) == [(0, "")] * 2 + [(1, f"assign:{at}:{len(LONG)}")] * 3


def test_near_duplicates(docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    many = WORDS + 3 - 4
    assert got == sorted([(None, many, 5, False), (5, many, 5, True), (5, many, 5, True), (None, 0, None, False), (7, 1, 7, True)], key=str)


def test_quality_rules(docs):
    got = sorted(((r.doc_id, r.n_words, r.n_repeat_words, r.kept) for r in quality_rules.judged(docs).collect()), key=str)
    assert got == sorted([(None, WORDS + 3, 0, True), (5, WORDS + 3, 0, True), (5, WORDS + 3, 0, True), (None, 0, 0, False), (7, 2, 0, False)], key=str)
    assert sorted(str(r.doc_id) for r in quality_rules.keep_good(docs).collect()) == ["5", "5", "None"]


def test_shards_and_mix(docs):
    placed = sharding.assign(docs).collect()
    assert sorted(r.size_ for r in placed) == [1, 11] + [len(LONG) + 1] * 3 and sum(r.crc_ == zlib.crc32(LONG.encode()) for r in placed) == 3
    assert sorted(r.size for r in mixing.mix(docs).collect()) == [0, 2] + [WORDS + 3] * 3
