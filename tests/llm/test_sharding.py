from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from llm.conftest import ODD

from lodestone.llm import queries, sharding


def brute(ids, keys, shards, virtual_nodes):
    """One document after the other in ring order; each goes on clockwise past full shards."""
    position, owner = sharding.ring(shards, virtual_nodes)
    left = sharding.equal_bounds(len(ids), shards).tolist()
    out = {}
    for key, doc in sorted(zip(keys, ids, strict=True)):
        node = int(np.searchsorted(position, key, "left"))
        while left[owner[node % len(owner)]] == 0:
            node += 1
        shard = int(owner[node % len(owner)])
        left[shard] -= 1
        out[doc] = shard
    return out


@pytest.mark.parametrize("cell_rows", [20_000, 7])
def test_matches_brute_force(spark, table, monkeypatch, cell_rows):
    monkeypatch.setattr(sharding, "CELL_ROWS", cell_rows)
    docs = table(["t"] * 203)
    keys = docs.select("doc_id", sharding.position_of("doc_id", "text").alias("k")).collect()
    rows = sharding.assign(docs).collect()
    assert {r.doc_id: r.shard_ for r in rows} == brute([k.doc_id for k in keys], [k.k for k in keys], 8, 128)
    for shard, n in Counter(r.shard_ for r in rows).items():
        assert sorted(r.slot_ for r in rows if r.shard_ == shard) == list(range(n))
        assert n in (25, 26)


def test_sizes_checksums_and_odd_rows(table):
    rows = sharding.assign(table(ODD)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        raw = (ODD[r.doc_id] or "").encode()
        assert (r.size_, r.crc_, r.text) == (len(raw) + 1, zlib.crc32(raw), ODD[r.doc_id])


def test_empty_repeated_and_null(spark, table):
    assert sharding.assign(table([])).count() == 0
    several = spark.createDataFrame([(None, f"text {i}") for i in range(40)], "doc_id long, text string")
    assert several.select(sharding.position_of("doc_id", "text")).distinct().count() == 40
    rows = spark.createDataFrame([(1, "a")] * 20 + [(None, "b")] * 4, "doc_id long, text string")
    assert sorted(Counter(r.shard_ for r in sharding.assign(rows).collect()).values()) == [3] * 8


def test_slack_moves_few_documents_to_a_new_shard(table):
    docs = table(["t"] * 600)
    before, after = ({r.doc_id: r.shard_ for r in sharding.assign(docs, n, 128, 0.5).collect()} for n in (8, 9))
    assert max(Counter(before.values()).values()) <= 113
    assert sum(before[d] != after[d] for d in before) < 200


def test_query_columns(spark):
    got = queries.op4_consistent_hash_shards(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


