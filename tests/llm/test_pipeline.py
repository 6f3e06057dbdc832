from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from llm import test_decontaminate, test_near_dedup, test_quality_rules
from llm.conftest import ODD, prose, spaced
from llm.test_mixing import expected_targets

import corpus_pipeline
from lodestone.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with short ones, repeats, near copies, contaminated ones and several sources, and a benchmark."""
    rng = random.Random(11)
    items = [prose(rng, 30) for _ in range(5)]
    texts = []
    for i in range(140):
        text = prose(rng, rng.randrange(20, 160))
        if i % 10 == 3:
            text += " " + rng.choice(items)
        if i % 14 == 5:
            text = test_near_dedup.edited(rng, texts[-1] or text, 0.01)
        if i % 17 == 6:
            text = "the same three words " * 30
        texts.append(text if i % 23 else None)
    texts += texts[10:16]
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None, "hot", "hot", "hot"]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        after = docs.collect()
        seen[name] = (len(before), len(after))
        kept = Counter(r.doc_id for r in after)
        if name == "quality_rules":
            assert kept == Counter(r.doc_id for r in before if not test_quality_rules.base(r.text)[5])
        elif name == "near_dedup":
            want = test_near_dedup.expected(before)
            assert kept == Counter(d for d, (_, c) in want.items() if d == c)
        elif name == "decontaminate":
            items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
            assert kept == Counter(r[0] for r in test_decontaminate.expected(before, items) if not r[5])
        elif name == "mix_sources":
            size, goal, taken = Counter(), None, Counter()
            for r in before:
                size[r.source] += len(spaced(r.text))
            goal = expected_targets(dict(size))
            for r in after:
                taken[r.source] += len(spaced(r.text))
            assert all(abs(taken[s] - goal[s]) <= max(0.05 * goal[s], 15) for s in size) and max(kept.values()) <= 2
        else:
            assert kept == Counter(r.doc_id for r in before)
            loads = Counter(r.shard for r in after)
            assert set(loads) <= set(range(8)) and max(loads.values()) - min(loads.values()) <= 1
            assert all(sorted(r.slot for r in after if r.shard == s) == list(range(n)) for s, n in loads.items())
        assert docs.columns == columns or name == "shards" and docs.columns[:5] == columns
    assert all(a > b for a, b in (seen[n] for n in ("quality_rules", "near_dedup", "decontaminate")))


def test_run_gives_the_last_stage(spark, folder):
    first = sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, folder).collect())
    assert first == sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, folder).collect()) and first


def test_every_stage_bears_empty_tables_nulls_and_clashing_columns(spark, tmp_path, table):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = table([*ODD, "fine words " * 40, ("another text of words " * 30, None)])
    nulls = odd.withColumn("doc_id", F.lit(None).cast("long")).withColumn("n_chars", F.lit(None).cast("long"))
    for docs in (table([]), odd, nulls, odd.unionByName(odd)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, str(tmp_path))
            assert got.columns[: len(docs.columns)] == docs.columns, name
            assert got.count() <= 2 * docs.count()


def test_run_on_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_frequent_lines_go_in_the_pipeline(spark):
    """A banner on more pages of a host than the limit goes, its pages stay; a page of banners alone goes."""
    rng = random.Random(21)
    rows = [(i, f"{prose(rng, 80)}\nOur banner number {i} of today", "en", "h", 0) for i in range(30)]
    rows.append((99, "\n".join(f"Our banner number {i} of today" for i in range(20)), "en", "h", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert sorted(got) == list(range(30)) and not any("banner" in t for t in got.values())


def test_registered_names():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5
