"""Grids read by raster are those of the single words' rules, on words that lack sizes or share places, too, and no word is moved for them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.operators import tableocr
from lodestone.plans import fixtures

BOX = "table_id string, word_ord int, text string, conf double, left int, top int, width int, height int"


def some_boxes(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for t in range(40):
        for i in range(rng.choice([1, 3, 12, 40])):
            maybe = lambda v: None if rng.random() < 0.03 else v
            rows.append((f"t{t}", i - rng.randrange(2), rng.choice(["a", "bb", "é", " ", "x y"]), rng.choice([50.0, 91.5]), maybe(rng.randrange(5) * 90 + rng.randrange(3)), maybe(rng.randrange(8) * 30 + rng.randrange(4)), maybe(rng.choice([10, 40, 300])), maybe(rng.choice([8, 12, 16]))))
    return rows


def test_rasters_are_read_as_single_words_are(spark):
    words = spark.createDataFrame(some_boxes(1) + [(None, 0, "lost", 90.0, 1, 1, 1, 1)], BOX)
    read = {r.table_id: r for r in tableocr.read_tables(words).collect()}
    assert None not in read and len(read) == 40
    assert {k: r.raw_text for k, r in read.items()} == {r.table_id: r.raw_text for r in tableocr.raw_text(words).collect()}
    means = {r.table_id: r.m for r in words.where("table_id is not null").groupBy("table_id").agg(F.avg("conf").alias("m")).collect()}
    assert all(abs(r.mean_confidence - means[k]) < 1e-9 for k, r in read.items())
    rows = tableocr.text_rows(words)
    n_rows = {r.table_id: r.n for r in rows.groupBy("table_id").agg((F.max("row") + 1).alias("n")).collect()}
    edges = {r.table_id: r.edges for r in tableocr.column_edges(rows).collect()}
    grids = {k: (r.n_rows, r.edges) for k, r in read.items() if r.cells is not None}
    assert grids and grids == {k: (n_rows[k], e) for k, e in edges.items() if n_rows[k] >= 2 and len(e) >= 1}
    assert all(len(r.cells) == r.n_rows and {len(c) for c in r.cells} == {r.n_cols} for r in read.values() if r.cells is not None)


def test_rasters_of_documents_move_texts_only(spark):
    docs = spark.createDataFrame([(1, "one two three " * 40), (2, None), (1, "four  five"), (None, "x"), (3, ""), (4, "six")], "doc_id long, text string")
    packed = fixtures.table_frame(spark, docs)
    single = packed.select("table_id", F.explode("words").alias("w")).select("table_id", "w.*")
    want = fixtures.box_frame(spark, docs).where("table_id is not null")
    assert sorted(map(str, single.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    plan = tableocr.recover_grids(packed)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # the texts of documents, and the chosen boxes
    assert plan.count("Exchange hashpartitioning") <= 2
