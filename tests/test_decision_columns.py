from __future__ import annotations

from lodestone.operators import tableocr


def test_decisions_alone_carry_no_cells(spark):
    """Whether a grid was found is asked of its number of rows, so the text of a raster isn't moved for its status."""
    words = spark.createDataFrame([("t", i, "w", 90.0, 10 + 130 * (i % 3), 10 + 40 * (i // 3), 40, 16) for i in range(12)], "table_id string, word_ord int, text string, conf double, left int, top int, width int, height int")
    tables = spark.createDataFrame([("t",), ("none",)], "table_id string")
    decided = tableocr.decide(tables, tableocr.by_table(words)).select("table_id", "status", "reason", "n_rows")
    assert {tuple(r) for r in decided.collect()} == {("t", "accepted", None, 4), ("none", "refused", "no_text", None)}
    plan = decided._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "cells#" not in above and "raw_text#" not in above
