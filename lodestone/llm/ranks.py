"""Positions of rows in a sorted order, group by group, without a window over a group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.sizes import sent_if_few
from lodestone.llm.scratch import materialize, release

#: Rows of one sorting task; the number of tasks grows with the input.
TASK_ROWS = 20_000


def ranked(rows: DataFrame, group: str, order: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """``rows`` with idx, the position from 0 within the group by ``order``, and n, the group's rows, as a materialized table.

    Rows are range-partitioned by group and order, so that a group that holds most of them spans many tasks. Rows alike in
    all of ``order`` take any order among themselves, and are spread over tasks too. ``group`` holds no nulls.
    """
    tasks = max(1, math.ceil(rows.count() / task_rows))
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col("at_")]
    dealt = rows.withColumn("at_", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    table = materialize(dealt.drop("at_").select("*", F.spark_partition_id().alias("task_"), F.monotonically_increasing_id().alias("id_")), "sorted")
    stretches = table.groupBy(group, "task_").agg(F.count("*").alias("rows_"), F.min("id_").alias("first_"))
    whole = Window.partitionBy(group)
    before = F.sum("rows_").over(whole.orderBy("task_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stretches.select(group, "task_", (F.coalesce(before, F.lit(0)) - F.col("first_")).alias("shift_"), F.sum("rows_").over(whole).alias("n"))
    out = materialize(table.join(sent_if_few(offsets), [group, "task_"]).withColumn("idx", F.col("id_") + F.col("shift_")).drop("task_", "id_", "shift_"), "ranked")
    release(table)
    return out
