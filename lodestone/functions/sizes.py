"""Sides of joins whose size is checked before they are sent to all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of short strings, a few MB at most.
SENT_ROWS = 50_000


def sent_if_few(side: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """``side``, marked for broadcast if it has at most ``most`` rows; larger ones are left to the planner.

    For tables of a query or a vocabulary: one small job counts them, so that the other side, which may be every token of a
    corpus, is not shuffled to meet a handful of rows.
    """
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def spread_if_few(table: DataFrame) -> DataFrame:
    """``table`` dealt over all cores if its files give fewer partitions than there are cores, as one small file does; large tables stay where they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
