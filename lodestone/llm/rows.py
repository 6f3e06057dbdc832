"""Rows as one value, so that an operator's own columns can't clash with those of its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROW = "row"


def packed(docs: DataFrame, kept: list[str] | None = None, **own: Column) -> DataFrame:
    """A single column with the row, or with its ``kept`` columns, and the operator's own columns beside it, computed from the row's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in kept or docs.columns]).alias(_ROW), *[c.alias(name) for name, c in own.items()])


def cell(name: str) -> Column:
    return F.col(_ROW).getField(name)


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The row's columns again; ``changed`` replaces some of them, or is added behind them."""
    kept = [changed[c].alias(c) if c in changed else cell(c).alias(c) for c in columns]
    return rows.select(*kept, *[v.alias(c) for c, v in changed.items() if c not in columns])
