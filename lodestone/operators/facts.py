"""Verified table extraction: a known layout is read whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C

TEMPERATURES = (25, 30, 35, 40)


def solubility_rows(sources: DataFrame, block: str, subjects: dict[str, tuple[str, str]]) -> DataFrame:
    """Facts of a structure from ranked sources (rank, source_doc, page_number, blocks, text).

    ``subjects`` maps a block to its symbol in the table and its label. Each solvent comes from the first source and
    header whose rows hold all expected fractions in order and no negative figure.
    """
    columns = "solvent string, title string, source int, source_doc string, page long, row_ord int, organic_fraction double, temperature_C int, solubility_x100 double, uncertainty_x100 double, lower double, upper double"
    if block not in subjects:
        return sources.sparkSession.createDataFrame([], columns)
    symbol, label = subjects[block]
    text = F.col("text")
    page = (F.col("source_doc") == C.FACT_DOCUMENT) & (F.col("page_number") == C.FACT_PAGE) & F.array_contains("blocks", block)
    for token in C.FACT_TOKENS:
        page = page & text.contains(token)
    found = sources.where(page & text.rlike(C.FACT_TEMPERATURES))
    heads = F.regexp_extract_all(text, F.lit(C.FACT_HEADER), F.lit(0))
    sections = F.slice(F.split(text, C.FACT_HEADER), 2, F.size(heads))
    parts = found.select("rank", "source_doc", "page_number", F.posexplode(F.arrays_zip(heads.alias("head"), sections.alias("section"))).alias("head_ord", "p"))
    named = parts.select("rank", "source_doc", "page_number", "head_ord", F.regexp_extract("p.head", C.FACT_HEADER, 1).alias("symbol"), F.regexp_extract("p.head", C.FACT_HEADER, 2).alias("solvent"), F.regexp_extract_all("p.section", F.lit(C.FACT_ROW), F.lit(0)).alias("lines")).where(F.col("symbol") == symbol)
    numbers = F.transform("lines", lambda line: F.transform(F.regexp_extract_all(line, F.lit(r"\d+\.\d+"), F.lit(0)), lambda v: v.cast("double")))
    steps = F.when(F.col("solvent") == "DMSO", F.array(*[F.lit(x) for x in C.FACT_STEPS])).otherwise(F.array(*[F.lit(x) for x in C.FACT_STEPS[1:]]))
    whole = named.withColumn("numbers", numbers).where((F.transform("numbers", lambda x: F.get(x, F.lit(0))) == steps) & ~F.exists("numbers", lambda x: F.exists(x, lambda v: v < 0)))
    first = F.row_number().over(Window.partitionBy("solvent").orderBy("rank", "head_ord"))
    chosen = whole.withColumn("copy", first).where("copy = 1")
    cells = chosen.select("solvent", "rank", "source_doc", "page_number", F.posexplode("numbers").alias("row_ord", "x"))
    four = F.array(*[F.struct(F.lit(t).alias("t"), F.get("x", F.lit(1 + 2 * i)).alias("v"), F.get("x", F.lit(2 + 2 * i)).alias("u")) for i, t in enumerate(TEMPERATURES)])
    flat = cells.select("*", F.explode(four).alias("c"))
    return flat.select(
        "solvent", F.concat(F.lit(f"{label} · "), F.col("solvent"), F.lit(" + water")).alias("title"), F.col("rank").alias("source"), "source_doc", F.col("page_number").alias("page"), "row_ord",
        F.get("x", F.lit(0)).alias("organic_fraction"), F.col("c.t").alias("temperature_C"), F.col("c.v").alias("solubility_x100"), F.col("c.u").alias("uncertainty_x100"),
        (F.col("c.v") - F.col("c.u")).alias("lower"), (F.col("c.v") + F.col("c.u")).alias("upper"),
    )


def chart_series(facts: DataFrame, by_composition: bool = True) -> DataFrame:
    """(solvent, series, points): for each temperature the figures over the fraction, or the other way round."""
    series, x = ("temperature_C", "organic_fraction") if by_composition else ("organic_fraction", "temperature_C")
    points = F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col("solubility_x100").alias("y"), F.col("uncertainty_x100").alias("e"))))
    return facts.groupBy("solvent", F.col(series).cast("double").alias("series")).agg(points.alias("points"))
