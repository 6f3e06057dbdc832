"""Whole runs over images: from an inventory to decided records, with the outside engines given as callables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.keys import table_id
from lodestone.operators import images, structocr, tableocr
from lodestone.sources import adapters


def inventory(embedded: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Classified images (filename, page, image_index, width, height, ...), with pixel features (filename, page, image_index, features) where they were decoded."""
    keys = ["filename", "page", "image_index"]
    kind = "struct<white_frac:double,ink_frac:double,chroma:double,n_hlines:int,grid:boolean>"
    known = embedded.join(features, keys, "left") if features is not None else embedded.withColumn("features", F.lit(None).cast(kind))
    return adapters.with_paper_ids(images.classify(known)).withColumn("confidence", F.lit("heuristic"))


def inventory_at(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The inventory at ``path``; where there is none, what ``build()`` gives, checked and written there first."""
    try:
        return images.check_inventory(spark.read.parquet(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    images.check_inventory(build()).write.parquet(path)
    return spark.read.parquet(path)


def run_table_ocr(found: DataFrame, read_words: Callable[[bytes], dict[str, list]]) -> DataFrame:
    """Records of all table images of an inventory with ``content``; only those that may be tables are read."""
    known = found.withColumn("table_id", table_id(F.col("filename"), F.col("page"), F.col("image_index")))
    tried = known.where(tableocr.skip_reason(F.col("label"), F.col("width"), F.col("height")).isNull())
    raw = adapters.ocr_words(tried.where("content is not null"), read_words)
    failures = raw.where("error is not null").select("table_id", "error").unionByName(tried.where("content is null").select("table_id", F.lit("decode_failed").alias("error")))
    return tableocr.table_records(found.drop("content"), tableocr.words_from_columns(raw.where("error is null")), failures)


def run_structure_ocr(embedded: DataFrame | None, pages: DataFrame | None, segment: Callable[[bytes], Iterable[bytes]], recognise: Callable[[bytes], object]) -> DataFrame:
    """Records of crops from embedded images, from rendered pages, or from both: validated, and one of each structure on a page."""
    sides = []
    if embedded is not None:
        sides.append(structocr.candidates(embedded).select(F.col("filename").alias("source_doc"), F.col("page").alias("page_number"), F.lit("embedded").alias("source_kind"), F.col("image_index").alias("source_index"), "content"))
    if pages is not None:
        sides.append(pages.select(F.col("filename").alias("source_doc"), F.col("page").alias("page_number"), F.lit("page_segment").alias("source_kind"), F.lit(0).alias("source_index"), "content"))
    if not sides:
        raise ValueError("neither embedded images nor pages are given")
    cut = adapters.crops(sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]), segment)
    read = adapters.recognised(cut.where("content is not null").select(F.col("id").alias("crop_id"), "content"), recognise)
    joined = cut.drop("content").withColumnRenamed("error", "cut_error").join(read.withColumnRenamed("crop_id", "id"), "id", "left")
    records = structocr.validate(joined.withColumn("error", F.coalesce("cut_error", "error")).drop("cut_error"))
    order = F.row_number().over(Window.partitionBy("source_doc", "page_number").orderBy("source_kind", "source_index", "crop_index"))
    return structocr.deduplicate(records.withColumn("ord", order))
