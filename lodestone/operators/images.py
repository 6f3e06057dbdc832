"""Inventory of embedded images: geometry, pixel statistics, classes and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C


def is_thin_rule(width: Column, height: Column) -> Column:
    """A ruled line stored as an image, lying or standing; false without dimensions."""
    known = (F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0)
    aspect = width / F.nullif(height, F.lit(0))
    thin = ((height <= C.STRIP_THICKNESS) & (aspect >= C.STRIP_ASPECT)) | ((width <= C.STRIP_THICKNESS) & (aspect <= 1 / C.STRIP_ASPECT))
    return F.coalesce(known & thin, F.lit(False))


def needs_pixels(width: Column, height: Column) -> Column:
    """Whether geometry alone can't decide; to be applied before images are decoded."""
    return ~is_thin_rule(width, height)


def pixel_rows(pixels: DataFrame) -> DataFrame:
    """(image, y, mean, deviation, delta, is_line) of grey pixels (image, y, x, v)."""
    rows = pixels.groupBy("image", "y").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
    above = F.lag("mean").over(Window.partitionBy("image").orderBy("y"))
    delta = F.coalesce(F.abs(F.col("mean") - above), F.lit(0.0))
    return rows.withColumn("delta", delta).withColumn("is_line", (F.col("deviation") < 25) & (F.col("delta") > 8))


def pixel_features(pixels: DataFrame) -> DataFrame:
    """(image, ink_frac, white_frac, entropy, n_hlines, hline_frac, grid) of grey pixels (image, y, x, v), scaled to 240 columns at most."""
    fractions = pixels.groupBy("image").agg(F.avg(F.expr("cast(v < 200 as double)")).alias("ink_frac"), F.avg(F.expr("cast(v > 240 as double)")).alias("white_frac"), F.count("*").alias("n"))
    bins = pixels.groupBy("image", F.least(F.expr("v * 16 div 256"), F.lit(15)).alias("bin")).agg(F.count("*").alias("c")).join(fractions.select("image", "n"), "image")
    share = F.col("c") / F.col("n")
    entropy = bins.groupBy("image").agg((0 - F.sum(share * F.log2(share))).alias("entropy"))
    rows = pixel_rows(pixels)
    gap = F.col("y") - F.lag("y").over(Window.partitionBy("image").orderBy("y"))
    gaps = rows.where("is_line").select("image", gap.alias("gap")).groupBy("image").agg(F.count("*").alias("lines"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("gap_deviation"))
    even = (F.col("lines") >= 4) & (F.col("gap_deviation") < F.greatest(F.lit(2.0), 0.35 * F.col("mean_gap")))
    heights = rows.groupBy("image").agg(F.count("*").alias("height"), F.count_if("is_line").alias("n_hlines"))
    joined = fractions.join(entropy, "image").join(heights, "image").join(gaps, "image", "left")
    return joined.select("image", "ink_frac", "white_frac", "entropy", "n_hlines", (F.col("n_hlines") / F.col("height")).alias("hline_frac"), F.coalesce(even, F.lit(False)).alias("grid"))


def chroma(colours: DataFrame) -> DataFrame:
    """(image, chroma) of colour pixels (image, r, g, b)."""
    return colours.groupBy("image").agg((F.sum(F.abs(F.col("r") - F.col("g")) + F.abs(F.col("g") - F.col("b"))) / (2 * F.count("*"))).alias("chroma"))


def classify(images: DataFrame) -> DataFrame:
    """images (width, height, features) with ``label`` and ``reasons``; features is a struct of the pixel features and chroma, null where undecoded."""
    w, h, f = F.col("width"), F.col("height"), F.col("features")
    aspect = w / F.nullif(h, F.lit(0))
    missing = (F.coalesce(w, F.lit(0)) == 0) | (F.coalesce(h, F.lit(0)) == 0)
    line_art = (f["white_frac"] >= 0.45) & (f["ink_frac"] <= 0.35) & (f["chroma"] < 20)
    ruled = (aspect >= 1.7) & (f["n_hlines"] >= 4) & (f["white_frac"] >= 0.45) & (f["ink_frac"] <= 0.50)
    gridded = f["grid"] & (aspect >= 1.35) & (f["white_frac"] >= 0.40) & (f["ink_frac"] <= 0.50)
    table_reasons = F.array_compact(F.array(F.when(aspect >= 1.7, F.lit("wide_aspect")), F.when(f["grid"], F.lit("grid_like")), F.lit("horizontal_lines")))

    def why(*reasons: str) -> Column:
        return F.array(*[F.lit(r) for r in reasons])

    cases = [
        (missing, "unknown", why("missing_dimensions")),
        (is_thin_rule(w, h) & (h <= C.STRIP_THICKNESS), "table_image", why("thin_wide_strip")),
        (is_thin_rule(w, h), "table_image", why("thin_tall_strip")),
        (f.isNull() & (aspect >= 2.2), "scheme_or_reaction", why("wide_aspect_only")),
        (f.isNull() & aspect.between(0.65, 1.45), "structure_drawing", why("near_square_only")),
        (f.isNull(), "other", why("geometry_only")),
        (ruled | gridded, "table_image", table_reasons),
        (aspect.between(0.55, 1.7) & line_art, "structure_drawing", why("near_square", "sparse_line_art")),
        (line_art, "scheme_or_reaction", why("line_art_composite")),
        ((aspect >= 1.6) & (f["white_frac"] >= 0.35), "scheme_or_reaction", why("wide_composite")),
    ]
    label, reasons = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for condition, name, reason in cases[1:]:
        label, reasons = label.when(condition, name), reasons.when(condition, reason)
    return images.withColumn("label", label.otherwise("other")).withColumn("reasons", reasons.otherwise(why("dense_or_photo")))


def counts_by_document(images: DataFrame) -> DataFrame:
    """(filename, one column for each label, total), absent labels as 0."""
    table = images.groupBy("filename").pivot("label", list(C.IMAGE_LABELS)).agg(F.count(F.lit(1))).na.fill(0)
    return table.withColumn("total", sum((F.col(x) for x in C.IMAGE_LABELS), F.lit(0)))


def counts_by_class(images: DataFrame) -> DataFrame:
    """(filename, label, n_images) with subtotals: nulls stand for all."""
    return images.rollup("filename", "label").agg(F.count("*").alias("n_images"))


def summary(images: DataFrame) -> DataFrame:
    """One row (total_images, counts_by_paper, counts_by_class): the counts as maps, with an entry for each paper and each class. The images stay a table of their own."""
    def counted(column: str, name: str) -> DataFrame:
        rows = images.groupBy(F.coalesce(column, F.lit("")).alias("k")).agg(F.count("*").alias("n"))
        return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(name))

    total = images.agg(F.count("*").alias("total_images"))
    return total.crossJoin(F.broadcast(counted("paper_id", "counts_by_paper"))).crossJoin(F.broadcast(counted("label", "counts_by_class")))


REQUIRED = ("paper_id", "filename", "page", "image_index", "width", "height", "byte_size", "label", "confidence")


def check_inventory(images: DataFrame) -> DataFrame:
    """images, if they have all required columns."""
    if lacking := [c for c in REQUIRED if c not in images.columns]:
        raise ValueError(f"the inventory lacks {', '.join(lacking)}")
    return images
