"""Records of structures that a recogniser read from image crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions.keys import largest_fragment
from lodestone.operators.images import is_thin_rule
from lodestone.operators.structures import Keyer, structure_keys, with_keys


def candidates(inventory: DataFrame) -> DataFrame:
    """Images in which structures are looked for; ruled lines aren't."""
    return inventory.where(F.col("label").isin(*C.STRUCTURE_LABELS) & ~is_thin_rule(F.col("width"), F.col("height")))


def validate(predictions: DataFrame, keyer: Keyer = structure_keys) -> DataFrame:
    """predictions (predicted_smiles, error, ...) with status and reason, and smiles, inchikey, block and heavy_atoms of accepted ones."""
    text = F.trim(F.coalesce("predicted_smiles", F.lit("")))
    rows = with_keys(predictions.withColumn("predicted_smiles", F.nullif(text, F.lit(""))), keyer, "predicted_smiles")
    rows = rows.withColumn("part", F.when(F.col("k.valid"), largest_fragment(F.col("predicted_smiles"))))
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("recognizer_error:"), F.col("error"))).when(F.col("predicted_smiles").isNull(), "empty_prediction")
        .when(F.col("part").isNull(), "invalid_smiles").when(F.col("k.heavy_atoms") < C.MIN_HEAVY_ATOMS, "too_small").when(F.col("k.block").isNull(), "inchikey_failed")
    )
    good = F.col("reason").isNull()
    rows = rows.withColumn("reason", reason)
    found = {"smiles": F.col("part"), "inchikey": F.col("k.key"), "block": F.col("k.block"), "heavy_atoms": F.col("k.heavy_atoms")}
    for name, value in found.items():
        rows = rows.withColumn(name, F.when(good, value))
    return rows.withColumn("status", F.when(good, "accepted").otherwise("refused")).drop("part", "k", "error")


def deduplicate(records: DataFrame, order: str = "ord") -> DataFrame:
    """The first accepted record of each structure on a page, and every other record that isn't accepted."""
    accepted = F.col("status") == "accepted"
    first = F.row_number().over(Window.partitionBy("source_doc", "page_number", "block", "status").orderBy(order))
    return records.withColumn("_copy", first).where(~accepted | (F.col("_copy") == 1)).drop("_copy")


def summary(records: DataFrame) -> DataFrame:
    """One row: crops, accepted, refused, and a map of refusals by reason."""
    counts = records.agg(F.count("*").alias("crops"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "refused").alias("refused"))
    reasons = records.where("status = 'refused'").groupBy("reason").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("refused_by_reason"))
    return counts.crossJoin(F.broadcast(reasons))


def for_block(records: DataFrame, block: str | None) -> DataFrame:
    """Accepted records of a structure; none for no structure."""
    return records.where((F.col("block") == block) & (F.col("status") == "accepted")) if block else records.limit(0)
