"""Names to structures to keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.keys import heavy_atoms, largest_fragment
from lodestone.operators.structures import Keyer, structure_keys, with_keys


def resolve(names: DataFrame, lexicon: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(name, smiles, tier) of names (name): from the lexicon, else from the cache, where a null is an answer too.

    ``tier`` is lexicon, cache or unresolved; unresolved names are what an online source may be asked for.
    """
    wanted = names.select(F.lower(F.trim("name")).alias("name")).distinct()
    found = wanted.join(lexicon.select("name", F.col("smiles").alias("l"), F.lit(True).alias("in_lexicon")), "name", "left")
    if cache is None:
        tier, smiles = F.when(F.col("in_lexicon"), "lexicon").otherwise("unresolved"), F.col("l")
    else:
        found = found.join(cache.select("name", F.col("smiles").alias("c"), F.lit(True).alias("in_cache")), "name", "left")
        tier = F.when(F.col("in_lexicon"), "lexicon").when(F.col("in_cache"), "cache").otherwise("unresolved")
        smiles = F.when(F.col("in_lexicon"), F.col("l")).when(F.col("in_cache"), F.col("c"))
    return found.select("name", smiles.alias("smiles"), tier.alias("tier"))


def unresolved(names: DataFrame, lexicon: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct names that neither table knows, with their frequency where ``names`` has one."""
    often = [F.max("frequency").alias("frequency")] if "frequency" in names.columns else []
    wanted = names.withColumn("name", F.lower(F.trim("name"))).groupBy("name").agg(*often) if often else names.select(F.lower(F.trim("name")).alias("name")).distinct()
    return wanted.join(lexicon.select("name"), "name", "left_anti").join(cache.select("name"), "name", "left_anti")


def compounds(resolved: DataFrame, keyer: Keyer = structure_keys) -> DataFrame:
    """(name, smiles, inchikey, block) of resolved names that have a key."""
    keyed = with_keys(resolved.where("smiles is not null"), keyer)
    return keyed.where("k.block is not null").select("name", "smiles", F.col("k.key").alias("inchikey"), F.col("k.block").alias("block"))


def chunk_entities(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(chunk_ord, name, block): candidates that have a key, one row each."""
    return candidates.join(known, "name").select("chunk_ord", "name", "block")


def annotate(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """chunks with sorted ``compounds`` and ``blocks``; both are empty where nothing was found."""
    gathered = entities.groupBy("chunk_ord").agg(F.sort_array(F.collect_set("name")).alias("compounds"), F.sort_array(F.collect_set("block")).alias("blocks"))
    empty = F.array().cast("array<string>")
    joined = chunks.join(gathered, "chunk_ord", "left")
    return joined.withColumn("compounds", F.coalesce("compounds", empty)).withColumn("blocks", F.coalesce("blocks", empty))


def synonym_groups(known: DataFrame) -> DataFrame:
    """(block, names) of blocks with several names."""
    return known.groupBy("block").agg(F.sort_array(F.collect_set("name")).alias("names")).where(F.size("names") > 1)


def spellings(known: DataFrame, block: str | Column) -> DataFrame:
    return known.where(F.col("block") == block).select("name").distinct()


def verified_lexicon(seed: DataFrame, keyer: Keyer = structure_keys) -> DataFrame:
    """(name, smiles, canonical, block, heavy_atoms, accepted) of a seed (name, smiles).

    ``canonical`` is the string that the key is of, the largest part; rows that don't parse are kept as rejected, without one.
    """
    good = F.col("accepted")
    keyed = with_keys(seed, keyer).withColumn("accepted", F.coalesce("k.valid", F.lit(False)))
    return keyed.select("name", "smiles", F.when(good, largest_fragment(F.col("smiles"))).alias("canonical"), F.col("k.block").alias("block"), F.when(good, heavy_atoms(F.col("smiles"))).alias("heavy_atoms"), "accepted")
