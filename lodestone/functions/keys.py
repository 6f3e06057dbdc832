"""Identity: stable ids and structure keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as C

_ATOM = r"\[(?!H\]|H\+\])[^\]]+\]|Br|Cl|[BCNOSPFIbcnosp](?![^\[]*\])"


def _stable_id(prefix: str, *parts: Column) -> Column:
    shown = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.concat(F.lit(prefix), F.left(F.sha1(F.concat_ws("|", *shown)), F.lit(14)))


def table_id(filename: Column, page: Column, image_index: Column) -> Column:
    return _stable_id("tbl_", filename, page, image_index)


def structure_id(filename: Column, page: Column, source_kind: Column, source_index: Column, crop_index: Column) -> Column:
    return _stable_id("ocsr_", filename, page, source_kind, source_index, crop_index)


def heavy_atoms(smiles: Column) -> Column:
    return F.regexp_count(smiles, F.lit(_ATOM))


def parseable(smiles: Column) -> Column:
    """Whether a string is made of SMILES symbols only, with closed brackets; stands in for a toolkit's parser."""
    symbols = smiles.rlike(r"^(\[[^\[\]]+\]|Br|Cl|[BCNOSPFIbcnosp]|[0-9]|%[0-9]{2}|[-=#$:/\\.~()*])+$")
    return symbols & (F.regexp_count(smiles, F.lit(r"\(")) == F.regexp_count(smiles, F.lit(r"\)")))


def largest_fragment(smiles: Column) -> Column:
    """The dot-separated part with most heavy atoms, the first of equals."""
    parts = F.transform(F.split(smiles, r"\."), lambda p, i: F.struct(heavy_atoms(p).alias("n"), (-i).alias("order"), p.alias("part")))
    return F.array_max(parts)["part"]


def surrogate_key(smiles: Column) -> Column:
    """(key, block, heavy_atoms) from a canonical SMILES string without a chemistry toolkit; key and block are null below the least size.

    The block ignores stereochemistry. It isn't an InChIKey: two spellings of one molecule get one block only if their
    canonical strings agree, and tautomers don't.
    """
    part = largest_fragment(F.when(smiles != "", smiles))
    digest = F.upper(F.left(F.sha2(F.regexp_replace(part, r"[/\\@]", ""), 256), F.lit(14)))
    block = F.when(heavy_atoms(part) >= C.MIN_HEAVY_ATOMS, digest)
    return F.struct(F.when(block.isNotNull(), F.concat(block, F.lit("-"), F.upper(F.left(F.sha2(part, 256), F.lit(10))))).alias("key"), block.alias("block"), heavy_atoms(part).alias("heavy_atoms"))


def surrogate_block(smiles: str) -> str:
    """The block of one canonical string of one fragment, as a literal for queries."""
    import hashlib
    import re

    return hashlib.sha256(re.sub(r"[/\\@]", "", smiles).encode()).hexdigest()[:14].upper()
