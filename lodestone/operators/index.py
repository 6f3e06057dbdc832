"""The index: a set of tables built from pages, and passages attached to it."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone import constants as C
from lodestone.functions.names import NameRules
from lodestone.functions import text as T
from lodestone.functions.sizes import sent_if_few
from lodestone.operators import names as N
from lodestone.operators import resolve as R
from lodestone.operators.chunking import STRUCTURE_PART, TABLE_PART, chunk_pages, ordinal
from lodestone.operators.rank import posting_lists, term_counts
from lodestone.operators.search import LIGHT, light_columns
from lodestone.operators.structures import Keyer, structure_keys
from lodestone.operators.tableocr import table_text


@dataclass
class Index:
    """chunks are annotated ones with n_tokens, head_key and text_key; compounds is (name, smiles, inchikey, block); entities has a row for each block of a chunk, postings a list for each term and some megabytes of text (``rank.posting_lists``); terms counts these; frequencies is (name, frequency) of all names found."""

    chunks: DataFrame
    compounds: DataFrame
    entities: DataFrame
    structures: DataFrame | None = None
    tables: DataFrame | None = None
    postings: DataFrame | None = None
    terms: DataFrame | None = None
    frequencies: DataFrame | None = None


def annotated(chunks: DataFrame, known: DataFrame, vocabulary: DataFrame, rules: NameRules = NameRules(), most: int = N.LITERAL_NAMES) -> DataFrame:
    """chunks with sorted ``compounds`` and ``blocks``: the names of ``known`` (name, block) in each, and their keys.

    Up to ``most`` names go to the passages, which stay where they are; more are found by a join.
    """
    names = N.known_names(known, vocabulary, rules, most)
    if names is None:
        return R.annotate(chunks, R.chunk_entities(N.candidate_names(chunks, vocabulary, rules), known))
    return N.with_names(chunks, names)


def structure_postings(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """(block, names, ...): one row for each structure of a chunk, with the names that stand there, which may be none, and what ranking needs of the chunk."""
    rows = chunks.select(*[v.alias(c) for c, v in light_columns(chunks).items()], F.explode("blocks").alias("block"), "compounds")
    listed = known.select("name", "block").distinct().limit(N.LITERAL_NAMES + 1).collect()
    if len(listed) > N.LITERAL_NAMES:
        named = rows.select("chunk_ord", "block", F.explode("compounds").alias("name")).join(sent_if_few(known.select("name", "block")), ["name", "block"])
        names = named.groupBy("chunk_ord", "block").agg(F.sort_array(F.collect_set("name")).alias("names"))
        return rows.drop("compounds").join(names, ["chunk_ord", "block"], "left").select("block", F.coalesce("names", F.array().cast("array<string>")).alias("names"), *LIGHT)
    of_block: dict[str, list[str]] = {}
    for r in listed:
        of_block.setdefault(r["block"], []).append(r["name"])
    names_of = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(of_block)), "map<string,array<string>>"), F.col("block")), F.array().cast("array<string>"))
    return rows.select("block", F.array_sort(F.array_distinct(F.array_intersect("compounds", names_of))).alias("names"), *LIGHT)


def build_index(pages: DataFrame, lexicon: DataFrame, cache: DataFrame | None = None, rules: NameRules = NameRules(), max_candidates: int | None = None, keyer: Keyer = structure_keys, folder: str | None = None) -> Index:
    """Chunk, find names, resolve each once, or the ``max_candidates`` most frequent, and write keys back on the chunks.

    With a ``folder`` chunks, names and compounds are written there first and read back, so that pages are cut once,
    however many tables of the index are written from them. Names are counted in one pass over the passages and written
    back in another; the passages themselves are never moved.
    """

    def staged(table: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return table
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        return table.sparkSession.read.parquet(f"{folder}/{name}")

    cut = staged(chunk_pages(pages, counted=True).withColumns({c: v for c, v in _text_columns().items() if c != "n_tokens"}), "staged_chunks")
    counted = staged(N.name_frequencies(cut, lexicon, rules), "staged_frequencies")
    wanted = counted if max_candidates is None else N.most_frequent(counted, max_candidates)
    names = staged(R.resolve(wanted, lexicon, cache), "staged_names")
    known = staged(R.compounds(names, keyer), "staged_compounds")
    chunks = annotated(cut, known, lexicon, rules)
    stored = posting_lists(cut)
    return Index(chunks, known, structure_postings(chunks, known), postings=stored, terms=term_counts(cut, stored), frequencies=counted)


def _text_columns() -> dict[str, Column]:
    """What is stored of a passage's text beside it."""
    text = F.col("text")
    return {"n_tokens": F.size(T.tokenize(text)), "head_key": F.md5(F.left(text, F.lit(C.MARKER_CHARACTERS)).cast("binary")), "text_key": F.md5(text.cast("binary"))}


def _extended(chunks: DataFrame) -> DataFrame:
    for name, kind in (("n_tokens", "int"), ("head_key", "string"), ("text_key", "string"), ("extraction_method", "string"), ("table_ocr_id", "string"), ("image_structure_ids", "array<string>")):
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(None).cast(kind))
    return chunks


def _attached(chunks: DataFrame, part: int) -> Column:
    """Ordinals of attached passages, behind those of all pages, of the type that the chunks' ordinals have."""
    kind = chunks.schema["chunk_ord"].dataType
    if not isinstance(kind, StructType):
        raise TypeError("chunk_ord must be an ordinal as chunk_pages makes it")
    return ordinal(part, F.lit(None).cast(kind["page"].dataType), F.col("ord"), F.col("id"))


def attach_structures(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """chunks with one passage for each accepted structure record (id, source_doc, page_number, block, smiles, status, ord), in place of earlier ones."""
    kept = _extended(chunks).where("extraction_method is distinct from 'structure_ocr'")
    accepted = records.where("status = 'accepted' and coalesce(block, '') <> '' and coalesce(smiles, '') <> ''")
    passages = accepted.select(
        _attached(chunks, STRUCTURE_PART).alias("chunk_ord"), "source_doc", F.col("page_number").cast("long").alias("page_number"), F.lit(0).alias("chunk_idx"), F.lit(C.STRUCTURE_PASSAGE).alias("text"), F.lit(False).alias("is_bibliography"),
        F.array().cast("array<string>").alias("compounds"), F.array("block").alias("blocks"), F.lit("structure_ocr").alias("extraction_method"), F.lit(None).cast("string").alias("table_ocr_id"), F.array("id").alias("image_structure_ids"),
    ).withColumns(_text_columns())
    return kept.unionByName(passages.select(*kept.columns))


def attach_tables(chunks: DataFrame, known: DataFrame, report: DataFrame, lexicon: DataFrame, cache: DataFrame | None = None, rules: NameRules = NameRules(), max_names: int | None = None, keyer: Keyer = structure_keys, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, compounds) with one passage for each accepted grid (id, filename, page, status, cells, spanning_rows, ord), in place of earlier ones.

    All names of a table are looked up, or the first ``max_names`` in order, unless the index knows them already.
    With a ``folder`` the names that some list knows are written there first, so that tables are searched once, however often they are read.
    """
    kept = _extended(chunks).where("extraction_method is distinct from 'table_ocr'")
    accepted = report.where("status = 'accepted' and size(cells) > 0").withColumn("body", table_text(F.col("cells"), F.col("spanning_rows")))
    bodies = accepted.select(F.col("id").alias("chunk_ord"), F.col("body").alias("text"))
    found = N.names_found(bodies, lexicon, rules)
    if max_names is not None:
        order = F.row_number().over(Window.partitionBy("chunk_ord").orderBy("name"))
        found = found.withColumn("n", order).where(F.col("n") <= max_names).drop("n")
    # no other name can have a key
    lists = [t.select("name") for t in (known, lexicon, cache) if t is not None]
    found = found.join(sent_if_few(reduce(DataFrame.unionByName, lists).distinct()), "name", "left_semi").select("chunk_ord", "name")
    if folder is not None:
        found.write.mode("overwrite").parquet(folder)
        found = found.sparkSession.read.parquet(folder)
    fresh = R.compounds(R.resolve(found.join(known.select("name"), "name", "left_anti"), lexicon, cache), keyer)
    compounds = known.unionByName(fresh)
    entities = R.chunk_entities(found, compounds).groupBy("chunk_ord").agg(F.sort_array(F.collect_set("name")).alias("compounds"), F.sort_array(F.collect_set("block")).alias("blocks"))
    empty = F.array().cast("array<string>")
    passages = accepted.withColumn("chunk_ord", F.col("id")).join(entities, "chunk_ord", "left").select(
        _attached(chunks, TABLE_PART).alias("chunk_ord"), F.col("filename").alias("source_doc"), F.col("page").cast("long").alias("page_number"), F.lit(0).alias("chunk_idx"), F.concat(F.lit(C.TABLE_PASSAGE), F.col("body")).alias("text"), F.lit(False).alias("is_bibliography"),
        F.coalesce("compounds", empty).alias("compounds"), F.coalesce("blocks", empty).alias("blocks"), F.lit("table_ocr").alias("extraction_method"), F.col("id").alias("table_ocr_id"), F.lit(None).cast("array<string>").alias("image_structure_ids"),
    ).withColumns(_text_columns())
    return kept.unionByName(passages.select(*kept.columns)), compounds


def ocr_candidates(report: DataFrame) -> DataFrame:
    """Records that were tried, accepted or refused; skipped ones aren't kept."""
    return report.where("status <> 'skipped'")
