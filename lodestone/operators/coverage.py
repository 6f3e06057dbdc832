"""What the structure route reaches that names don't, and library statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.sizes import sent_if_few
from lodestone.operators.rank import postings_of

#: Names that a scan of texts tries as literals of its plan; more meet the passages that hold their tokens by a join.
NAMES_IN_SCAN = 64
#: What a pattern of any case takes for i and s, but lower case leaves as it is.
_ALIKE = ("\u0131", "\u017f")


def _listed(names: DataFrame, pattern) -> list[tuple[str, str]]:
    """The distinct names, in order, each with its pattern. They are the spellings of one structure, no more than an index resolves."""
    return [(r.name, r.pattern) for r in names.select("name", pattern(F.col("name")).alias("pattern")).distinct().orderBy("name").collect()]


def name_hits(chunks: DataFrame, names: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(name, chunk_ord) of literal whole-word finds.

    Each chunk is read once and tried against all names, as patterns that are literals of the plan and compiled once. With
    ``stored`` postings only chunks that hold every token of a name are tried, and only against that name: a whole-word
    find has all tokens of the name. Names without tokens are tried on all chunks.
    """
    if stored is None:
        return _tried(chunks, _listed(names, T.exact_name_pattern))
    tokens = names.select("name").distinct().select("name", F.array_distinct(T.tokenize(F.col("name"))).alias("tokens"))
    bare = tokens.where(F.size("tokens") == 0)
    asked = sent_if_few(tokens.select("name", F.size("tokens").alias("n"), F.explode("tokens").alias("term")))
    holding = postings_of(stored, asked).select("term", "chunk_ord").join(asked, "term").groupBy("name", "n", "chunk_ord").agg(F.count("*").alias("found")).where("found = n")
    exact = holding.join(chunks.select("chunk_ord", "text"), "chunk_ord").withColumn("pattern", T.exact_name_pattern(F.col("name"))).where("rlike(text, pattern)").select("name", "chunk_ord")
    listed = _listed(bare, T.exact_name_pattern)
    return exact.unionByName(_tried(chunks, listed)) if listed else exact


def _found(chunks: DataFrame, names: DataFrame, most: int | None = None) -> tuple[list[str], DataFrame] | None:
    """The distinct names in order, and chunks with ``found``, whether each of them stands there; none for more than ``most`` names.

    A pattern is tried where the name's tokens are, by plain searches. No text is moved, and postings would save no read of it.
    """
    most = NAMES_IN_SCAN if most is None else most
    asked = names.where("name is not null").select("name", T.exact_name_pattern(F.col("name")).alias("pattern"), F.array_distinct(T.tokenize(F.col("name"))).alias("tokens"))
    listed = asked.distinct().orderBy("name").limit(most + 1).collect()
    if len(listed) > most:
        return None
    text, low = F.col("text"), F.lower("text")
    odd = reduce(Column.__or__, [text.contains(c) for c in _ALIKE])
    tests = [(reduce(Column.__and__, [low.contains(t) for t in r.tokens], F.lit(True)) | odd) & text.rlike(r.pattern) for r in listed]
    return [r.name for r in listed], chunks.withColumn("found", F.array(*tests) if tests else F.array().cast("array<boolean>"))


def _tried(chunks: DataFrame, listed: list[tuple[str, str]]) -> DataFrame:
    found = F.array(*[F.when(F.col("text").rlike(pattern), F.lit(name)) for name, pattern in listed]) if listed else F.array().cast("array<string>")
    return chunks.select("chunk_ord", F.explode(F.array_compact(found)).alias("name")).select("name", "chunk_ord")


def name_counts(chunks: DataFrame, names: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(name, n_chunks, is_registry_number) of every name, also those found nowhere. Up to ``NAMES_IN_SCAN`` are counted in one scan of the texts."""
    tried = _found(chunks, names)
    if tried is None:
        counts = name_hits(chunks, names, stored).groupBy("name").agg(F.count("*").alias("n_chunks"))
    else:
        counts = tried[1].agg(_counts(tried[0]).alias("counts")).select(F.inline("counts"))
    return names.select("name").distinct().join(counts, "name", "left").select("name", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"), T.is_registry_number(F.col("name")).alias("is_registry_number"))


def _counts(names: list[str]) -> Column:
    """(name, n_chunks) of each name, from ``found``."""
    counts = [F.struct(F.lit(n).alias("name"), F.count_if(F.get("found", F.lit(i))).alias("n_chunks")) for i, n in enumerate(names)]
    return F.array(*counts) if counts else F.array().cast("array<struct<name:string,n_chunks:bigint>>")


def query_names(known: DataFrame, block: str, extra: str | None = None) -> DataFrame:
    """Names of the structure, and the user's own unless it is one of them but for case."""
    names = known.where(F.col("block") == block).select("name").distinct()
    if not extra:
        return names
    own = names.sparkSession.createDataFrame([(extra,)], "name string")
    return names.unionByName(own.join(names.select(F.lower("name").alias("low")), F.lower("name") == F.col("low"), "left_anti"))


def _flags(chunks: DataFrame, names: DataFrame, block: str, stored: DataFrame | None = None) -> DataFrame:
    """chunks with ``structured`` and ``named``."""
    structure = F.array_contains("blocks", block)
    if (tried := _found(chunks, names)) is not None:
        return tried[1].withColumn("structured", structure).withColumn("named", F.array_contains("found", True)).drop("found")
    found = name_hits(chunks, names, stored).select("chunk_ord").distinct().withColumn("named", F.lit(True))
    return chunks.withColumn("structured", structure).join(found, "chunk_ord", "left").withColumn("named", F.coalesce("named", F.lit(False)))


def reach_report(chunks: DataFrame, known: DataFrame, block: str, extra: str | None = None, stored: DataFrame | None = None) -> DataFrame:
    """One row: chunks by structure, by any name, by one route alone, and the best single name."""
    names = query_names(known, block, extra)
    structured, named = F.col("structured"), F.col("named")
    flags = [F.count_if(structured).alias("n_structure"), F.count_if(named).alias("n_union"), F.count_if(structured & ~named).alias("adds"), F.count_if(named & ~structured).alias("misses")]
    if (tried := _found(chunks, names)) is not None:
        listed, held = tried
        rows = held.select("found", F.array_contains("blocks", block).alias("structured"), F.array_contains("found", True).alias("named"))
        # of equal counts the first name
        best = F.array_min(F.transform("counts", lambda c: F.struct((-c["n_chunks"]).alias("less"), c["name"].alias("name"))))
        sums = rows.agg(*flags, _counts(listed).alias("counts")).withColumn("best", best)
        return sums.select("n_structure", "n_union", "adds", "misses", F.lit(len(listed)).cast("long").alias("n_names"), F.col("best.name").alias("best_name"), (-F.col("best.less")).alias("best_count"))
    counts = name_counts(chunks, names, stored)
    total = counts.agg(F.count("*").alias("n_names"))
    top = counts.orderBy(F.desc("n_chunks"), "name").limit(1).select(F.col("name").alias("best_name"), F.col("n_chunks").alias("best_count"))
    sums = _flags(chunks, names, block, stored).agg(*flags)
    return sums.crossJoin(F.broadcast(total)).join(F.broadcast(top), F.lit(True), "left")


def unreachable(chunks: DataFrame, known: DataFrame, block: str, extra: str | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(chunk_ord, source_doc, page_number, fragment, snippet) of chunks that only the structure finds; the fragment is a name that the page had split."""
    names = query_names(known, block, extra)
    alone = _flags(chunks, names, block, stored).where("structured and not named")
    # names in order: the first whose letters stand there, however they are parted, gives the fragment
    loose = [p for _, p in _listed(known.where(F.col("block") == block), T.loose_pattern)]
    fragment, start = F.lit(None).cast("string"), F.lit(None).cast("int")
    if loose:
        fragment = F.coalesce(*[F.nullif(F.regexp_substr("text", F.lit(p)), F.lit("")) for p in loose])
        start = F.coalesce(*[F.nullif(F.regexp_instr("text", F.lit(p)), F.lit(0)) for p in loose])
    found = alone.withColumn("fragment", fragment).withColumn("start", start)
    return found.select("chunk_ord", "source_doc", "page_number", "fragment", T.snippet(F.col("text"), F.coalesce("start", F.lit(0)), F.coalesce(F.length("fragment"), F.lit(0))).alias("snippet"))


def set_difference(chunks: DataFrame, name: str | Column, block: str, stored: DataFrame | None = None) -> DataFrame:
    """One row (recovered, shared, text_only) of the structure's chunks against those of one literal name."""
    names = chunks.sparkSession.createDataFrame([(name,)], "name string")
    flags = _flags(chunks, names, block, stored)
    return flags.agg(F.count_if(F.expr("structured and not named")).alias("recovered"), F.count_if(F.expr("structured and named")).alias("shared"), F.count_if(F.expr("named and not structured")).alias("text_only"))


def library_stats(chunks: DataFrame) -> DataFrame:
    """(source_doc, n_passages, n_pages)."""
    return chunks.groupBy("source_doc").agg(F.count("*").alias("n_passages"), F.countDistinct("page_number").alias("n_pages"))


def index_totals(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """One row of the index's sizes."""
    totals = chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.size("blocks") > 0).alias("n_annotated"), F.count_if("is_bibliography").alias("n_bibliography"))
    return totals.crossJoin(F.broadcast(known.agg(F.count("*").alias("n_names"), F.countDistinct("block").alias("n_blocks"))))
