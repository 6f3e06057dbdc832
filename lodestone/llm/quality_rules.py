"""Quality rules, the cross-document line-frequency rule among them, in DataFrame functions only.

A document is reduced to counters and to one (hash, words) pair for each normalised line; everything that crosses
documents works on these pairs. A line is counted once for each distinct content of a host, so copies of one document
don't make its own lines frequent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rows import cell, packed, unpacked
from lodestone.llm.scratch import materialize

BLANKS = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """A line is boilerplate of a host when more than ``line_documents`` distinct documents hold it, however large the host
    is; a ``line_share`` above 0 asks for more than that share of the host's documents too. A document whose removed lines
    hold more than ``removed_share`` of its words is depleted. ``min_words`` and ``repeat_percent`` are the base rule."""

    line_documents: int = 10
    line_share: float = 0.0
    removed_share: float = 0.5
    min_words: int = 50
    repeat_percent: int = 50


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def normalised(line: Column) -> Column:
    """Lower case, every digit as 0, blanks as single spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(line, F.lit(BLANKS))), r"[0-9]", "0"), GAP, " ")


def _repeated(windows: Column) -> Column:
    """Of windows sorted by (hash, position): the positions of those found twice or more."""
    def at(e: Column, k: Column) -> Column:
        twin = (e["h"] == F.get(windows, k - 1)["h"]) | (e["h"] == F.get(windows, k + 1)["h"])
        return F.when(F.coalesce(twin, F.lit(False)), e["i"])

    return F.sort_array(F.array_compact(F.transform(windows, at)))


def measured(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, host, content (a digest), counters of the base rules, and its lines as (h, n) pairs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    word = _words(F.col("text"))
    spoken = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    rows = rows.select("doc_id", "host", F.md5("text").alias("content"), "text", word.alias("words"), spoken.alias("spoken"))
    line = F.transform("spoken", lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(_words(x)).cast("long").alias("n")))
    three = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))))
    rows = rows.select(
        "doc_id", "host", "content",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.coalesce(three, F.array().cast("array<struct<h:bigint,i:int>>"))).alias("windows"),
        line.alias("lines"),
    )
    rows = rows.withColumn("repeated", _repeated(F.col("windows"))).drop("windows")
    covered = F.aggregate("repeated", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return rows.withColumn("n_repeat_words", covered).drop("repeated")


def frequent_lines(measures: DataFrame, limits: Limits) -> DataFrame:
    """(host, h) of the lines above the limits."""
    distinct = measures.select("host", "content", "lines").dropDuplicates(["host", "content"])
    lines = distinct.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    above = lines.where(F.col("n") > limits.line_documents)
    if limits.line_share <= 0:
        return above.select("host", "h")
    hosts = measures.groupBy("host", "content").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("documents"))
    return above.join(hosts, "host").where(F.col("n") > limits.line_share * F.col("documents")).select("host", "h")


def judged(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each row of (doc_id, text, source, ...): counters, base_failed, n_removed_words, removed (hashes of the lines to
    remove), kept, and host and content as keys. Null texts count as empty and fail; a null source is a host of its own.
    Repeated rows and null ids get a row each; very long texts are measured whole, one row at a time; no rows give no rows."""
    measures = materialize(measured(docs), "measures")
    frequent = frequent_lines(measures, limits)
    distinct = measures.select("host", "content", "lines").dropDuplicates(["host", "content"]).select("host", "content", F.explode("lines").alias("line"))
    # written, so that the join deals both sides anew and a content of many copies can be split over tasks
    removed = materialize(
        distinct.select("host", "content", F.col("line.h").alias("h"), F.col("line.n").alias("n")).join(frequent, ["host", "h"])
        .groupBy("host", "content").agg(F.sum("n").alias("n_removed_words"), F.sort_array(F.collect_set("h")).alias("removed")), "removed"
    )
    base = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    rows = measures.drop("lines").join(removed, ["host", "content"], "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long"))).withColumn("base_failed", base)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= limits.removed_share * F.col("n_words")))


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, without their frequent lines; ``n_chars``, where present, follows the new text.

    Null and empty texts fail. Rows that repeat a host and text share the verdict, whatever their ids.
    """
    verdicts = materialize(judged(docs, limits).where("kept").groupBy("host", "content").agg(F.first("removed").alias("removed")), "verdicts")
    keyed = packed(docs, host=F.coalesce(F.col("source").cast("string"), F.lit("\x00")), content=F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = keyed.join(verdicts, ["host", "content"])
    stays = F.array_join(F.filter(F.split(cell("text"), "\n"), lambda x: ~F.array_contains("removed", F.xxhash64(normalised(x)))), "\n")
    changed = {"text": F.when(F.col("removed").isNull(), cell("text")).otherwise(stays)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("removed").isNull(), cell("n_chars")).otherwise(F.length(stays).cast("long"))
    return unpacked(found, docs.columns, **changed)
