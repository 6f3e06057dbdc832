"""Secret scans over a ledger of blobs, in DataFrame functions only.

Every historical version of a file is content-addressed; only pairs of blob and rule version that the ledger doesn't
hold are scanned, once for all paths, and findings are joined back to all paths that hold the blob. A rule's version is a
digest of all that it says, so a changed rule is a new one, and rules that stayed aren't run again.

Positions of matches come from two lists of equal order: the matches themselves, and the stretches between them, which
splitting by the same pattern gives. Running sums of their lengths are the offsets in code points.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import new_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the pattern whose group has ``least`` characters or more; others are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


# Fixed patterns: the three base kinds, then well-known token formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36}", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 27),
)
BASE = ("assign", "access", "hex")
#: Characters of a token's parts.
_RUN = "[A-Za-z0-9_-]"
_FINDING = "blob string, rule string, start long, stop long"


def _search(rule: Rule) -> str:
    """The pattern in a form that finds the same in one pass.

    Short hexadecimal runs are most of all text, so the least length of a run goes inside. A token in three parts may begin
    at many places of a run: a run is looked at once, from its first character, for all that must follow it, and given up
    whole; its match begins there, and what precedes the token, ``_lead``, is taken off again.
    """
    if rule.kind == "hex":
        return rf"[0-9a-f]{{{rule.least},}}"
    if rule.kind == "jwt":
        return rf"(?<!{_RUN})(?={_RUN}++\.eyJ{_RUN}{{8,}}+\.{_RUN}{{8}}){_RUN}*?eyJ{_RUN}{{8,}}+\.eyJ{_RUN}{{8,}}+\.{_RUN}{{8,}}+"
    return rule.pattern


def _lead(rule: Rule, match: Column) -> Column:
    """Characters of a match of ``_search`` that stand before the rule's own."""
    return F.length(F.regexp_extract(match, rf"^({_RUN}*?)eyJ{_RUN}{{8,}}+\.", 1)) if rule.kind == "jwt" else F.lit(0)


def _hits(rule: Rule, rank: int) -> Column:
    """A rule's matches in the column m_<kind>, with the stretch of text before each."""
    found = F.col(f"m_{rule.kind}")

    def row(x: Column, i: Column) -> Column:
        checked = F.regexp_extract(x["match"], rule.pattern, rule.group) if rule.group else x["match"]
        lead = _lead(rule, x["match"])
        return F.struct(F.lit(rank).alias("rank"), i.alias("i"), (F.length(x["gap"]) + lead).cast("long").alias("gap"), (F.length(x["match"]) - lead).cast("long").alias("n"), (F.length(checked) >= rule.least).alias("ok"))

    gaps = F.slice(F.split("text", _search(rule)), F.lit(1), F.size(found))
    rows = F.transform(F.arrays_zip(found.alias("match"), gaps.alias("gap")), row)
    return F.when(F.size(found) > 0, rows).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:bigint,n:bigint,ok:boolean>>"))


def found_in(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, start, stop) of all matches in (blob, text, unseen); ``unseen`` lists the versions of the rules to try."""
    for rule in rules:
        matches = F.regexp_extract_all("text", F.lit(_search(rule)), F.lit(0))
        texts = texts.withColumn(f"m_{rule.kind}", F.when(F.array_contains("unseen", rule.version), matches).otherwise(F.array().cast("array<string>")))
    hits = [_hits(rule, rank) for rank, rule in enumerate(rules)]
    rows = texts.select("blob", F.concat(*hits).alias("hits")).where(F.size("hits") > 0).dropDuplicates(["blob"]).select("blob", F.explode("hits").alias("hit")).select("blob", "hit.*")
    so_far = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("stop", F.sum(F.col("gap") + F.col("n")).over(so_far)).where("ok")
    version = F.element_at(F.array(*[F.lit(r.version) for r in rules]), F.col("rank") + 1)
    return ends.select("blob", version.alias("rule"), (F.col("stop") - F.col("n")).alias("start"), "stop")


class BlobLedger:
    """Scanned pairs and findings, as two tables under ``path``, both only added to.

    Findings are written before the pairs that they belong to: after a crash in between, the next scan finds the same
    again, and readers drop the repeats.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        """(blob, rules): versions of the rules that a scan tried on a blob; a blob has a row for each scan that met it with new rules."""
        return self._read("scanned", "blob string, rules array<string>")

    def findings(self, blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, rule, start, stop) of some blobs (blob) and rules. Other blobs of the history drop out before anything is gathered."""
        own = self._read("findings", _FINDING).where(F.col("rule").isin(*[r.version for r in rules]))
        return own.join(blobs.select("blob").distinct(), "blob", "left_semi").distinct()

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is new in ``versions`` (doc_id, text) and return (doc_id, blob) of all of them. A null text is an empty blob."""
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        paths = versions.select("doc_id", F.sha2(text, 256).alias("blob"))
        wanted = F.array(*[F.lit(r.version) for r in rules])
        batch = paths.groupBy("blob").agg(F.min("doc_id").alias("first_id"))
        seen = self.scanned().join(batch.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))
        unseen = F.array_except(wanted, F.coalesce("rules", F.array().cast("array<string>")))
        first = batch.join(seen, "blob", "left").select("blob", "first_id", unseen.alias("unseen")).where(F.size("unseen") > 0)
        # by content as well as by id: ids may be null or repeat, and then id alone would pair every such row with every other.
        # The text depends on both sides, so the optimizer can't move the scan below the join, where it would meet all versions
        held = versions.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("own"))
        whole = held.join(first, (F.col("own") == F.col("blob")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("blob", "unseen", F.when(F.col("own") == F.col("blob"), F.col("text")).alias("text"))
        found_in(whole, rules).write.mode("append").parquet(f"{self.path}/findings")
        first.select("blob", F.col("unseen").alias("rules")).write.mode("append").parquet(f"{self.path}/scanned")
        return paths


def secrets(docs: DataFrame, ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of (doc_id, text, ...).

    Spans are kind:start:end by start, then by order of the rules. Texts without secrets, empty and null ones have
    no spans; rows that repeat an id or a text each get a row, and null ids are kept. Very long texts are matched whole, by
    the built-in functions, one row at a time. Without a ledger a new one is begun, and everything is unseen.
    """
    ledger = ledger or BlobLedger(docs.sparkSession, new_path(docs.sparkSession, "ledger"))
    paths = ledger.scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules)
    ranks = F.array(*[F.lit(r.version) for r in rules])
    rank = (F.array_position(ranks, F.col("rule")) - 1).cast("int")
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    named = ledger.findings(paths, rules).withColumn("rank", rank).select("blob", "start", "rank", kind.alias("kind"), "stop")
    by_blob = named.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "stop"))).alias("found"))
    rows = paths.join(by_blob, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:bigint,rank:int,kind:string,stop:bigint>>")))

    def joined(found):
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def of(kinds):
        return F.filter("found", lambda x: x["kind"].isin(*kinds))

    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(of(BASE)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL, from the same rules."""
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        checked = f"regexp_extract(m[i], '{pattern}', {rule.group})"
        parts.append(
            f"select doc_id, {rank} as rank, '{rule.kind}' as kind, i, m, g, length({checked}) >= {rule.least} as ok from "
            f"(select doc_id, m, g, unnest(range(1, len(m) + 1)) as i from (select doc_id, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as g from d))"
        )
    return (
        "with d as (select doc_id, coalesce(text, '') as t from documents), hits as (" + " union all ".join(parts) + "), "
        "placed as (select doc_id, rank, kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start, length(m[i]) as n from hits where ok), "
        "named as (select doc_id, rank, kind, start, kind || ':' || cast(start as bigint) || ':' || cast(start + n as bigint) as span from placed), "
        "by_doc as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, "
        "string_agg(span, ',' order by start, rank) filter (rank < 3) as base, string_agg(span, ',' order by start, rank) as spans from named group by doc_id) "
        "select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans "
        "from d left join by_doc using (doc_id)"
    )
