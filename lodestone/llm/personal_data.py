"""Personal data, and terms that give it away.

Identifiers are found by pattern. Words of the texts that hold them are then weighed by information: with N distinct
texts, an identifier in e of them, a term in t and both in c, the term's pointwise mutual information with the identifier
is log2(c * N / (e * t)), at most the identifier's own information log2(N / e). A term whose share of that reaches
``DISCLOSES`` discloses the identifier, unless chance explains it: c meetings of e and t out of N texts have at most the
probability exp(-e * D(c / e || t / N)), D being the relative entropy in nats. All terms of the corpus are tried with an
identifier, not those alone that stand beside it, which were picked by standing there: terms of 2 ** j texts up to twice as
many are one class, every class gets an equal part of ``CHANCE``, and the probability times the terms of its class must not
exceed that part. So a rare word beside an identifier of one text says little where rare words are many, and much where
they are few. All counts are over the whole corpus, copies of a text counted once. A disclosing term is generalised or removed like the identifiers wherever it
stands, also in texts without any.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rows import cell, packed, unpacked
from lodestone.llm.scratch import materialize
from lodestone.llm.textarrays import ALNUM, groups, words_of

BASE = ("email", "ip", "card", "phone")
TERM = "term"
DISCLOSES = 0.8
#: Bound of the number of terms that an identifier gets by chance.
CHANCE = 0.05
#: Bound of the candidate terms, of the disclosing ones and of the repeated texts' digests that are sent to all tasks, 16 MB
#: (32 MB for digests); beyond it, terms of all texts are joined, and texts are moved to be told apart.
HELD_TERMS = 2_000_000

#: Counts that a task gathers before it passes them on.
TASK_TERMS = 1 << 20

# Patterns that find the same as the base rules. Runs are entered at their first character and never given back, so long
# runs cost no more than their length.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: the local part reaches back to what can't be in it, or to the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), sorted by start and order of kinds."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], BASE.index(x[2])))


def _words(texts: list[bytes | None], spans: list[list[tuple[int, int, str]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: the hashes of its words outside of its spans, with their starts and stops in code points."""
    words = words_of(texts, ALNUM)
    h = words.hashes()
    point = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    for i, own in enumerate(spans):
        part = slice(words.bounds[i], words.bounds[i + 1])
        start, stop = (point[x[part]] - point[words.text_start[i]] for x in (words.start, words.end))
        free = np.ones(len(start), dtype=bool)
        if own:
            covered = np.maximum.accumulate([0, *(b for _, b, _ in own)])
            free = covered[np.searchsorted([a for a, _, _ in own], stop, "left")] <= start
        yield h[part][free], start[free], stop[free]


_FOUND = "content string, identifiers array<string>, terms array<long>"
_SPANS = "doc_id long, spans array<struct<start:bigint,stop:bigint,kind:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))


def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold identifiers, with the distinct hashes of their other words."""
    for batch in batches:
        contents = batch.column("content")
        for part, raw in groups(batch):
            texts = [(t or b"").decode() for t in raw]
            spans = [base_spans(t) for t in texts]
            at = [i for i, own in enumerate(spans) if own]
            if not at:
                continue
            names = [sorted({f"{kind}:{texts[i][a:b].translate(_LOWER)}" for a, b, kind in spans[i]}) for i in at]
            terms = [np.unique(h).view(np.int64) for h, _, _ in _words([raw[i] for i in at], [spans[i] for i in at])]
            content = contents[part].take(pa.array(at))
            yield pa.record_batch([content, pa.array(names, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.int64()))], names=["content", "identifiers", "terms"])


def _held(h: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of the hashes are among the sorted ``held`` ones."""
    return held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h if len(held) else np.zeros(len(h), dtype=bool)


def _spanned(held: np.ndarray | None):
    """Rows (doc_id, spans): identifiers, and words that are among ``held`` or, without it, among the row's own ``terms``."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in groups(batch):
                spans = [base_spans((t or b"").decode()) for t in raw]
                own = [held] * len(raw) if held is not None else [np.sort(np.array(x or [], dtype=np.int64).view(np.uint64)) for x in batch.column("terms")[part].to_pylist()]
                rows = []
                for base, known, (h, start, stop) in zip(spans, own, _words(raw, spans), strict=True):
                    at = _held(h, known)
                    rows.append([{"start": a, "stop": b, "kind": k} for a, b, k in base] + [{"start": a, "stop": b, "kind": TERM} for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)])
                yield pa.record_batch([batch.column("doc_id")[part], pa.array(rows, _SPAN)], names=["doc_id", "spans"])

    return span


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = batch.column("content")
        for part, raw in groups(batch):
            terms = [np.unique(h) for h, _, _ in _words(raw, [[]] * len(raw))]
            at = np.repeat(np.arange(len(raw)), [len(t) for t in terms])
            yield pa.record_batch([contents[part].take(pa.array(at)), pa.array(np.concatenate(terms).view(np.int64))], names=["content", "h"])


def _term_counts(held: np.ndarray | None, copies: tuple[np.ndarray, np.ndarray]):
    """Rows (term, texts): of each word, by its hash, how many texts of a task hold it; of ``held`` words only, if given.

    ``copies`` are sorted digests of texts that stand in several rows, and the numbers of these rows; such a row counts as
    a part of one text.
    """

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        term, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        return term, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(term))

    def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        term, n = summed(parts)
        return pa.record_batch([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "texts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            digests = batch.column("copy").to_numpy(zero_copy_only=False)
            for part, texts in groups(batch):
                weight = np.ones(len(texts))
                known = _held(digests[part], copies[0])
                weight[known] = 1 / copies[1][np.searchsorted(copies[0], digests[part][known])]
                words = words_of(texts, ALNUM)
                h, text = words.hashes(), np.repeat(np.arange(len(texts)), words.counts())
                if held is not None:
                    known = _held(h, held)
                    h, text = h[known], text[known]
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                first = np.ones(len(h), dtype=bool)
                first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                parts.append(summed([(h[first], weight[text[first]])]))
                if sum(len(t) for t, _ in parts) > TASK_TERMS:
                    parts = [summed(parts)]
                    if len(parts[0][0]) > TASK_TERMS // 2:
                        yield rows(parts)
                        parts = []
        if parts:
            yield rows(parts)

    return count


def _sent(terms: DataFrame) -> Broadcast | None:
    """The sorted hashes of a table of distinct terms for all tasks, unless there are too many."""
    if terms.count() > HELD_TERMS:
        return None
    held = np.sort(terms.select("h").toArrow().column("h").to_numpy().view(np.uint64))
    return terms.sparkSession.sparkContext.broadcast(held)


def _entropy(share: Column, chance: Column) -> Column:
    """Relative entropy of two shares in nats; 0 * log(0) is 0."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    return part(share, chance) + part(1 - share, 1 - chance)


def _class(t: Column) -> Column:
    """j of 2 ** j <= t < 2 ** (j + 1)."""
    return F.length(F.bin(t.cast("long"))) - 1


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(h): the hashes of terms that reach the thresholds with an identifier, from the distinct identified texts and the corpus."""
    # texts that stand in one row needn't be moved to be told apart; of the others the digests are sent, unless there are too many
    contents = materialize(docs.groupBy(F.xxhash64("content").alias("copy")).agg(F.count("*").alias("n")), "contents")
    total = contents.count()
    repeated, rows = contents.where("n > 1"), docs.select(F.xxhash64("content").alias("copy"), "text")
    if repeated.count() > HELD_TERMS:
        repeated, rows = repeated.limit(0), rows.dropDuplicates(["copy"])
    found_twice = repeated.orderBy("copy").toArrow()
    copies = docs.sparkSession.sparkContext.broadcast(tuple(found_twice.column(x).to_numpy() for x in ("copy", "n")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _term_counts(None, copies.value)(batches)

    df = materialize(rows.mapInArrow(count, "h long, texts double").groupBy("h").agg(F.round(F.sum("texts")).alias("t")), "term-texts")
    sizes = {r["j"]: r["n"] for r in df.groupBy(_class(F.col("t")).alias("j")).agg(F.count("*").alias("n")).collect()}
    # a class for each power of two up to the number of texts
    need = F.try_element_at(F.create_map(*[F.lit(x) for j, n in sizes.items() for x in (j, math.log(n * len(sizes) / CHANCE))]), _class(F.col("t"))) if sizes else F.lit(0.0)
    df = df.withColumn("need", need)

    held = found.select("content", F.explode("identifiers").alias("identifier")).withColumn("identifier", F.xxhash64("identifier"))
    texts = materialize(held.groupBy("identifier").agg(F.count("*").alias("e")), "identifiers")
    near = held.join(texts, "identifier")
    # an identifier and a term that meet in one text reach log(n / t) nats at most, which few terms need no more than: a long
    # list of identifiers that stand nowhere else is paired with these alone
    once = df.where(F.log(F.lit(float(max(total, 1))) / F.col("t")) >= F.col("need") - 1e-9).select("h")
    terms = found.select("content", F.explode("terms").alias("h"))
    tried = near.where("e = 1").join(terms.join(once, "h"), "content").unionByName(near.where("e > 1").join(terms, "content")).select("identifier", "e", "h")
    # c is at most e, so the information of a more common term can't reach the share; the rest is few rows
    most = F.pow(F.lit(float(total)), 1 - DISCLOSES) * F.pow("e", DISCLOSES) * 1.001
    pairs = tried.join(df, "h").where(F.col("t") <= most).groupBy("identifier", "h").agg(F.count("*").alias("c"), F.first("t").alias("t"), F.first("e").alias("e"), F.first("need").alias("need"))
    own = F.log2(F.lit(float(total)) / F.col("e"))
    shared_bits = F.log2(F.col("c") * float(total) / (F.col("e") * F.col("t")))
    # the same bound holds with the identifier's and the term's texts exchanged
    e, t, c = (F.col(x).cast("double") for x in "etc")
    rare = F.greatest(e * _entropy(c / e, t / total), t * _entropy(c / t, e / total)) >= F.col("need")
    return pairs.where((own > 0) & (shared_bits >= DISCLOSES * own) & rare).select("h").distinct()


def private_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of (doc_id, text, ...): (start, stop, kind) in code points, the identifiers and the terms that disclose any.

    Null and empty texts have no spans. Spans depend on a text and the corpus alone, so repeated rows have equal spans, and
    rows without an id have theirs. Very long texts are read whole, one at a time; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("content", F.md5("text"))
    found = materialize(docs.select("content", "text").mapInArrow(_identified, _FOUND).dropDuplicates(["content"]), "identified")
    terms = materialize(disclosing(found, docs), "disclosing")
    shared = _sent(terms)
    rows = docs.select("doc_id", "text")
    if not shared:
        own = docs.select("content", "text").mapInArrow(_distinct_words, "content string, h long").join(terms, "h").groupBy("content").agg(F.collect_set("h").alias("terms"))
        rows = docs.join(own, "content", "left").select("doc_id", "text", "terms")

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _spanned(shared.value if shared else None)(batches)

    return rows.mapInArrow(span, _SPANS)


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, of all base spans and of all spans, the digest of the base ones and all spans as text."""
    order = F.array(*[F.lit(k) for k in (*BASE, TERM)])
    ranked = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("rank"), x["stop"].alias("stop"), x["kind"].alias("kind")))
    rows = spans.select("doc_id", F.sort_array(ranked).alias("spans"))

    def joined(kinds):
        return F.array_join(F.transform(F.filter("spans", lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    of_base = F.size(F.filter("spans", lambda x: x["kind"].isin(*BASE))).cast("long")
    return rows.select("doc_id", *[n(k) for k in BASE], of_base.alias("n_base"), F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(BASE), 256).alias("base_sha256"), joined((*BASE, TERM)).alias("spans"))


def sanitised(docs: DataFrame, generalise: bool = True) -> DataFrame:
    """``docs`` with private spans replaced by their kind in brackets, or removed; of overlapping spans the first stands, of those that start together the longest. Null texts stay null."""
    digest = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    spans = private_spans(docs.select(digest.alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("digest")).agg(F.first("spans").alias("spans")).where(F.size("spans") > 0)

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans, strict=True):
            if own is None:
                out.append(t)
                continue
            parts, at = [], 0
            for s in sorted(own, key=lambda s: (s["start"], -s["stop"])):
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[{s['kind'].upper()}]" if generalise else ""]
                    at = s["stop"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out)

    rows = packed(docs, digest=digest).join(spans, "digest", "left")
    return unpacked(rows, docs.columns, text=cut(cell("text"), F.col("spans")))
