"""Benchmark decontamination by winnowing.

Of every run of ``WINDOW`` consecutive k-grams the smallest hash is kept as a fingerprint, on both sides, so any shared
span of ``SPAN`` = GRAM + WINDOW - 1 words has a fingerprint in common. Seeds, where a text's fingerprint is also one of
the benchmark's, are extended to all spans that contain them, and each span is verified. Items of fewer words than a
span are one window of their own length; for those lengths every gram is kept.

A benchmark of up to ``INDEX_BYTES`` bytes in ``INDEX_ITEMS`` rows is indexed in memory and sent to the tasks, and texts
don't move. A larger one is joined by fingerprints and by spans; the results are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.rows import packed, unpacked
from lodestone.llm.scratch import materialize
from lodestone.llm.textarrays import ALNUM, gram_hashes, groups, mix, words_of

SPAN = 13
GRAM = 8
WINDOW = SPAN - GRAM + 1
#: Bounds of the benchmark that is held in memory, texts and ids together; a word has a byte at least and takes about 100 in the index.
INDEX_BYTES, INDEX_ITEMS = 8_000_000, 200_000
#: contaminated: at least one hit word, and SHARE * hit words >= words.
SHARE = 20


def fingerprints(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the fingerprints of a run of word hashes: the smallest gram of each window, the last on ties."""
    grams = gram_hashes(word, GRAM)
    if len(grams) < WINDOW:
        return np.zeros(0, dtype=np.int64), grams[:0]
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    at = np.unique(np.arange(len(views)) + (WINDOW - 1 - np.argmin(views[:, ::-1], axis=1)))
    return at, grams[at]


def spans_at(word: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the SPAN words from each start; the same figures that gram_hashes gives."""
    total = np.full(len(start), SPAN, dtype=np.uint64)
    for j in range(SPAN):
        total = total * np.uint64(0x2545F4914F6CDD1D) + word[start + j]
    return mix(total)


@dataclass
class Index:
    """Fingerprints of the long items, and for every window length the sorted hashes with the items that hold each."""

    names: list[str]
    seeds: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[str, bytes | None]]) -> Index:
        names = sorted({name for name, _ in items})
        rank = {name: i for i, name in enumerate(names)}
        words = words_of([text for _, text in items], ALNUM)
        word, seeds, found = words.hashes(), [np.zeros(0, dtype=np.uint64)], {}
        for (name, _), a, b in zip(items, words.bounds[:-1], words.bounds[1:], strict=True):
            own = word[a:b]
            if len(own):
                n = min(SPAN, len(own))
                found.setdefault(n, []).append((gram_hashes(own, n), rank[name]))
                seeds.append(fingerprints(own)[1])
        index = cls(names, np.unique(np.concatenate(seeds)))
        for n, parts in found.items():
            hashes = np.concatenate([h for h, _ in parts])
            item = np.concatenate([np.full(len(h), i) for h, i in parts])
            pairs = np.unique(np.rec.fromarrays([hashes, item], names="h,i"))
            keys, first = np.unique(pairs.h, return_index=True)
            index.windows[n] = (keys, np.append(first, len(pairs)), pairs.i.astype(np.int64))
        return index


def member(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index in sorted keys of each value, -1 where it is absent."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _scan(texts: list[bytes | None], index: Index) -> tuple[list[int], list[int], list[list[int]]]:
    """Words, hit words and item ranks of each text."""
    words = words_of(texts, ALNUM)
    word, bounds = words.hashes(), words.bounds
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    cover = np.zeros(len(word) + 1, dtype=np.int64)
    held = []
    for n, (keys, first, item) in index.windows.items():
        if n == SPAN:
            at, seed = fingerprints(word)
            at = at[member(index.seeds, seed) >= 0]
            start = np.unique(np.concatenate([at - j for j in range(WINDOW)]) if len(at) else at)
            start = start[(start >= 0) & (start + n <= len(word))]
            found = member(keys, spans_at(word, start))
        else:
            start = np.arange(max(0, len(word) - n + 1))
            found = member(keys, gram_hashes(word, n))
        keep = found >= 0
        keep[keep] = text_of[start[keep]] == text_of[start[keep] + n - 1]
        start, found = start[keep], found[keep]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + n, -1)
        for text, window in set(zip(text_of[start].tolist(), found.tolist(), strict=True)):
            held.append((text, item[first[window] : first[window + 1]]))
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    items: list[set[int]] = [set() for _ in texts]
    for text, more in held:
        items[text].update(more.tolist())
    return np.diff(bounds).tolist(), np.diff(hit[bounds]).tolist(), [sorted(x) for x in items]


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def _fits(benchmark: DataFrame) -> bool:
    held = benchmark.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.octet_length("item_id"))).first()
    return held[0] <= INDEX_ITEMS and (held[1] or 0) <= INDEX_BYTES


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")


def _index(benchmark: DataFrame) -> Index:
    return Index.of([(x.item_id, (x.text or "").encode()) for x in benchmark.sort("item_id", "text").collect()])


def contamination(docs: DataFrame, benchmark: DataFrame, in_memory: bool | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of (doc_id, text, ...).

    Null and wordless texts have no words and no hits. Items without words or without an id match nothing; several rows
    of one item_id count as one item, and items of equal texts all count. Repeated documents and null ids each get a row.
    Texts are read whole, in groups of bounded size or one at a time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    if in_memory is None:
        in_memory = _fits(items)
    if not in_memory:
        return _joined(docs, items)
    index = docs.sparkSession.sparkContext.broadcast(_index(items))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in groups(batch):
                n, hit, ranks = _scan(texts, index.value)
                names = [[index.value.names[r] for r in x] for x in ranks]
                bad = [h > 0 and SHARE * h >= w for w, h in zip(n, hit, strict=True)]
                yield pa.record_batch([batch.column("doc_id")[part], pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([_digest(x) for x in names], pa.string()), pa.array(bad, pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.mapInArrow(scan, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _window_rows(lengths: list[int], seeds_only: bool):
    """Rows (key, n, start, h) of texts: fingerprints as n = 0 and all grams of the short lengths, or every window of the lengths."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in groups(batch):
                keys = batch.column("key")[part].to_pylist()
                words = words_of(texts, ALNUM)
                word = words.hashes()
                for key, a, b in zip(keys, words.bounds[:-1], words.bounds[1:], strict=True):
                    own = word[a:b]
                    parts = [(0, *fingerprints(own))] if seeds_only else []
                    parts += [(n, np.arange(max(0, len(own) - n + 1)), gram_hashes(own, n)) for n in lengths if not (seeds_only and n == SPAN)]
                    for n, start, h in parts:
                        yield pa.record_batch([pa.array([key] * len(h), pa.string()), pa.array(np.full(len(h), n), pa.int32()), pa.array(start.astype(np.int32)), pa.array(h.view(np.int64))], names=["key", "n", "start", "h"])

    return rows


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (n, h, item_id) of items: fingerprints as n = 0, and windows."""
    for batch in batches:
        for part, texts in groups(batch):
            words = words_of(texts, ALNUM)
            word = words.hashes()
            for name, a, b in zip(batch.column("item_id")[part].to_pylist(), words.bounds[:-1], words.bounds[1:], strict=True):
                own = word[a:b]
                if len(own):
                    for n, h in ((0, fingerprints(own)[1]), (min(SPAN, len(own)), gram_hashes(own, min(SPAN, len(own))))):
                        yield pa.record_batch([pa.array(np.full(len(h), n), pa.int32()), pa.array(h.view(np.int64)), pa.array([name] * len(h), pa.string())], names=["n", "h", "item_id"])


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same by joins, whatever the size of the benchmark. Results depend on the text alone, so each text is worked on once, under its digest."""
    window = materialize(items.mapInArrow(_item_rows, "n int, h long, item_id string").distinct(), "windows")
    lengths = sorted(x.n for x in window.select("n").distinct().collect() if x.n)
    keyed = docs.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    seeds = keyed.select("key", "text").mapInArrow(_window_rows(lengths, True), "key string, n int, start int, h long").select("key", "n", "h").distinct()
    seeded = seeds.join(window.where(f"n < {SPAN}").select("n", "h").distinct(), ["n", "h"], "left_semi").select("key").distinct()
    texts = keyed.join(seeded, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    found = materialize(texts.mapInArrow(_window_rows(lengths, False), "key string, n int, start int, h long").join(window.where("n > 0").select("n", "h").distinct(), ["n", "h"], "left_semi"), "hits")
    cover = F.aggregate(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))), F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(F.greatest(a["to"], x["stop"]).alias("to"), (a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["to"], x["start"]))).alias("n")), lambda a: a["n"])
    hits = found.groupBy("key").agg(cover.alias("n_hit"))
    held = found.select("key", "n", "h").distinct().join(window, ["n", "h"]).select("key", "item_id").distinct().groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("items"))
    rows = keyed.select("doc_id", "key", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long").alias("n_words"))
    rows = rows.join(hits, "key", "left").join(held, "key", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    return rows.select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept. Null texts stay; rows that repeat a text share its verdict, whatever their ids."""
    items = _items(benchmark)
    if not _fits(items):
        digest = F.xxhash64(F.coalesce("text", F.lit("")))
        gone = _joined(docs.select(digest.alias("doc_id"), "text"), items).where("contaminated").select(F.col("doc_id").alias("digest")).distinct()
        return unpacked(packed(docs, digest=digest).join(gone, "digest", "left_anti"), docs.columns)
    index = docs.sparkSession.sparkContext.broadcast(_index(items))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_only = pa.record_batch([batch.column(at)], names=["text"])
            for part, texts in groups(texts_only):
                n, hit, _ = _scan(texts, index.value)
                clean = [not (h > 0 and SHARE * h >= w) for w, h in zip(n, hit, strict=True)]
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, T.StructType(docs.schema.fields))
