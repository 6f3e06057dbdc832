"""Candidate entity names of chunks, and their frequency."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lodestone import constants as C
from lodestone.functions import text as T
from lodestone.functions import tokens as A
from lodestone.functions.names import NameRules, looks_like_name
from lodestone.functions.sizes import sent_if_few


#: Names that a plan holds as literals; more are joined.
LITERAL_NAMES = 5_000


def _tokens(chunks: DataFrame, distinct: bool = False) -> DataFrame:
    """(chunk_ord, word, next) for each token and its neighbour, or for each two that are neighbours anywhere; ``word`` may be empty."""
    split = chunks.select("chunk_ord", T.name_tokens(F.col("text")).alias("words"))
    pairs = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.get("words", i + 1).alias("next")))
    return split.select("chunk_ord", F.explode(F.array_distinct(pairs) if distinct else pairs).alias("t")).select("chunk_ord", "t.word", "t.next")


def lexical_names(chunks: DataFrame, rules: NameRules = NameRules()) -> DataFrame:
    """Words that look like names. The test is of the word alone, so it runs once for each distinct one of a chunk."""
    words = chunks.select("chunk_ord", F.explode(F.array_distinct(T.name_tokens(F.col("text")))).alias("name"))
    return words.where(looks_like_name(F.col("name"), rules))


def hyphen_part_names(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Known names among the parts of hyphenated words that aren't known as a whole."""
    known = sent_if_few(vocabulary.select("name").distinct())
    whole = _tokens(chunks).where(F.col("word").contains("-")).select("chunk_ord", "word").distinct().join(known.withColumnRenamed("name", "word"), "word", "left_anti")
    parts = whole.select("chunk_ord", F.explode(F.split("word", "-")).alias("part")).select("chunk_ord", T.clean_token(F.col("part")).alias("name"))
    return parts.join(known, "name", "left_semi").select("chunk_ord", "name").distinct()


def joined_names(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Known names that a blank had split into two neighbouring tokens."""
    pairs = _tokens(chunks).where("word <> '' and next <> ''").select("chunk_ord", F.concat("word", "next").alias("name"))
    return pairs.join(sent_if_few(vocabulary.select("name").distinct()), "name", "left_semi").select("chunk_ord", "name").distinct()


def acid_names(chunks: DataFrame) -> DataFrame:
    """Two-word names: a stem that ends in -ic, then acid."""
    stem = F.col("word")
    found = _tokens(chunks).where((F.col("next") == "acid") & (F.length(stem) > C.MIN_ACID_STEM) & stem.endswith("ic"))
    return found.select("chunk_ord", F.concat(stem, F.lit(" acid")).alias("name")).distinct()


def candidate_names(chunks: DataFrame, vocabulary: DataFrame | None = None, rules: NameRules = NameRules()) -> DataFrame:
    """Distinct (chunk_ord, name) of all four rules; without a vocabulary (name) the two closed ones find nothing.

    Tokens are made once: each pair of neighbours gives what the rules see in it, with whether the vocabulary must know
    the name, and the whole word that it must not know.
    """
    word, following = F.col("word"), F.col("next")
    closed = vocabulary is not None

    def seen(name: Column, asks: bool, whole: Column | None = None) -> Column:
        return F.struct(name.alias("name"), F.lit(asks).alias("asks"), (F.lit(None).cast("string") if whole is None else whole).alias("whole"))

    rows = [F.when(looks_like_name(word, rules), seen(word, False)), F.when((following == "acid") & (F.length(word) > C.MIN_ACID_STEM) & word.endswith("ic"), seen(F.concat(word, F.lit(" acid")), False))]
    found = F.array_compact(F.array(*rows, *([F.when((word != "") & (following != ""), seen(F.concat(word, following), True))] if closed else [])))
    if closed:
        parts = F.transform(F.split(word, "-"), lambda p: seen(T.clean_token(p), True, word))
        found = F.when(word.contains("-"), F.concat(found, parts)).otherwise(found)
    given = _tokens(chunks, distinct=True).select("chunk_ord", F.explode(found).alias("x")).select("chunk_ord", "x.*")
    if closed:
        known = sent_if_few(vocabulary.select(F.col("name").alias("known")).distinct())
        given = given.join(known, F.col("name") == F.col("known"), "left").where("not asks or known is not null").drop("known")
        given = given.join(known, F.col("whole") == F.col("known"), "left").where("known is null")
    return given.select("chunk_ord", "name").distinct()


def names_found(chunks: DataFrame, vocabulary: DataFrame, rules: NameRules = NameRules(), most: int = LITERAL_NAMES) -> DataFrame:
    """``candidate_names`` of chunks with keys of their own; a vocabulary of up to ``most`` names goes to them, and nothing is moved."""
    listed = _listed(vocabulary, most)
    if listed is None:
        return candidate_names(chunks, vocabulary, rules)
    rule = RuleNames.of(words=(), acids=None, joined=listed, whole=listed)

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = A.name_tokens(batch.column("text"))
        held, name, text, names, both = rule.counted(tokens, batch.num_rows)
        words = pa.concat_arrays([tokens.dictionary, pa.array(names, tokens.dictionary.type)]).cast(pa.string())
        code, held_text = np.divmod(held, max(batch.num_rows, 1))
        may = _may_be_names(tokens.dictionary, rules)[code]
        code, held_text = code[may], held_text[may]
        kind = np.concatenate([np.zeros(len(code), dtype=np.int32), np.where(both, 2, 1).astype(np.int32)])
        return pa.RecordBatch.from_arrays([batch.column("chunk_ord").take(pa.array(np.concatenate([held_text, text]))), words.take(pa.array(np.concatenate([code, name + len(tokens.dictionary)]))), pa.array(kind)], ["chunk_ord", "name", "kind"])

    schema = StructType([chunks.schema["chunk_ord"], StructField("name", StringType(), False), StructField("kind", IntegerType(), False)])
    as_name = F.coalesce(looks_like_name(F.col("name"), rules), F.lit(False))
    rows = chunks.select("chunk_ord", "text").mapInArrow(A.by_slices(find), schema)
    return rows.where(F.when(F.col("kind") == 1, True).when(F.col("kind") == 0, as_name).otherwise(~as_name)).select("chunk_ord", "name")


def _may_be_names(words: pa.Array, rules: NameRules) -> np.ndarray:
    """Whether words of ``A.name_tokens``, which are ASCII, pass a part of ``looks_like_name``; none that it accepts fails here."""
    patterns = ["(" + "|".join(rules.suffixes) + ")$", "[0-9]|^(" + "|".join(C.LOCANT_PREFIXES) + ")", "|".join(rules.morphemes)]
    some = pc.is_in(words, pa.array(sorted(n.encode() for n in rules.seeds), words.type))
    for pattern in patterns:
        some = pc.or_(some, pc.match_substring_regex(words, pattern))
    return pc.and_(some, pc.greater_equal(pc.binary_length(words), C.MIN_WORD)).to_numpy(zero_copy_only=False)


def _listed(vocabulary: DataFrame, most: int) -> list[str] | None:
    listed = [r["name"] for r in vocabulary.select("name").where("name is not null").distinct().limit(most + 1).collect()]
    return listed if len(listed) <= most else None


@dataclass(frozen=True)
class KnownNames:
    """Names that passages are searched for, by the rule that finds them, with the block of each. They are literals of a plan."""

    blocks: dict[str, str]
    words: list[str]
    acids: list[str]
    joined: list[str]
    whole: list[str]


def known_names(known: DataFrame, vocabulary: DataFrame, rules: NameRules = NameRules(), most: int = LITERAL_NAMES) -> KnownNames | None:
    """The names of ``known`` (name, block) sorted by rule, or none if there are more than ``most`` of them, or of the vocabulary's hyphenated names that hold one."""
    listed = vocabulary.select("name", F.lit(True).alias("listed")).distinct()
    name = F.col("name")
    stem = F.regexp_extract("name", "^(.+) acid$", 1)
    acid = (F.length(stem) > C.MIN_ACID_STEM) & stem.endswith("ic")
    rows = known.select("name", "block").join(listed, "name", "left").select("name", "block", looks_like_name(name, rules).alias("word"), acid.alias("acid"), F.col("listed").isNotNull().alias("listed")).limit(most + 1).collect()
    parts = [r["name"] for r in rows if r["listed"]]
    hyphened = vocabulary.where(name.contains("-")).select("name").distinct()
    whole = hyphened.where(F.exists(F.split("name", "-"), lambda p: T.clean_token(p).isin(*parts))).limit(most + 1).collect() if parts else []
    if len(rows) > most or len(whole) > most:
        return None
    return KnownNames({r["name"]: r["block"] for r in rows}, [r["name"] for r in rows if r["word"]], [r["name"] for r in rows if r["acid"]], parts, [r["name"] for r in whole])


@dataclass(frozen=True)
class RuleNames:
    """What the rules look for among tokens, as bytes; ``acids`` is none for any, and ``halves`` are the parts that a blank may have left of ``joined``."""

    words: frozenset[bytes]
    acids: frozenset[bytes] | None
    joined: frozenset[bytes]
    whole: frozenset[bytes]
    halves: frozenset[bytes]

    @classmethod
    def of(cls, words: Iterable[str], acids: Iterable[str] | None, joined: Iterable[str], whole: Iterable[str]) -> RuleNames:
        sets = [None if names is None else frozenset(n.encode() for n in names) for names in (words, acids, joined, whole)]
        return cls(*sets, frozenset(n[:i] for n in sets[2] for i in range(1, len(n))))

    def found(self, tokens: A.Tokens) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(text, number, names): a row for each find, names[number] of it. Words are tried once each, pairs of neighbours too."""
        words = tokens.dictionary
        numbers: dict[bytes, int] = {}
        texts, found = [], []

        def add(places: np.ndarray, codes: np.ndarray, names_of: Callable[[list[int]], list[list[bytes]]]) -> None:
            """At each place the names that its code stands for."""
            each = A.distinct(codes)
            names = names_of(each.tolist())
            flat = np.array([numbers.setdefault(n, len(numbers)) for held in names for n in held], dtype=np.int64)
            size = np.array([len(held) for held in names], dtype=np.int64)
            of = np.searchsorted(each, codes)
            count = size[of]
            texts.append(np.repeat(tokens.text[places], count))
            found.append(flat[np.repeat((np.cumsum(size) - size)[of], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])

        def places_of(test: pa.Array) -> np.ndarray:
            return np.flatnonzero(test.to_numpy(zero_copy_only=False).astype(bool)[tokens.code]) if len(words) else np.zeros(0, dtype=np.int64)

        def among(names: frozenset[bytes]) -> pa.Array:
            return pc.is_in(words, pa.array(sorted(names), words.type))

        same = np.append(tokens.text[1:] == tokens.text[:-1], False) if len(tokens.text) else np.zeros(0, dtype=bool)
        if self.words:
            at = places_of(among(self.words))
            add(at, tokens.code[at], lambda codes: [[words[c].as_py()] for c in codes])
        if self.halves:
            at = places_of(among(self.halves))
            at = at[same[at]]
            pair = tokens.code[at] * len(words) + tokens.code[at + 1]

            def joined(pairs: list[int]) -> list[list[bytes]]:
                halves = [tuple(words.take(pa.array(side, pa.int64())).to_pylist()) for side in ([p // len(words) for p in pairs], [p % len(words) for p in pairs])]
                return [[a + b] if b and a + b in self.joined else [] for a, b in zip(*halves, strict=True)]

            add(at, pair, joined)
        at = places_of(pc.equal(words, pa.scalar(b"acid", words.type)))
        at = at[at > 0] - 1
        at = at[same[at]]

        def acid(codes: list[int]) -> list[list[bytes]]:
            stems = [words[c].as_py() for c in codes]
            return [[w + b" acid"] if len(w) > C.MIN_ACID_STEM and w.endswith(b"ic") and (self.acids is None or w + b" acid" in self.acids) else [] for w in stems]

        add(at, tokens.code[at], acid)
        at = places_of(pc.match_substring(words, "-"))

        def parts(codes: list[int]) -> list[list[bytes]]:
            hyphened = words.take(pa.array(codes, pa.int64())).to_pylist()
            return [sorted({p.strip(C.NAME_STRIP.encode()) for p in w.split(b"-")} & self.joined) if w not in self.whole else [] for w in hyphened]

        add(at, tokens.code[at], parts)
        return np.concatenate(texts), np.concatenate(found), list(numbers)

    def counted(self, tokens: A.Tokens, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """(held, name, text, names, both): the distinct words of texts as code * n_texts + text, the distinct finds names[name] of text, and whether that stands there as a word too."""
        held = A.distinct(tokens.code * n_texts + tokens.text)
        text, code, names = self.found(tokens)
        coded = pc.fill_null(pc.index_in(pa.array(names, tokens.dictionary.type), tokens.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        name, text = np.divmod(A.distinct(code * n_texts + text), max(n_texts, 1))
        as_word = coded[name]
        wanted = as_word * n_texts + text
        return held, name, text, names, (as_word >= 0) & (np.append(held, -1)[np.searchsorted(held, wanted)] == wanted)


def with_names(chunks: DataFrame, known: KnownNames) -> DataFrame:
    """chunks with sorted ``compounds`` and ``blocks``: what ``candidate_names`` finds and ``known`` has, without moving a passage."""
    rule = RuleNames.of(known.words, known.acids, known.joined, known.whole)
    listed = sorted(known.blocks, key=str.encode)
    number = {n.encode(): i for i, n in enumerate(listed)}
    blocks = sorted({b for b in known.blocks.values() if b is not None}, key=str.encode)
    block_of = np.array([blocks.index(known.blocks[n]) if known.blocks[n] is not None else -1 for n in listed], dtype=np.int64)

    def lists(text: np.ndarray, value: np.ndarray, names: list[str], n_texts: int) -> pa.Array:
        pair = A.distinct(text * max(len(names), 1) + value)
        text, value = np.divmod(pair, max(len(names), 1))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_texts))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(names, pa.string()).take(pa.array(value)))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, code, names = rule.found(A.name_tokens(batch.column("text")))
        name = np.array([number[n] for n in names], dtype=np.int64)[code]
        block = block_of[name]
        columns = [lists(text, name, listed, batch.num_rows), lists(text[block >= 0], block[block >= 0], blocks, batch.num_rows)]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "compounds", "blocks"])

    names = ArrayType(StringType())
    return chunks.mapInArrow(A.by_slices(find), StructType([*chunks.schema.fields, StructField("compounds", names), StructField("blocks", names)]))


def name_frequencies(chunks: DataFrame, vocabulary: DataFrame, rules: NameRules = NameRules(), most: int = LITERAL_NAMES) -> DataFrame:
    """(name, frequency) of all names that ``candidate_names`` finds: the number of chunks that hold each.

    A vocabulary of up to ``most`` names goes to the passages. Words are counted where they stand, and ``looks_like_name``
    runs once for each distinct one; a name that another rule finds too is counted apart by whether it stands there as a
    word, so that a chunk counts once whichever rules find it. A larger vocabulary is joined.
    """
    listed = _listed(vocabulary, most)
    if listed is None:
        return candidate_names(chunks, vocabulary, rules).groupBy("name").agg(F.count("*").alias("frequency"))
    rule = RuleNames.of(words=(), acids=None, joined=listed, whole=listed)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = A.name_tokens(batch.column("text"))
        held, name, _, names, both = rule.counted(found, batch.num_rows)
        named = pa.array(names, found.dictionary.type)
        counts = [(found.dictionary, held // max(batch.num_rows, 1), "word"), (named, name[~both], "rule"), (named, name[both], "both")]
        kept = []
        for words, of, kind in counts:
            n = np.bincount(of, minlength=len(words))
            kept.append((words.filter(pa.array(n > 0)), pa.array(n[n > 0].astype(np.int64)), kind))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([w for w, _, _ in kept]).cast(pa.string()), pa.concat_arrays([n for _, n, _ in kept]), pa.array(np.repeat([kind for _, _, kind in kept], [len(w) for w, _, _ in kept]), pa.string())], ["name", "n", "kind"])

    rows = chunks.select("text").mapInArrow(A.by_slices(count, most=A.WIDE_SLICE_BYTES), "name string, n long, kind string")
    seen = rows.groupBy("name").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in ("word", "rule", "both")])
    as_name = F.coalesce(looks_like_name(F.col("name"), rules), F.lit(False))
    counted = seen.select("name", (F.col("n_rule") + F.when(as_name, F.col("n_word")).otherwise(F.col("n_both"))).alias("frequency"))
    return counted.where("frequency > 0")


def most_frequent(counted: DataFrame, most: int = C.MAX_CANDIDATES) -> DataFrame:
    """The names of the highest frequencies; ties go by name."""
    return counted.orderBy(F.desc("frequency"), "name").limit(most)


def frequent_names(candidates: DataFrame, most: int = C.MAX_CANDIDATES) -> DataFrame:
    """(name, frequency) of the names that most chunks hold; ties go by name."""
    return most_frequent(candidates.groupBy("name").agg(F.count("*").alias("frequency")), most)
