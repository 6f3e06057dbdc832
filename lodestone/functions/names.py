"""Lexical tests for entity names, as expressions over a cleaned word."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as C


@dataclass(frozen=True)
class NameRules:
    """The word lists of the tests; the defaults are for chemistry."""

    suffixes: tuple[str, ...] = C.SUFFIXES
    morphemes: tuple[str, ...] = C.MORPHEMES
    false_friends: frozenset[str] = C.FALSE_FRIENDS
    seeds: frozenset[str] = C.SEEDS


def _alphabetic(word: Column) -> Column:
    return word.rlike(r"^\p{L}+$")


def morpheme_count(word: Column, morphemes: tuple[str, ...] = C.MORPHEMES) -> Column:
    """Morphemes whose first occurrences don't overlap those accepted before, in list order."""
    spans = "array<struct<start:int,stop:int>>"
    places = F.array(*[F.struct(F.instr(word, m).alias("start"), (F.instr(word, m) + len(m)).alias("stop")) for m in morphemes])
    found = F.filter(places, lambda p: p["start"] > 0)

    def accept(taken: Column, p: Column) -> Column:
        clash = F.exists(taken, lambda t: (p["start"] < t["stop"]) & (t["start"] < p["stop"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(p)))

    return F.size(F.aggregate(found, F.array().cast(spans), accept))


def looks_like_name(word: Column, rules: NameRules = NameRules()) -> Column:
    """Whether a cleaned word is worth resolving."""
    locant = word.rlike(C.LOCANT) | word.rlike("^(" + "|".join(C.LOCANT_PREFIXES) + ")")
    suffix = word.rlike("(" + "|".join(rules.suffixes) + ")$")
    alphabetic = _alphabetic(word)
    long = (F.length(word) >= C.MIN_MORPHEME_WORD) & alphabetic & word.rlike("|".join(rules.morphemes))
    return (
        F.when((F.length(word) < C.MIN_WORD) | word.isin(*sorted(rules.false_friends)), False)
        .when(word.isin(*sorted(rules.seeds)), True)
        .when(locant & (suffix | word.rlike(r"\d")), True)
        .when(suffix & alphabetic, True)
        .when(long, morpheme_count(word, rules.morphemes) >= C.MIN_MORPHEMES)
        .otherwise(False)
    )
