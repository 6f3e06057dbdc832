"""Column functions over text; all are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as C


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in sorted(words)])


def repair_page_text(text: Column) -> Column:
    """Fold Unicode hyphens to -, then join words that a line break had hyphenated."""
    # searches for bytes spare most texts the walk over their characters
    folded = F.when(reduce(Column.__or__, [text.contains(h) for h in "‐‑‒–"]), F.translate(text, "‐‑‒–", "----")).otherwise(text)
    # a plain search for what a hyphen needs behind it spares most texts the search for words
    return F.when(folded.rlike(r"-[ \t\xa0]*\n"), F.regexp_replace(folded, r"(?U)(\w)-[ \t\xa0]*\n[ \t\xa0]*(\w)", "$1$2")).otherwise(folded)


def words(text: Column) -> Column:
    """Split at Unicode blanks; no empty words."""
    return F.array_remove(F.split(text, r"(?U)[\s\x1c-\x1f]+"), "")


def clean_token(token: Column) -> Column:
    return F.lower(F.btrim(token, F.lit(C.NAME_STRIP)))


def name_tokens(text: Column) -> Column:
    """Cleaned tokens in text order; a token of punctuation alone stays as an empty string, and parts its neighbours."""
    return F.transform(F.regexp_extract_all(text, F.lit(C.NAME_TOKEN), F.lit(0)), clean_token)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_terms(tokens: Column) -> Column:
    """Tokens without stop and question words, repeats kept; all tokens if nothing is left."""
    stops = _array(C.STOP_WORDS | C.QUESTION_WORDS)
    kept = F.filter(tokens, lambda t: ~F.array_contains(stops, t))
    return F.when(F.size(kept) == 0, tokens).otherwise(kept)


def query_terms(question: Column) -> Column:
    return content_terms(tokenize(question))


def is_bibliography(text: Column) -> Column:
    """A reference list rather than prose."""
    markers, citations, initials = (F.regexp_count(text, F.lit(p)) for p in (C.REFERENCE_MARKER, C.REFERENCE_CITATION, C.REFERENCE_INITIALS))
    return (markers >= 3) | (citations >= 3) | ((markers >= 1) & (initials >= 6))


def is_follow_up(question: Column) -> Column:
    return question.rlike("(?i)" + C.FOLLOW_UP) | (F.size(query_terms(question)) <= C.FOLLOW_UP_TERMS)


def is_plot_request(question: Column) -> Column:
    return question.rlike(C.PLOT_INTENT)


def is_registry_number(name: Column) -> Column:
    return name.rlike(C.REGISTRY_NUMBER)


def _quoted(name: Column) -> Column:
    return F.regexp_replace(name, r"([^\w\s])", r"\\$1")


def exact_name_pattern(name: Column) -> Column:
    """A whole-word pattern for a literal name, of any case."""
    return F.concat(F.lit(r"(?iU)\b"), _quoted(name), F.lit(r"\b"))


def loose_pattern(name: Column) -> Column:
    """A pattern for a name that a page may have split by a blank or a hyphen anywhere."""
    letters = F.transform(F.split(name, ""), _quoted)
    return F.concat(F.lit("(?iU)"), F.array_join(letters, r"[\s\-]?"))


def snippet(text: Column, start: Column, length: Column, margin: int = 90, otherwise: int = 240) -> Column:
    """Text around a find at 1-based ``start``, or its beginning where there is none (start 0)."""
    low = F.greatest(F.lit(1), start - margin)
    high = start + length + margin
    return F.when(start > 0, F.substring(text, low, high - low)).otherwise(F.substring(text, 1, otherwise))


def preview(text: Column, limit: int = 240) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def paper_id(filename: Column) -> Column:
    """What stands before the first underscore of the file's stem; the stem if nothing does."""
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    prefix = F.split_part(stem, F.lit("_"), F.lit(1))
    return F.when(stem.contains("_") & (prefix != ""), prefix).when(stem != "", stem).otherwise(filename)
