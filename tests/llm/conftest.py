from __future__ import annotations

import random
import re

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n long, h string, row int, size int, rank string, host int, content int, digest string, key_ int, cell int"


def spaced(text: str | None) -> list[str]:
    """Words of the contracts that are cut at blanks, as they stand."""
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text: str | None) -> list[str]:
    """Lower-cased words of the contracts that are cut at all but digits, letters and non-ASCII."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng: random.Random, words: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture
def table(spark):
    """A documents table of texts, or of (text, source); extra columns clash with names that operators use inside."""

    def make(rows: list, first: int = 0):
        out = []
        for i, row in enumerate(rows, first):
            text, source = row if isinstance(row, tuple) else (row, f"s{i % 3}")
            out.append((i, text, "en", source, len(text or ""), 7, "x", 1, 2, "r", 3, 4, "d", 5, 6))
        return spark.createDataFrame(out, DOCUMENTS)

    return make


#: Texts that every operator must bear: none, empty, blanks, repeats, non-ASCII, one long word, a long text.
ODD = [None, "", "  \n\t ", "one", "one", "Ünïcode 日本語 text mit ß", "x" * 5000, "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n", "word " * 3000, "\n\n\n", "🙂 emoji 🙂"]
