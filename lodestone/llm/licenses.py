"""License scans: exact phrases, and short notices with a few edits.

A notice of n characters with up to k edits is cut into k + 1 pieces, one of which any such occurrence must hold
unchanged. One automaton finds all pieces of all notices; around each hit the regex library's bounded-error matching
verifies the notice and gives its span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textarrays import ALNUM, gram_hashes, groups, words_of

# Phrases and labels of the base rule.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Short notices as they stand in public license texts, lower-cased.
NOTICES = (
    ("licensed under the apache license, version 2.0", "apache-notice"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit-notice"),
    ("released under the mit license", "mit-notice"),
    ("redistribution and use in source and binary forms, with or without modification", "bsd-notice"),
    ("under the terms of the gnu general public license", "gpl-notice"),
    ("gnu lesser general public license", "lgpl-notice"),
    ("subject to the terms of the mozilla public license", "mpl-notice"),
    ("creative commons attribution", "cc-notice"),
    ("all rights reserved", "rights-notice"),
    ("spdx-license-identifier:", "spdx-tag"),
)
#: Edits that a notice may have: one for each so many characters, up to MOST_EDITS.
CHARACTERS_PER_EDIT = 12
MOST_EDITS = 4


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int

    def pieces(self) -> list[tuple[str, int]]:
        """Disjoint pieces with their offsets; an occurrence within ``edits`` edits leaves one of them unchanged."""
        cuts = np.linspace(0, len(self.text), self.edits + 2).astype(int)
        return [(self.text[a:b], int(a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def notice(text: str, label: str) -> Notice:
    return Notice(text, label, min(MOST_EDITS, len(text) // CHARACTERS_PER_EDIT))


class Searcher:
    def __init__(self, notices: list[Notice]):
        self.notices = notices
        at: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for piece, offset in n.pieces():
                at.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in notices]

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of verified places in a lower-cased text whose blanks are spaces."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                n = self.notices[i]
                start = end + 1 - size - offset
                low, high = max(0, start - n.edits), min(len(text), start + len(n.text) + n.edits)
                known = windows.setdefault(i, [])
                known.append([low, high])
        found = set()
        for i, known in windows.items():
            merged: list[list[int]] = []
            for low, high in sorted(known):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(high, merged[-1][1])
                else:
                    merged.append([low, high])
            shortest = len(self.notices[i].text) - self.notices[i].edits
            while merged:
                low, high = merged.pop()
                if high - low >= shortest and (m := self.patterns[i].search(text, low, high)):
                    found.add((m.start(), m.end(), i, sum(m.fuzzy_counts)))
                    # the best match of the window; others stand before or behind it
                    merged += [[low, m.start()], [m.end(), high]]
        return sorted(found)


_BLANKS = str.maketrans("\t\n\x0b\x0c\r", "     ")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def license_spans(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of (doc_id, text, ...).

    ``spans`` lists (start, stop, label, edits) in code points. ``score`` is 1 where a base phrase or a notice stands
    unchanged, less by edits, 0 where there is none. Null, empty and wordless texts have no words, places or labels. Repeated
    rows and null ids get a row each; very long texts are searched whole, one at a time; no rows give no rows.
    """
    chosen = [notice(lowered, label) for lowered, label in notices]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(chosen)
        wanted = []
        for phrase, label in PHRASES:
            own = words_of([phrase.encode()], ALNUM).hashes()
            wanted.append((len(own), gram_hashes(own, len(own))[0], label))
        for batch in batches:
            for part, texts in groups(batch):
                words = words_of(texts, ALNUM)
                word, bounds = words.hashes(), words.bounds
                places: list[list[tuple[int, str]]] = [[] for _ in texts]
                for n, key, label in wanted:
                    at = np.flatnonzero(gram_hashes(word, n) == key)
                    text = np.searchsorted(bounds, at, "right") - 1
                    for i, t in zip(at[at + n <= bounds[text + 1]].tolist(), text[at + n <= bounds[text + 1]].tolist(), strict=True):
                        places[t].append((i - int(bounds[t]), label))
                rows: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
                for raw, own, count in zip(texts, places, np.diff(bounds).tolist(), strict=True):
                    spans = searcher.spans((raw or b"").decode().translate(_LOWER).translate(_BLANKS))
                    base = {label for _, label in own}
                    score = max([1.0 if own else 0.0, *(1 - edits / len(chosen[i].text) for _, _, i, edits in spans)])
                    starts = [i for i, _ in own]
                    for k, v in (("n_words", count), ("n_base", len(own)), ("first_word", min(starts, default=None)), ("last_word", max(starts, default=None)), ("base_labels", ",".join(sorted(base))), ("labels", ",".join(sorted(base | {chosen[i].label for _, _, i, _ in spans}))), ("score", score), ("spans", [{"start": a, "stop": b, "label": chosen[i].label, "edits": e} for a, b, i, e in spans])):
                        rows[k].append(v)
                types = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]))}
                yield pa.record_batch([batch.column("doc_id")[part], *(pa.array(v, types.get(k, pa.int64())) for k, v in rows.items())], names=["doc_id", *rows])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:bigint,stop:bigint,label:string,edits:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)
