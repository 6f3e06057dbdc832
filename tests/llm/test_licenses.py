from __future__ import annotations

import random
import re

import regex
from llm.conftest import ODD, alnum, lower, prose

from lodestone.llm import licenses as L

CASES = [
    *ODD, "The MIT License.", "mit\nlicense mit-license xmit license", "GNU General Public License, general public license", "Apache License apache licenses", "Licensed under the Apache Licence, Version 2.0!",
    "permision is hereby granted, free of charge to any person obtaining a copy", "All rights reserved. ALL RIGHTS\nRESERVED", "spdx-license-identifier: MIT", "mit license " * 50,
]


def test_base_columns_match_brute_force(table):
    for r in L.license_spans(table(CASES)).collect():
        w = alnum(CASES[r.doc_id])
        places = [(i, label) for phrase, label in L.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not places)


def test_edited_notices_are_found_where_a_full_search_finds_them():
    rng = random.Random(7)
    chosen = [L.notice(*n) for n in L.NOTICES]
    searcher = L.Searcher(chosen)
    for _ in range(150):
        i = rng.randrange(len(chosen))
        text = list(chosen[i].text)
        for _ in range(rng.randrange(0, chosen[i].edits + 2)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(["", "x", text[at] + "y"])
        body = lower(re.sub(r"\s", " ", prose(rng, 20))) + " " + "".join(text) + " " + prose(rng, 20)
        full = regex.search(f"(?b)(?:{regex.escape(chosen[i].text)}){{e<={chosen[i].edits}}}", body)
        mine = [s for s in searcher.spans(body) if s[2] == i]
        assert bool(mine) == bool(full), (chosen[i].text, "".join(text))
        assert all(s[3] <= chosen[i].edits and sum(full.fuzzy_counts) <= s[3] for s in mine)


def test_spans_hold_the_notices_and_no_others():
    """Notices with known edits between clean words: a span for each, within a character or two of an edit at its ends."""
    rng = random.Random(17)
    chosen = [L.notice(*n) for n in L.NOTICES]
    searcher = L.Searcher(chosen)
    for _ in range(60):
        body, planted = prose(rng, 6), []
        for i in rng.sample(range(len(chosen)), 3):
            text = list(chosen[i].text)
            for at in rng.sample(range(4, len(text) - 4), rng.randrange(chosen[i].edits + 1)):
                text[at] = rng.choice(["", "z", text[at] + "z"])
            planted.append((len(body) + 1, len(body) + 1 + len("".join(text)), i))
            body += " " + "".join(text) + " " + prose(rng, 6)
        got = searcher.spans(body)
        for a, b, i in planted:
            assert any(j == i and abs(x - a) <= 2 and abs(y - b) <= 2 and e <= chosen[i].edits for x, y, j, e in got), (body, planted, got)
        assert all(any(x < b and a < y for a, b, _ in planted) for x, y, _, _ in got)


def test_null_ids_repeats_and_a_very_long_text(spark):
    rows = spark.createDataFrame([(None, "mit license"), (None, "mit license"), (1, "x " * 400_000 + "apache license"), (1, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_base, r.labels, r.n_words) for r in L.license_spans(rows).collect()), key=str)
    assert got == sorted([(None, 1, "mit", 2), (None, 1, "mit", 2), (1, 1, "apache", 400_002), (1, 0, "", 0)], key=str)


def test_clean_prose_has_no_notices_and_empty_tables_work(table):
    rng = random.Random(8)
    assert all(r.labels == "" and r.score == 0 for r in L.license_spans(table([prose(rng, 300) for _ in range(20)])).collect())
    assert L.license_spans(table([])).count() == 0


def test_neighbouring_notices_with_different_edits():
    searcher = L.Searcher([L.notice("all rights reserved", "rights-notice")])
    for body, edits in (("x all rights reservd all rights reserved y", [1, 0]), ("all rights reserved all rihts reserved", [0, 1]), ("al rights reserved, all rights reserved. all rights resrved all rights reserved", [1, 0, 1, 0])):
        assert [s[3] for s in searcher.spans(body)] == edits
