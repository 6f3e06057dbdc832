from __future__ import annotations

import re
from collections import Counter

from llm.conftest import ODD, prose, spaced

from lodestone.llm import quality_rules
from lodestone.llm.quality_rules import Limits


def base(text):
    text = text or ""
    w = spaced(text)
    lines = [x for x in text.split("\n") if spaced(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_counters_match_brute_force(table):
    import random

    rng = random.Random(1)
    texts = [*ODD, "a b c a b c a", "x y z\nx y z\n \nx y z", "#*$ | <b> 50%", "\n".join(prose(rng, 9, 12) for _ in range(20)), prose(rng, 400, 20), "a a a a a", "ß x y"]
    rows = quality_rules.judged(table(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), texts[r.doc_id]


def test_frequent_lines_deplete_documents_of_their_host(table):
    import random

    rng = random.Random(2)
    banner = "Subscribe to letter 12 today"
    rows = [(f"{banner}\n{prose(rng, 8)}", "hot") for _ in range(6)] + [(f"subscribe  to letter 99 today\n{prose(rng, 60)}", "hot")]
    rows += [(f"{banner}\n{prose(rng, 8)}", "other"), (prose(rng, 60), None), (rows[0][0], "hot")]
    limits = Limits(line_documents=3, line_share=0.1, removed_share=0.3, min_words=5)
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in quality_rules.judged(table(rows), limits).collect()}
    assert got == {**{i: (5, False) for i in (0, 1, 2, 3, 4, 5, 9)}, 6: (5, True), 7: (0, True), 8: (0, True)}
    kept = quality_rules.keep_good(table(rows), limits)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == {6, 7, 8} and texts[6] == rows[6][0].split("\n")[1] and texts[7] == rows[7][0]
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.doc_id == 6)


def test_copies_of_one_document_are_not_boilerplate(table):
    import random

    rng = random.Random(3)
    text = "\n".join(prose(rng, 12) for _ in range(6))
    rows = quality_rules.judged(table([(text, "s")] * 8), Limits(line_documents=3)).collect()
    assert all(r.kept and r.n_removed_words == 0 for r in rows)


def test_empty_table(table):
    assert quality_rules.judged(table([])).count() == 0
    assert quality_rules.keep_good(table([])).count() == 0


def test_default_limits_on_a_hot_host_and_on_a_small_one(table):
    """A line in 20 of 600 documents, and one in all of 12; 10 documents aren't enough."""
    import random

    rng = random.Random(4)
    rows = [(f"all rights of us\n{prose(rng, 60)}" if i < 20 else f"rare line\n{prose(rng, 60)}" if i < 30 else prose(rng, 60), "hot") for i in range(600)]
    rows += [(f"read more here\n{prose(rng, 60)}", "small") for _ in range(12)]
    got = {r.doc_id: r.n_removed_words for r in quality_rules.judged(table(rows)).collect()}
    assert got == {**dict.fromkeys(range(600), 0), **dict.fromkeys(range(20), 4), **dict.fromkeys(range(600, 612), 3)}
    texts = {r.doc_id: r.text for r in quality_rules.keep_good(table(rows)).collect()}
    assert len(texts) == 612 and not any("all rights" in t or "read more" in t for t in texts.values())
