from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm.conftest import ODD, prose

from lodestone.llm import personal_data as P


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text: str | None) -> list[tuple[int, int, str]]:
    t = text or ""
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)]
    found += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], P.BASE.index(x[2])))


CASES = [
    *ODD, "a@b.c@d.e", "a@b.c_x@d.e", "x@y z@w.io", "@@a@b.c", "é.me@host.org,you+1@sub.host.co", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112 5500000000000004", "+49 (30) 123-4567 890", "+1 2",
    "call +33 1 23 45 67 89. now", "🙂 mail me@x.org 🙂 10.0.0.1", "1" * 4000, "a" * 4000 + "@", "1 " * 30, "a@b", "-a.b@-c.-d", "00001.00002.00003.00004",
]


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    letters = "ab1.@+- ()94_%é"
    for text in CASES + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(4000)]:
        assert P.base_spans(text or "") == brute(text), text


def test_digest_of_the_query(table):
    rows = P.digest(P.private_spans(table(CASES))).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        base = brute(CASES[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, _, k in base) for x in P.BASE)


def test_terms_that_give_an_identifier_away(table):
    rng = random.Random(5)
    texts = [f"{prose(rng, 40)} about the zebrafinch keeper jo@x.org and {prose(rng, 40)}" for _ in range(4)]
    texts += [f"{prose(rng, 40)} about the keeper and {prose(rng, 30)}" for _ in range(40)]
    texts += [texts[0]]
    docs = table(texts)
    spans = {r.doc_id: r.spans for r in P.private_spans(docs).collect()}
    for i in (0, 1, 2, 3, 44):
        words = {texts[i][s.start : s.stop] for s in spans[i] if s.kind == P.TERM}
        assert words == {"zebrafinch"}
    assert all(not spans[i] for i in range(4, 44))
    clean = P.sanitised(docs)
    got = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns
    assert "[TERM] keeper [EMAIL]" in got[0] and got[10] == texts[10]


def brute_terms(texts: list[str]) -> set[str]:
    """Disclosing words by the definition: counts over distinct texts, all pairs tried."""
    distinct = sorted(set(texts))
    base = [brute(t) for t in distinct]
    words = [[(m.start(), m.end(), m[0].translate(P._LOWER)) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)] for t in distinct]
    free = [{w for a, b, w in own if not any(x < b and a < y for x, y, _ in spans)} for own, spans in zip(words, base, strict=True)]
    ids = [{f"{k}:{t[a:b].translate(P._LOWER)}" for a, b, k in spans} for t, spans in zip(distinct, base, strict=True)]
    n, found = len(distinct), set()
    classes = Counter(sum(any(w == x for _, _, x in own) for own in words).bit_length() for w in {x for own in words for _, _, x in own})
    for identifier in set().union(*ids):
        held = [i for i in range(n) if identifier in ids[i]]
        for word in set().union(*(free[i] for i in held)):
            e, t, c = len(held), sum(any(word == w for _, _, w in own) for own in words), sum(word in free[i] for i in held)

            def entropy(share, by):
                return sum(a * math.log(a / b) for a, b in ((share, by), (1 - share, 1 - by)) if a > 0)

            if n > e and math.log2(c * n / (e * t)) >= P.DISCLOSES * math.log2(n / e) and max(e * entropy(c / e, t / n), t * entropy(c / t, e / n)) >= math.log(classes[t.bit_length()] * len(classes) / P.CHANCE):
                found.add(word)
    return found


@pytest.mark.parametrize("copies", [0, 60])
def test_terms_match_brute_force(table, copies):
    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(3, 30), 80) for _ in range(150)]
    for i, name in enumerate(["jo@x.org", "10.1.2.3", "+49 30 1234567", "4111 1111 1111 1111", "a@b.io"]):
        for j in range(i, 150, 40 + 30 * i):
            texts[j] += f" Ort{i} keeper{i % 2} {name} ende{i}"
    texts += [texts[0]] * copies
    want = brute_terms(texts)
    got = {texts[r.doc_id][s.start : s.stop].translate(P._LOWER) for r in P.private_spans(table(texts)).collect() for s in r.spans if s.kind == P.TERM}
    assert got == want and want


def test_null_and_repeated_ids_and_a_very_long_text(spark):
    long = "x " * 400_000 + "me@x.org"
    rows = spark.createDataFrame([(None, "a@b.co"), (None, "a@b.co"), (4, None), (4, long)], "doc_id long, text string")
    got = [(r.doc_id, r.n_email, r.n_base) for r in P.digest(P.private_spans(rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, 1), (None, 1, 1), (4, 0, 0), (4, 1, 1)], key=str)
    clean = P.sanitised(rows.where("doc_id = 4")).collect()
    assert sorted(str(r.text)[-7:] for r in clean) == ["None"[-7:], "[EMAIL]"]


def test_joined_counts_agree_with_sent_ones(table, monkeypatch):
    rng = random.Random(6)
    docs = table([f"{prose(rng, 20, 60)} me@x.org {prose(rng, 20, 60)}" for _ in range(30)] + [prose(rng, 30, 60) for _ in range(30)])
    first = sorted(map(str, P.private_spans(docs).collect()))
    monkeypatch.setattr(P, "HELD_TERMS", 0)
    monkeypatch.setattr(P, "TASK_TERMS", 10)
    assert sorted(map(str, P.private_spans(docs).collect())) == first


def test_empty_table(table):
    assert P.private_spans(table([])).count() == 0


def test_identifier_of_one_text_has_disclosing_terms(table):
    rng = random.Random(7)
    texts = [prose(rng, 12, 40) for _ in range(400)]
    texts[7] = "w1 w2 zebrafinch keeper me@x.org w3 w4"
    texts[9] = "w1 keeper w5"
    texts[11:60] = [f"{t} keeper" for t in texts[11:60]]
    spans = {r.doc_id: r.spans for r in P.private_spans(table(texts)).collect()}
    assert [texts[7][s.start : s.stop] for s in spans[7] if s.kind == P.TERM] == ["zebrafinch"]
    assert not any(spans[i] for i in spans if i != 7)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_words_that_disclose_nothing_are_left_alone(table, seed):
    """Independent words of heavy-tailed frequency: with 60 identifiers chance gives CHANCE terms each at most, 3 in all."""
    rng = np.random.default_rng(seed)
    ranks = np.minimum(rng.zipf(1.3, size=(1500, 20)), 10**6)
    texts = [" ".join(f"w{r}" for r in row) for row in ranks]
    for i in range(60):
        for j in rng.choice(1500, size=1 + i % 4, replace=False):
            texts[j] += f" name{i}@mail.org"
    found = P.private_spans(table(texts)).collect()
    terms = {texts[r.doc_id][s.start : s.stop] for r in found for s in r.spans if s.kind == P.TERM}
    assert len(terms) <= 3


def test_a_long_list_of_addresses(spark):
    """Identifiers of one text are paired with nothing, so a list of many costs no more than its length."""
    rows = [(1, " ".join(f"a{i}@mail.org word{i}" for i in range(20_000))), (2, "plain words")]
    got = {r.doc_id: r.n_email for r in P.digest(P.private_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: 20_000, 2: 0}

def test_copies_of_a_disclosing_text_count_once(table, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, 12, 40) for _ in range(400)]
    texts[:3] = [f"{prose(rng, 4, 40)} zebrafinch me@x.org {prose(rng, 4, 40)}" for _ in range(3)]
    texts += [texts[0]] * 300
    for held in (P.HELD_TERMS, 0):
        monkeypatch.setattr(P, "HELD_TERMS", held)
        spans = {r.doc_id: r.spans for r in P.private_spans(table(texts)).collect()}
        for i in (0, 1, 2, 400, 699):
            assert [texts[i][s.start : s.stop] for s in spans[i] if s.kind == P.TERM] == ["zebrafinch"]


def test_disclosing_terms_count_and_go_wherever_they_stand(table, monkeypatch):
    """A heading far from the identifier, three characters long, and a text without the identifier."""
    rng = random.Random(9)
    texts = [prose(rng, 12, 40) for _ in range(400)]
    texts[:4] = [f"Zäb 日本 {prose(rng, 60, 40)} me@x.org {prose(rng, 4, 40)}" for _ in range(4)]
    texts[4] = f"{prose(rng, 30, 40)} 🙂 zäb"
    wanted = {**dict.fromkeys(range(4), ["Zäb", "日本"]), 4: ["zäb"]}
    for held in (P.HELD_TERMS, 1):
        monkeypatch.setattr(P, "HELD_TERMS", held)
        spans = {r.doc_id: r.spans for r in P.private_spans(table(texts)).collect()}
        assert {i: [texts[i][s.start : s.stop] for s in x if s.kind == P.TERM] for i, x in spans.items() if x} == wanted
