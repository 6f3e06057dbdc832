from __future__ import annotations

import hashlib
import re
import time

from llm.conftest import ODD

from lodestone.llm import secrets
from lodestone.llm.scratch import new_path
from lodestone.llm.secrets import BASE, RULES, BlobLedger, Rule

HEX = "0123456789abcdef" * 3
TEXTS = [
    *ODD, "password = hunter2hunter2", "TOKEN: short", 'api_key"="abcdefgh"', "token: secret: abcdefgh123", "AKIAABCDEFGHIJKL99 and AKIASHORT", f"é🙂 {HEX} passwd:'{HEX}'", f"{HEX}AKIA{'Z' * 20}", "secret  :=  x",
    "ghp_" + "a1" * 18, "xoxb-1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "apikey==padded1234 PASSWORD:12345678, secret=abcd/efg+h=", f"token={HEX} token={HEX}",
]


def expected(text: str | None, rules=RULES) -> tuple[str, str, dict]:
    found = []
    for rank, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), rank, rule.kind, m.end()))
    found.sort()
    base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found if k in BASE)
    return hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, _, k, b in found), {k: sum(f[2] == k for f in found) for k in BASE}


def test_matches_brute_force(table):
    rows = secrets.secrets(table(TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        digest, spans, counts = expected(TEXTS[r.doc_id])
        assert (r.base_sha256, r.spans, r.n_assign, r.n_access, r.n_hex) == (digest, spans, *counts.values()), TEXTS[r.doc_id]


def test_only_unseen_blobs_and_rule_versions_are_scanned(spark, table):
    ledger = BlobLedger(spark, new_path(spark, "ledger"))
    secrets.secrets(table(TEXTS[:16]), ledger).collect()
    seen = ledger.scanned().count()
    assert seen == len({t or "" for t in TEXTS[:16]})
    again = secrets.secrets(table([*TEXTS, TEXTS[14]]), ledger).collect()
    assert ledger.scanned().count() == len({t or "" for t in TEXTS})
    assert {r.doc_id: r.spans for r in again}[len(TEXTS)] == expected(TEXTS[14])[1]
    # a new rule, and a changed one: of blobs that are known only these two are tried
    rules = (RULES[0], Rule("access", r"AKIA[A-Z0-9]+", 0, 5), *RULES[2:], Rule("pin", r"PIN [0-9]{4}"))
    texts = ["PIN 1234", TEXTS[14], TEXTS[17]]
    newer = secrets.secrets(table(texts), ledger, rules).collect()
    assert {r.doc_id: r.spans for r in newer} == {i: expected(t, rules)[1] for i, t in enumerate(texts)}
    added = [set(r.rules) for r in ledger.scanned().collect() if rules[1].version in r.rules]
    assert sorted(map(len, added)) == [2, 2, len(rules)]
    # the old rules still give what they gave
    assert {r.doc_id: r.spans for r in secrets.secrets(table(TEXTS), ledger).collect()} == {i: expected(t)[1] for i, t in enumerate(TEXTS)}
    assert ledger.scanned().count() == len({t or "" for t in TEXTS}) + 3


def test_many_null_ids_are_not_paired_with_each_other(spark):
    rows = spark.createDataFrame([(None, f"token = {'a' * 8}{i}") for i in range(3000)], "doc_id long, text string")
    assert secrets.secrets(rows).where("n_assign = 1").count() == 3000


def test_empty_repeated_and_null_ids(spark, table):
    assert secrets.secrets(table([])).count() == 0
    rows = spark.createDataFrame([(None, TEXTS[14]), (None, TEXTS[14]), (3, TEXTS[14]), (3, "clean")], "doc_id long, text string")
    got = secrets.secrets(rows).collect()
    assert sorted((r.doc_id or -1, r.n_assign) for r in got) == sorted([(-1, expected(TEXTS[14])[2]["assign"])] * 2 + [(3, expected(TEXTS[14])[2]["assign"]), (3, 0)])


def test_tokens_in_three_parts_in_long_runs(spark):
    """Runs that hold many beginnings of a token cost about their length, and spans are those of the plain pattern."""
    rule = next(r for r in secrets.RULES if r.kind == "jwt")
    part = "eyJ" + "aB3_-x9Z"
    texts = ["eyJ" * 300_000, ("eyJ" * 40_000 + ".") * 8, f"xx{part}.{part}.{part} {part}.{part}.abcdefgh.{part}.{part}", f"a.{part}.{part}.12345678.eyJ", f"eyJeyJeyJabcdefgh.{part}.{part}-eyJ", f"{part}.eyJshort.{part}.{part}.{part}", f"({part}.{part}.1234567)", f"{part}{part}.{part}.{part}é{part}.{part}.{part}"]
    began = time.perf_counter()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("jwt")] for r in secrets.secrets(docs).collect()}
    assert time.perf_counter() - began < 60
    for i, text in enumerate(texts[2:], 2):
        assert got[i] == [f"jwt:{m.start()}:{m.end()}" for m in re.finditer(rule.pattern, text)], text
    assert got[0] == [] and got[1] == ["jwt:0:360002", "jwt:360003:720005"]
