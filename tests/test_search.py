from __future__ import annotations

import math
import random
import re
from itertools import zip_longest

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import tokenize
from lodestone.operators import chat, coverage, index, search
from lodestone.operators import resolve as R
from lodestone.operators.chunking import chunk_pages
from lodestone.operators.rank import bm25_scores, bm25_search, postings
from lodestone.plans import fixtures
from lodestone.sources.adapters import pdf_pages
from lodestone.sources.tables import evidence_json, merged_cache, read_index, read_lexicon, write_index, write_name_cache

CHUNK = "chunk_ord long, source_doc string, page_number long, text string, is_bibliography boolean, compounds array<string>, blocks array<string>"
B = "KEY"
TOKENS = "red green blue stone water salt acid heat light form".split()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = " ".join(rng.choice(TOKENS) for _ in range(rng.randrange(1, 25)))
        rows.append((i, f"d{i % 3}", i // 6, words, i % 11 == 0, sorted({rng.choice("xyz") for _ in range(i % 4)}), [B] if i % 2 else []))
    return rows


def reference_bm25(question, rows, k):
    rows = [r for r in rows if not r[4]]
    tokens = [r[3].split() for r in rows]
    mean = sum(map(len, tokens)) / len(tokens)
    out = []
    for row, own in zip(rows, tokens, strict=True):
        score = 0.0
        for t in question.split():
            df = sum(t in x for x in tokens)
            tf = own.count(t)
            if tf:
                score += math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / mean))
        if score > 0:
            out.append((round(score, 3), row))
    return sorted(out, key=lambda x: -x[0])[:k]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(corpus(), CHUNK).cache()


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "question_id long, question string")


def ids(df):
    return [r.chunk_ord for r in df.orderBy("question_id", "rank").collect()]


@pytest.mark.parametrize("question", ["red stone", "red red water salt", "light"])
def test_bm25(spark, chunks, question):
    got = bm25_search(chunks, asked(spark, question), 8).orderBy("rank").collect()
    want = reference_bm25(question, corpus(), 8)
    assert [(r.chunk_ord, r.score) for r in got] == [(w[1][0], pytest.approx(w[0], abs=1.1e-3)) for w in want]
    assert not bm25_search(chunks, asked(spark, "nothing"), 8).collect()


def test_scope_decides_statistics_and_order_of_rows_does_not(spark, chunks):
    scope = [r for r in corpus() if B in r[6]]
    got = search.structure_search(chunks.orderBy(F.rand(3)), asked(spark, "red water"), B, 5)
    assert ids(got) == [w[1][0] for w in reference_bm25("red water", scope, 5)]
    assert {r.route for r in got.collect()} == {"structure"}


def test_fallback_goes_by_number_of_names(spark, chunks):
    scope = sorted((r for r in corpus() if B in r[6] and not r[4]), key=lambda r: (-len(r[5]), r[0]))[:4]
    for question in ("", "nothing here", None):
        rows = search.structure_search(chunks, asked(spark, question), B, 4)
        assert ids(rows) == [r[0] for r in scope] and all(r.score is None for r in rows.collect())
    assert search.structure_search(chunks, asked(spark, "red"), "ABSENT").count() == 0


def test_hybrid_takes_turns(spark, chunks):
    q = asked(spark, "red water")
    s, t = ids(search.structure_search(chunks, q, B, 6)), ids(bm25_search(chunks, q, 6))
    order = list(dict.fromkeys(x for pair in zip_longest(s, t) for x in pair if x is not None))[:6]
    assert ids(search.hybrid_search(chunks, q, B, 6)) == order


def history(spark, *turns):
    return spark.createDataFrame([(0, i, role, text) for i, (role, text) in enumerate(turns)], "question_id long, turn long, role string, text string")


TURNS = [("user", "Which salts dissolve in ethanol?"), ("assistant", "Two of them do [Source 1]."), ("user", "How fast do crystals grow?"), ("assistant", "Growth slows with cooling [Source 2].")]


def test_retrieval_query(spark):
    q = asked(spark, "Tell me more about those.")
    text = search.retrieval_query(q, history(spark, *TURNS)).first().contextual
    assert text == "Which salts dissolve in ethanol? How fast do crystals grow? Growth slows with cooling . Tell me more about those."
    long = search.retrieval_query(asked(spark, " ".join(TOKENS[:9])), history(spark, *TURNS)).first().contextual
    assert "cooling" not in long and "crystals" in long
    assert search.retrieval_query(q, history(spark, *TURNS), carry=0).first().contextual == "Tell me more about those."
    assert search.retrieval_query(q, history(spark)).first().contextual == "Tell me more about those."
    many = [("user", f"q{i}") for i in range(9)]
    assert search.retrieval_query(q, history(spark, *many)).first().contextual.startswith("q6 q7 q8 Tell")


def test_conversation_stays_on_the_structure(spark, chunks):
    scope = [r for r in corpus() if B in r[6]]
    past = history(spark, ("user", "salt acid"), ("assistant", "heat light"))
    current, context = reference_bm25("red", scope, 6), reference_bm25("salt acid heat light red", scope, 6)
    order = list(dict.fromkeys(w[1][0] for pair in zip_longest(current, context) for w in pair if w))[:6]
    assert ids(search.conversation_hits(chunks, asked(spark, "red"), past, B)) == order
    assert ids(search.conversation_hits(chunks, asked(spark, "red"), history(spark), B)) == [w[1][0] for w in current]
    silent = search.conversation_search(chunks, asked(spark, "zzz"), history(spark), B)
    assert silent.count() > 0 and {r.context_scope for r in silent.collect()} == {"same-page expansion"}


def test_page_expansion_says_shared_words_once(spark):
    rows = [(0, "d", 1, "a b c d e", False, [], [B]), (1, "d", 1, "d e f g", False, [], []), (2, "d", 1, "g h", False, [], []), (3, "d", 1, "doi list", True, [], []), (4, "d", 2, "x x x", False, [], [B]), (5, "d", 2, "x x y", False, [], [])]
    chunks = spark.createDataFrame(rows, CHUNK)
    hits = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 4)], "question_id long, rank int, chunk_ord long").join(chunks, "chunk_ord")
    got = {r.page_number: (r.text, r.anchor_text, r.context_chunks, r.rank) for r in search.expand_source_pages(hits, chunks).collect()}
    assert got == {1: ("a b c d e f g h", "a b c d e", 3, 1), 2: ("x x x y", "x x x", 2, 3)}


def test_checked_retrieval(spark, chunks):
    for question, k in (("", 3), (" ", 3), ("red", 0), ("red", 21), ("red", True), ("red", 2.0)):
        with pytest.raises(ValueError, match="question|top_k"):
            search.checked_retrieval(chunks, question, B, k)
    assert all(r.on_structure for r in search.checked_retrieval(chunks, "red", B, 3).collect())


def test_resolution_tiers_and_keys(spark):
    lexicon = spark.createDataFrame([("paracetamol", "CC(=O)Nc1ccc(O)cc1"), ("apap", "CC(=O)Nc1ccc(O)cc1"), ("water", "O"), ("maleic acid", "O=C(O)/C=C\\C(=O)O"), ("fumaric acid", "O=C(O)/C=C/C(=O)O"), ("salt", "CC(=O)Nc1ccc(O)cc1.Cl")], "name string, smiles string")
    cache = spark.createDataFrame([("nothing", None), ("water", "CCCC")], "name string, smiles string")
    names = spark.createDataFrame([(" Paracetamol",), ("apap",), ("water",), ("nothing",), ("new",), ("maleic acid",), ("fumaric acid",), ("salt",)], "name string")
    tiers = {r.name: (r.smiles is not None, r.tier) for r in R.resolve(names, lexicon, cache).collect()}
    assert tiers["paracetamol"] == (True, "lexicon") and tiers["nothing"] == (False, "cache") and tiers["new"] == (False, "unresolved")
    assert [r.name for r in R.unresolved(names, lexicon, cache).collect()] == ["new"]
    known = R.compounds(R.resolve(names, lexicon, cache))
    groups = sorted(r.names for r in R.synonym_groups(known).collect())
    assert groups == [["apap", "paracetamol", "salt"], ["fumaric acid", "maleic acid"]]
    assert "water" not in {r.name for r in known.collect()}
    assert known.where("name = 'apap'").first().block == fixtures.SUBJECT_BLOCK
    assert merged_cache(cache, spark.createDataFrame([("nothing", "C"), ("new", None)], "name string, smiles string")).count() == 3


def test_index_round_trip_and_documents(spark, tmp_path):
    pages = spark.createDataFrame([(0, "A.pdf", 1, "caffeine and theobromine " * 100), (1, "A.pdf", 2, "ca ffeine here"), (2, "B.pdf", 1, "nothing of note")], "page_ord long, source_doc string, page_number int, text string")
    (tmp_path / "lexicon.json").write_text('{"caffeine": "Cn1c(=O)c2c(ncn2C)n(C)c1=O", "theine": "Cn1c(=O)c2c(ncn2C)n(C)c1=O", "water": null}')
    lexicon = read_lexicon(spark, str(tmp_path / "lexicon.json"))
    assert read_lexicon(spark, str(tmp_path / "absent.json")).count() == 0
    built = index.build_index(pages, lexicon)
    write_index(built, str(tmp_path / "index"))
    again = read_index(spark, str(tmp_path / "private"), str(tmp_path / "index"))
    assert sorted(map(str, again.chunks.collect())) == sorted(map(str, built.chunks.collect()))
    with pytest.raises(FileNotFoundError):
        read_index(spark, str(tmp_path / "private"))
    block = again.compounds.first().block
    assert [tuple(r) for r in search.documents_for_structure(again.chunks, again.compounds, block).collect()] == [("A.pdf", ["caffeine"])]
    report = coverage.reach_report(again.chunks, again.compounds, block, "Caffeine").first()
    assert (report.n_structure, report.n_union, report.adds, report.misses, report.best_name, report.n_names) == (3, 2, 1, 0, "caffeine", 1)
    alone = coverage.unreachable(again.chunks, again.compounds, block).collect()
    assert [(r.fragment, r.snippet) for r in alone] == [("ca ffeine", "ca ffeine here")]
    totals = coverage.index_totals(again.chunks, again.compounds).first()
    assert (totals.n_chunks, totals.n_annotated, totals.n_names) == (4, 3, 1)
    write_name_cache(spark.createDataFrame([("b", None), ("a", "C")], "name string, smiles string"), str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_files_to_answers(spark, tmp_path):
    """From file bytes to hits: pages in order of paths, keys that no other page has, however long a path or a page is."""
    files = tmp_path / "files"
    (files / ("deep" * 40)).mkdir(parents=True)
    (files / "b.pdf").write_bytes(b"caffeine melts|theine dissolves")
    (files / ("deep" * 40) / "a.pdf").write_bytes(b"caffeine " * 1000 + b"|nothing of note")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(files)).select("path", "content")
    pages = pdf_pages(found, lambda content: content.decode().split("|"))
    lexicon = spark.createDataFrame([("caffeine", "Cn1c(=O)c2c(ncn2C)n(C)c1=O"), ("theine", "Cn1c(=O)c2c(ncn2C)n(C)c1=O")], "name string, smiles string")
    built = index.build_index(pages, lexicon, folder=str(tmp_path / "staged"))
    write_index(built, str(tmp_path / "index"))
    again = read_index(spark, str(tmp_path / "index"))
    order = [(r.source_doc, r.page_number) for r in again.chunks.orderBy("chunk_ord").collect()]
    assert order == [("b.pdf", 1), ("b.pdf", 2)] + [("a.pdf", 1)] * 7 + [("a.pdf", 2)] and again.chunks.select("chunk_ord").distinct().count() == 10
    hits = search.structure_search(again.chunks, asked(spark, "melts dissolves"), again.compounds.first().block, 3, stored=again.postings).orderBy("rank").collect()
    assert [(h.source_doc, h.page_number) for h in hits] == [("b.pdf", 1), ("b.pdf", 2)]
    pages_ = search.expand_source_pages(search.structure_search(again.chunks, asked(spark, "caffeine"), again.compounds.first().block, 9), again.chunks)
    assert pages_.where("source_doc = 'a.pdf'").count() == 1


def test_keys_hold_any_page_and_any_number_of_passages(spark):
    most = 2**63 - 1
    pages = spark.createDataFrame([(-most - 1, "d", 1, "x"), (most, "d", 2, "y " * 5), (7, "d", 3, "z " * 100_105), (8, "d", 4, "w")], "page_ord long, source_doc string, page_number long, text string")
    chunks = chunk_pages(pages, chunk_words=1, overlap_words=0)
    assert chunks.count() == chunks.select("chunk_ord").distinct().count() == 1 + 5 + 100_105 + 1
    assert [r.page_number for r in chunks.where("chunk_idx = 0").orderBy("chunk_ord").collect()] == [1, 3, 4, 2]


def test_names_by_stored_postings(spark, chunks):
    names = spark.createDataFrame([("red",), ("stone-water",), ("Blue",), ("--",), ("redd",)], "name string")
    rows = spark.createDataFrame([(1, "red stone-water"), (2, "stone water blue"), (3, "reds"), (4, "stone-waters, BLUE -- x"), (5, "a--b")], "chunk_ord long, text string")
    want = {("red", 1), ("stone-water", 1), ("Blue", 2), ("Blue", 4), ("--", 5)}
    assert {tuple(r) for r in coverage.name_hits(rows, names).collect()} == want
    assert {tuple(r) for r in coverage.name_hits(rows, names, postings(rows)).collect()} == want


def test_bm25_reads_its_chunks_once(spark, tmp_path):
    spark.createDataFrame(corpus(), CHUNK).write.parquet(str(tmp_path / "chunks"))
    scores = bm25_scores(spark.read.parquet(str(tmp_path / "chunks")), asked(spark, "red stone"))
    scores.collect()
    plan = scores._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") <= 1 + plan.count("Reused")
    empty = spark.createDataFrame([], CHUNK)
    assert bm25_scores(empty, asked(spark, "red")).count() == 0


def test_chat_payload(spark, chunks):
    q = asked(spark, "red water", "other")
    hits = search.structure_search(chunks, q.limit(1), B, 2)
    contexts = chat.build_context(hits, "OTHER")
    text = contexts.first().context
    assert text.startswith("[Source 1] d") and "SUBJECT: NO - different molecule | context: matched chunk\n" in text and "\n\n[Source 2]" in text
    sent = {r.question_id: r.messages for r in chat.messages(q, contexts, history(spark, *TURNS * 2), "system").collect()}
    assert sent[1] is None and [m.role for m in sent[0]] == ["system", *["user", "assistant"] * 3, "user"]
    assert sent[0][-1].content == f"Context:\n{text}\n\nQuestion: red water\n"
    assert '"smiles":"C"' in evidence_json(hits, "q", "C", B).first().json


def test_follow_up_suggestions(spark):
    raw = ['It melts. <followups>["When?", "When?"]</followups>', "It melts. <followups>soon</followups>", "no tag ", f'x <followups>["{"y" * 181}", 3, "a", "b", "c", "d"]</followups>']
    rows = chat.split_follow_ups(spark.createDataFrame(list(enumerate(raw)), "answer_id int, raw string")).orderBy("answer_id").collect()
    assert [(r.body, r.followups) for r in rows] == [("It melts.", ["When?"]), ("It melts.", []), ("no tag ", []), ("x", ["a", "b", "c"])]


def test_stored_postings_give_the_same_ranking(spark, chunks):
    stored = postings(chunks)
    counted = chunks.withColumn("n_tokens", F.size(tokenize(F.col("text"))))
    q = asked(spark, "red water", "", "salt acid heat")
    for plain, quick in ((search.structure_search(chunks, q, B, 5), search.structure_search(counted, q, B, 5, stored=stored)), (search.hybrid_search(chunks, q, B, 5), search.hybrid_search(counted, q, B, 5, stored))):
        columns = ["question_id", "rank", "chunk_ord", "score", "route"]
        assert sorted(map(str, plain.select(*columns).collect())) == sorted(map(str, quick.select(*columns).collect()))


def moved_columns(frame) -> list[str]:
    """What the exchanges of a plan carry."""
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    blocks = frame._jdf.queryExecution().explainString(mode).split("\n\n")
    return [line for b in blocks if re.match(r"\(\d+\) (Broadcast)?Exchange", b.strip()) for line in b.splitlines() if line.startswith("Input")]


def test_searches_move_no_texts_and_read_one_structure(spark, tmp_path):
    """With broadcasts by size off, as large tables have it: only keys are exchanged, and the structure's rows are picked in the scan."""
    pages = spark.createDataFrame([(i, f"d{i % 4}.pdf", i, f"caffeine and {TOKENS[i % 10]} {TOKENS[(i * 7) % 10]} theine") for i in range(40)], "page_ord long, source_doc string, page_number int, text string")
    lexicon = spark.createDataFrame([("caffeine", "Cn1c(=O)c2c(ncn2C)n(C)c1=O"), ("theine", "CN1C=NC2=C1C(=O)N(C)C(=O)N2C")], "name string, smiles string")
    path = str(tmp_path / "index")
    build = index.build_index(pages, lexicon, folder=str(tmp_path / "staged"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not any("text#" in line for line in moved_columns(build.chunks))
        write_index(build, path)
        built = read_index(spark, path)
        block = built.compounds.first().block
        assert built.entities.where(F.size("names") == 2).count() == 40
        q, past = asked(spark, "red stone", "its heat"), history(spark, ("user", "salt acid"), ("assistant", "heat light"))
        more = {"stored": built.postings, "entities": built.entities}
        found = [
            bm25_search(built.chunks, q, 5, stored=built.postings, terms=built.terms), search.structure_search(built.chunks, q, block, 5, **more), search.hybrid_search(built.chunks, q, block, 5, built.postings, built.terms, built.entities),
            search.conversation_hits(built.chunks, q, past, block, **more), search.compare_routes(built.chunks, q, block, 5, built.postings, built.terms, built.entities),
        ]
        for frame in found:
            assert moved_columns(frame) and not any("text#" in line and ("chunk_ord#" in line or "source_doc#" in line) for line in moved_columns(frame))
        plain = [bm25_search(built.chunks, q, 5), search.structure_search(built.chunks, q, block, 5), search.hybrid_search(built.chunks, q, block, 5), search.conversation_hits(built.chunks, q, past, block)]
        columns = ["question_id", "rank", "chunk_ord", "score", "route"]
        for quick, slow in zip(found, plain, strict=False):
            assert sorted(map(str, quick.select(*columns).collect())) == sorted(map(str, slow.select(*columns).collect()))
        scan = search.with_block(None, block, built.entities)._jdf.queryExecution().executedPlan().toString()
        assert f"EqualTo(block,{block})" in scan and "blocks#" not in scan
        read = found[0]._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"Relation \[[^\]]*tf#", read)) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
