"""What the index's cost hangs on: nothing but documents, names and terms' counts is moved, and tokens over bytes are those of the expressions."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import tokens
from lodestone.functions.names import NameRules
from lodestone.operators import coverage, index, names, rank, search
from lodestone.operators.chunking import chunk_pages
from lodestone.plans import catalog, fixtures
from lodestone.plans.oracle import ORACLE

TEXTS = [
    "of the nicotinic acid of-the [Nicotinic] acid, ofthe ((-)) of ( the acid", "", None, " \t\n", "a b c   d é\u0085f　g\x1ch​i᠎j", "(R)-of-the ofthe-x x-ofthe KELVIN K12 ẞİ ÉTÉ",
    "word " * 400, "'acid' basic acid basic-acid basic acid", "of\nthe ofthe", "co-\n op re-\xa0\nturn end - \n x", "ofthe", "acid", "naïve-acid ofthé the of",
]
RULES = NameRules(suffixes=("the", "ion"))


@pytest.fixture(scope="module")
def cut(spark):
    pages = spark.createDataFrame([(i, "d", i, t) for i, t in enumerate(TEXTS)], "page_ord long, source_doc string, page_number long, text string")
    return chunk_pages(pages, 50, 10)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_windows_are_those_of_words(spark, cut):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string").select("i", T.words(T.repair_page_text(F.col("text"))).alias("w")).collect()
    want = [(r.i, k, " ".join(r.w[40 * k : 40 * k + 50])) for r in rows if r.w for k in range(1 if len(r.w) <= 50 else 1 + -(-(len(r.w) - 50) // 40))]
    assert [(r.page_number, r.chunk_idx, r.text) for r in cut.orderBy("page_number", "chunk_idx").collect()] == want


def test_postings_are_counted_where_passages_stand(cut):
    stored = rank.postings(cut)
    assert "Exchange" not in plan(stored)
    tokens = cut.select("chunk_ord", T.tokenize(F.col("text")).alias("t")).select("chunk_ord", F.size("t").alias("length"), F.explode("t").alias("term"))
    want = tokens.groupBy("term", "chunk_ord", "length").agg(F.count("*").alias("tf")).select("term", "chunk_ord", "tf", "length")
    assert sorted(map(str, stored.drop("is_bibliography").collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("most", [5000, 1])
def test_names_are_counted_and_written_back_as_they_are_found(spark, cut, most):
    vocabulary = spark.createDataFrame([("ofthe",), ("acid",), ("of-the",), ("xofthe",)], "name string")
    found = names.candidate_names(cut, vocabulary, RULES)
    counted = names.name_frequencies(cut, vocabulary, RULES, most)
    assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in names.frequent_names(found, 1000).collect()}
    held = names.names_found(cut, vocabulary, RULES, most)
    assert sorted(map(str, held.collect())) == sorted(map(str, found.collect())) and ("Exchange" in plan(held)) == (most == 1)
    known = found.select("name").distinct().withColumn("block", F.left("name", F.lit(2)))
    columns = ["chunk_ord", "compounds", "blocks"]
    joined = index.annotated(cut, known, vocabulary, RULES, most=0)
    written = index.annotated(cut, known, vocabulary, RULES)
    assert "Exchange" not in plan(written)
    assert sorted(map(str, written.select(*columns).collect())) == sorted(map(str, joined.select(*columns).collect()))


def test_structure_postings_move_nothing(spark, cut):
    known = spark.createDataFrame([("ofthe", "A"), ("nicotinic acid", "B"), ("acid", "B")], "name string, block string")
    vocabulary = spark.createDataFrame([("ofthe",), ("acid",)], "name string")
    held = index.structure_postings(index.annotated(cut, known, vocabulary, RULES), known)
    assert "Exchange" not in plan(held)
    assert {(r.chunk_ord.page, r.block, tuple(r.names)) for r in held.collect() if r.chunk_ord.page == 0} == {(0, "A", ("ofthe",)), (0, "B", ("nicotinic acid",))}


def test_a_text_that_many_ask_is_ranked_once(spark, monkeypatch):
    rows = [((0, i), f"d{i % 3}", i, f"red stone {'salt ' * (i % 5)}", False, ["n"], ["B"]) for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_ord struct<part:int,page:int>, source_doc string, page_number int, text string, is_bibliography boolean, compounds array<string>, blocks array<string>")
    questions = spark.createDataFrame([(i, q) for i, q in enumerate(["salt", "red salt", "salt", None, "salt"])], "question_id long, question string")
    none = spark.createDataFrame([], "question_id long, turn long, role string, text string")
    asked = []
    scores = search.bm25_scores
    monkeypatch.setattr(search, "bm25_scores", lambda scope, texts, **more: asked.append(texts.count()) or scores(scope, texts, **more))
    hits = {}
    for r in search.conversation_hits(chunks, questions, none, "B").orderBy("rank").collect():
        hits.setdefault(r.question_id, []).append((r.chunk_ord, r.score, r.rank))
    assert asked == [2] and len(hits) == 5 and hits[0] == hits[2] == hits[4] and hits[0][0][1] is not None and hits[3][0][1] is None


def test_postings_are_stored_as_lists(spark, cut):
    """One row for a term of a slice and a kind of passages, so that what is written grows with lists, not rows; only a question's terms are unpacked."""
    kinds = cut.withColumn("is_bibliography", F.col("chunk_ord.page") % 2 == 0)
    lists = rank.posting_lists(kinds.coalesce(1))
    rows = lists.collect()
    assert len(rows) == len({(r.term, r.is_bibliography) for r in rows}) and {len(r.chunk_ord.page) for r in rows} > {1}
    assert all(len(r.chunk_ord.page) == len(r.tf) == len(r.length) and r.df == (0 if r.is_bibliography else len(r.tf)) for r in rows)
    held = sorted(map(str, rank.unpacked(lists).where("term in ('of', 'acid')").collect()))
    picked = rank.postings_of(lists, spark.createDataFrame([("of",), ("acid",), ("nowhere",)], "term string"))
    assert held and sorted(map(str, picked.collect())) == held
    assert plan(picked).index("Generate") < plan(picked).index("BroadcastHashJoin")


def test_sizes_and_reference_lists_are_those_of_the_expressions(spark):
    texts = [*TEXTS, "\u212aELVIN \u0130STANBUL 12", "see DOI doi doi", "doi A.B.; C.; D.; E.; F.; G.,", "1. Smith, J. 22. O'Neil, K. 333. Li, M.", "1. a 2. b 3. c", "[CrossRef] [pubmed] [PubMed]"]
    pages = spark.createDataFrame([(i, "d", i, t) for i, t in enumerate(texts)], "page_ord long, source_doc string, page_number long, text string")
    rows = chunk_pages(pages, 50, 10, counted=True).select("n_tokens", F.size(T.tokenize(F.col("text"))).alias("n"), "is_bibliography", T.is_bibliography(F.col("text")).alias("b")).collect()
    assert [(r.n_tokens, r.is_bibliography) for r in rows] == [(r.n, r.b) for r in rows] and sum(r.b for r in rows) == 4


def test_ends_of_names_are_stripped_however_long(spark):
    texts = ["(" * 40 + "acid" + ")" * 40 + " " + "'" * 30 + " [(x-1)], (a", "((((((((((((b]]]]]]]]]]]", "-a- (,) c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select(T.name_tokens(F.col("text")).alias("t")).collect()
    found = tokens.name_tokens(pa.array(texts))
    assert [[found.words[c].decode() for c, t in zip(found.code, found.text, strict=True) if t == i] for i in range(len(texts))] == [r.t for r in rows]


@pytest.mark.parametrize("name", ["checked_retrieval", "build_context", "evidence_export"])
def test_queries_of_one_structure_rank_by_stored_postings(spark, monkeypatch, name):
    class Asked(Exception):
        pass

    def asked(*args, **given):
        raise Asked(given.get("stored"), given.get("entities"))

    monkeypatch.setattr(catalog, "index_of", lambda *_: index.Index(spark.range(1), None, "entities", postings="postings"))
    monkeypatch.setattr(search, "structure_search", asked)
    with pytest.raises(Asked) as found:
        catalog.QUERIES[name](spark, "")
    assert found.value.args == ("postings", "entities")


@pytest.mark.parametrize("some", [["Caffeine", "red", "nowhere"], ["--"], []])
def test_names_are_tried_where_texts_stand(spark, monkeypatch, some):
    """No text is moved to meet the names' postings, and the rows are those of the join with them, which more names take."""
    rows = [((0, i), "d", i, t, b) for i, (t, b) in enumerate([("red caffeine", ["B"]), ("REDS -- caf feine", ["B"]), ("Caffeine red-stone", []), ("plain", ["A"]), ("a--b red", ["A", "B"]), ("caffeines", ["B"])])]
    chunks = spark.createDataFrame(rows, "chunk_ord struct<part:int,page:int>, source_doc string, page_number int, text string, blocks array<string>")
    known = spark.createDataFrame([(n, "B") for n in some] + [("plain", "A")], "name string, block string")
    stored = rank.postings(chunks)

    def found():
        return [coverage.name_counts(chunks, coverage.query_names(known, "B"), stored), coverage.unreachable(chunks, known, "B", stored=stored), coverage.reach_report(chunks, known, "B", "Plain", stored), coverage.set_difference(chunks, "red", "B", stored)]

    scanned = found()
    assert "Exchange" not in plan(scanned[1]) and not any("Join" in plan(frame) for frame in scanned[1:])
    monkeypatch.setattr(coverage, "NAMES_IN_SCAN", -1)
    joined = found()
    assert "Join" in plan(joined[3])
    assert [sorted(map(str, frame.collect())) for frame in scanned] == [sorted(map(str, frame.collect())) for frame in joined]
    assert [frame.dtypes for frame in scanned] == [frame.dtypes for frame in joined]


def test_a_name_counts_in_any_case_also_where_lower_case_keeps_a_letter(spark):
    chunks = spark.createDataFrame([((0, 1), "a re\u017fin")], "chunk_ord struct<part:int,page:int>, text string")
    assert coverage.name_counts(chunks, spark.createDataFrame([("resin",)], "name string"), rank.postings(chunks)).first().n_chunks == 1


def test_terms_reach_the_scan_of_stored_postings(spark, cut, tmp_path):
    rank.posting_lists(cut).write.parquet(str(tmp_path / "postings"))
    stored = spark.read.parquet(str(tmp_path / "postings"))
    for n in (2, rank.NAMED_TERMS, rank.NAMED_TERMS + 1):
        wanted = spark.createDataFrame([("of",), (None,)] + [(f"t{i}",) for i in range(1, n)], "term string")
        picked = rank.postings_of(stored, wanted)
        assert n > 2 or "EqualTo(term," in plan(picked)
        assert ("t1)" in picked._jdf.queryExecution().optimizedPlan().toString()) == (n <= rank.NAMED_TERMS)
        assert sorted(map(str, picked.collect())) == sorted(map(str, rank.unpacked(stored).where("term = 'of'").collect())) != []
    assert rank.postings_of(stored, wanted.limit(0)).count() == 0


def test_hits_of_pages_are_not_ranked_to_be_counted(spark, monkeypatch):
    given = []
    monkeypatch.setattr(catalog, "index_of", lambda *_: index.Index(None, None, None))
    monkeypatch.setattr(search, "structure_search", lambda *_, **__: None)
    monkeypatch.setattr(search, "expand_source_pages", lambda hits, chunks, few=None: given.append(few) or spark.createDataFrame([], "rank int, source_doc string, page_number long, text string, anchor_text string, context_scope string, context_chunks int"))
    catalog.QUERIES["page_expansion"](spark, "")
    assert given == [True]


def test_literal_candidates_are_found_where_texts_stand(spark):
    """No token is a row, and the names are those of the rules one by one."""
    sf_dir = "/root/testdata/sf0.001"
    found = catalog.QUERIES["candidate_literal"](spark, sf_dir)
    assert "Generate" not in plan(found) and "Join" not in plan(found)
    vocabulary = spark.createDataFrame([(v,) for v in fixtures.VOCABULARY], "name string")
    want = names.candidate_names(catalog.name_texts(spark, sf_dir), vocabulary).select(*catalog.place(), "name")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) != []


def test_no_name_is_too_rare_for_the_index(spark):
    """A structure's name behind 500 more frequent ones is found; a caller may still ask for the most frequent alone."""
    words = " ".join(f"w{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26]}ine" for i in range(520))
    pages = spark.createDataFrame([(0, "d", 0, words), (1, "d", 1, words), (2, "d", 2, "a zzcaffeine")], "page_ord long, source_doc string, page_number long, text string")
    lexicon = spark.createDataFrame([("zzcaffeine", "Cn1c(=O)c2c(ncn2C)n(C)c1=O")], "name string, smiles string")
    built = index.build_index(pages, lexicon)
    assert [r.name for r in built.compounds.collect()] == ["zzcaffeine"] and built.chunks.where("size(blocks) > 0").count() == 1
    assert built.frequencies.count() == 521 and index.build_index(pages, lexicon, max_candidates=500).compounds.count() == 0


@pytest.mark.parametrize("name", ["attach_tables", "chat_messages", "evidence_export", "index_totals", "scoped_documents_search", "set_difference", "structure_filter"])
def test_queries_of_the_whole_index(monkeypatch, name):
    class Asked(Exception):
        pass

    def asked(spark, sf_dir, most=500):
        raise Asked(most)

    monkeypatch.setattr(catalog, "index_of", asked)
    monkeypatch.setattr(catalog, "conversation_turns", lambda *_: (None, None))
    monkeypatch.setattr(catalog.X, "lexicon", lambda *_: fixtures)
    monkeypatch.setattr(fixtures, "unionByName", lambda _: None, raising=False)
    monkeypatch.setattr(catalog.X, "frame", lambda *_: None)
    with pytest.raises(Asked) as found:
        catalog.QUERIES[name](None, "")
    assert found.value.args == (None,) and f"limit {fixtures.MAX_CANDIDATES}" not in ORACLE[name]


def test_words_that_are_no_names_are_left_out_where_they_stand(spark):
    words = ["paracetamol", "n-xyz", "3-methoxyaniline", "water", "ine", "plain", "aqweine", "x-1,2-y", "methylphen", "k12-3", "machine", "chlorobenzoates", "o-1", "s-abc1"]
    chunks = spark.createDataFrame([((0, 1), " ".join(words))], "chunk_ord struct<part:int,page:int>, text string")
    vocabulary = spark.createDataFrame([("x",)], "name string")
    found, want = names.names_found(chunks, vocabulary), names.candidate_names(chunks, vocabulary)
    assert sorted(r.name for r in found.collect()) == sorted(r.name for r in want.collect()) and found.count() > 4
    may = names._may_be_names(pa.array([w.encode() for w in words], pa.large_binary()), NameRules())
    assert [w for w, m in zip(words, may, strict=True) if not m] == ["ine", "plain", "o-1"]
