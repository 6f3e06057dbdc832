from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import names as FN
from lodestone.functions import text as T
from lodestone.operators.chunking import chunk_pages
from lodestone.operators.names import candidate_names, frequent_names

VOCABULARY = ["ibuprofen", "menthol", "58-08-2", "3-methoxyaniline", "n-butylpropanamide"]


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def names_in(spark, text, vocabulary=VOCABULARY):
    chunks = spark.createDataFrame([(0, text)], "chunk_ord long, text string")
    return {r.name for r in candidate_names(chunks, spark.createDataFrame([(v,) for v in vocabulary], "name string")).collect()}


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Ibuprofen-Citric Acid", "ibuprofen"), ("Acid-Ibuprofen", "ibuprofen"), ("ibuprofen-like", "ibuprofen"), ("menthol-rich and men thol", "menthol"), ("58-08-2", "58-08-2"),
        ("n-butylpropanamide", "n-butylpropanamide"), ("3-methoxyaniline", "3-methoxyaniline"), ("with citric acid.", "citric acid"),
    ],
)
def test_names_are_found(spark, text, name):
    assert name in names_in(spark, text)


def test_names_are_not_invented(spark):
    assert "ibuprofen" not in names_in(spark, "pseudoibuprofen-unlisted")
    assert names_in(spark, "a long-lived common saying") == set()
    assert names_in(spark, "") == set()
    assert C.MAX_CANDIDATES == 500 and len(C.FALSE_FRIENDS) == 138 and len(C.SUFFIXES) == 23 and len(C.MORPHEMES) == 29


def test_morphemes(spark):
    assert column(spark, ["acetaminophen", "phenacetin", "paper", ""], FN.morpheme_count) == [3, 2, 0, 0]


def test_frequency_ties_go_by_name(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "b"), (1, "c"), (1, "a")], "chunk_ord long, name string")
    assert [tuple(r) for r in frequent_names(rows, 2).collect()] == [("b", 2), ("a", 1)]


def test_page_repair(spark):
    texts = ["parace-\ntamol", "co-crystal", "caf-  \n feine", "x‐y–z", "é-\né", None]
    assert column(spark, texts, T.repair_page_text) == ["paracetamol", "co-crystal", "caffeine", "x-y-z", "éé", None]


def windows(words, size=180, overlap=40):
    start, out = 0, []
    while start < len(words):
        end = min(start + size, len(words))
        out.append(" ".join(words[start:end]))
        if end == len(words):
            break
        start = max(end - overlap, start + 1)
    return out


@pytest.mark.parametrize(("size", "overlap"), [(180, 40), (5, 0), (3, 3), (4, 9)])
def test_chunks_follow_the_loop(spark, size, overlap):
    rng = random.Random(1)
    pages = [(i, "d", i, "  \n".join(f"w{j}" for j in range(n))) for i, n in enumerate([0, 1, 2, 5, 6, 17, 180, 181, 320, 321, rng.randrange(400, 900)])] + [(99, "d", 99, None), (98, "d", 98, "  \n")]
    got = chunk_pages(spark.createDataFrame(pages, "page_ord long, source_doc string, page_number int, text string"), size, overlap).collect()
    by_page = {}
    for r in sorted(got, key=lambda r: r.chunk_ord):
        by_page.setdefault(r.page_number, []).append(r.text)
    assert by_page == {p[0]: windows(p[3].split(), size, overlap) for p in pages if p[3] and p[3].split()}


def test_query_terms_and_follow_ups(spark):
    questions = ["Tell me about the solubility of solubility data", "what is it", "", "Which solvents dissolve paracetamol best at room temperature"]
    assert column(spark, questions, T.query_terms) == [["me", "solubility", "solubility"], ["what", "is", "it"], [], ["solvents", "dissolve", "paracetamol", "best", "room", "temperature"]]
    assert column(spark, questions, T.is_follow_up) == [True, True, True, False]


def test_bibliography(spark):
    texts = ["[CrossRef] [PubMed] doi", "one doi", "1. Adams, B. 2. Clark, D. 3. Evans, F.", "A.; B.; C.; D.; E.; F.; doi", "A.; B.; C.; D.; E.; F.;", ""]
    assert column(spark, texts, T.is_bibliography) == [True, False, True, True, False, False]


def test_small_text_functions(spark):
    assert column(spark, ["58-08-2", "1-2-3"], T.is_registry_number) == [True, False]
    assert column(spark, ["A_melting_points.pdf", "remarks.pdf", "a/b/C_x.y.pdf"], T.paper_id) == ["A", "remarks", "C"]
    assert column(spark, ["Plot it", "charts", "visualize"], T.is_plot_request) == [True, False, True]
    assert [len(x) for x in column(spark, ["x" * 300, "x" * 240], T.preview)] == [241, 240]
    found = spark.createDataFrame([("a ca ffeine b", "caffeine"), ("x CA-FFEINE", "caffeine"), ("x (a)b", "(a)b")], "t string, n string")
    assert [r.x for r in found.select(F.expr("1 = 1"), F.rlike("t", T.loose_pattern(F.col("n"))).alias("x")).collect()] == [True, True, True]
    exact = spark.createDataFrame([("écaffeine", "caffeine"), ("Caffeine.", "caffeine"), ("a+b c", "a+b")], "t string, n string")
    assert [r.x for r in exact.select(F.rlike("t", T.exact_name_pattern(F.col("n"))).alias("x")).collect()] == [False, True, True]
