from __future__ import annotations

import random

from lodestone.operators import rank, search
from lodestone.operators.rank import best_of_many, bm25_scores, top_ranked

CHUNK = "chunk_ord struct<part:int,page:long,idx:long,record:string>, source_doc string, page_number long, text string, is_bibliography boolean, compounds array<string>, blocks array<string>"
WORDS = [f"w{i}" for i in range(40)]


def passages(spark):
    """Copies stand on several pages, so that scores tie; some pages have no key, as attached ones."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 30))) for _ in range(60)] * 3 + ["", "É other", "W1 w1 W2"]
    rows = [((0, i if i % 9 else None, i % 3, None if i % 9 else f"r{i}"), f"d{i % 4}", i // 5, t, i % 13 == 0, [], ["KEY"] if i % 5 else []) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, CHUNK)


def asked(spark, n):
    rng = random.Random(n)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 9)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "unheard"), (n + 1, "")], "question_id long, question string")


def rows_of(df):
    return sorted((r.question_id, r["rank"], str(r.chunk_ord), r.score) for r in df.collect())


def test_cells_rank_as_rows_do(spark, monkeypatch):
    chunks, questions = passages(spark), asked(spark, 40)
    wanted = rows_of(top_ranked(bm25_scores(chunks, questions), 4))
    assert rows_of(best_of_many(chunks, questions, 4)) == wanted
    for name, size in (("CELL_PASSAGES", 50), ("CELL_QUESTIONS", 10), ("AT_ONCE", 7)):
        monkeypatch.setattr(rank, name, size)
    assert rows_of(best_of_many(chunks, questions, 4)) == wanted
    assert rows_of(best_of_many(chunks.where("false"), questions, 4)) == rows_of(best_of_many(chunks, questions.where("question_id > 39"), 4)) == []


def test_many_questions_make_no_rows_of_pairs(spark, monkeypatch):
    chunks, questions = passages(spark), asked(spark, 60)
    past = spark.createDataFrame([(i, 0, "user", f"w{i % 40} w3") for i in range(60)], "question_id long, turn long, role string, text string")
    columns = ["question_id", "rank", "chunk_ord", "score"]
    monkeypatch.setattr(search, "SCORED_BY_ROWS", 1000)
    wanted = rows_of(search.conversation_hits(chunks, questions, past, "KEY").select(*columns))
    monkeypatch.undo()
    monkeypatch.setattr(search, "bm25_scores", None)
    assert wanted and rows_of(search.conversation_hits(chunks, questions, past, "KEY").select(*columns)) == wanted


def test_questions_go_to_passages_that_stay(spark, monkeypatch):
    """Without stored postings the rows are those of the join, for any number of slices, and only the best leave the scan."""
    chunks, questions = passages(spark), asked(spark, 40)
    columns = ["question_id", "rank", "chunk_ord", "score"]
    wanted = [rows_of(top_ranked(bm25_scores(chunks, questions, refs), 4)) for refs in (True, False)]
    monkeypatch.setattr(rank, "bm25_scores", None)
    found = rank.bm25_search(chunks, questions, 4)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows_of(found.select(*columns)) == wanted[0] and rows_of(rank.bm25_search(chunks, questions, 4, drop_references=False).select(*columns)) == wanted[1]
    monkeypatch.setattr(rank.A, "WIDE_SLICE_BYTES", 200)
    assert rows_of(rank.bm25_search(chunks, questions, 4).select(*columns)) == wanted[0]
    assert rows_of(rank.bm25_search(chunks, questions.where("question_id > 39"), 4).select(*columns)) == rows_of(rank.bm25_search(chunks.where("false"), questions, 4).select(*columns)) == []
    monkeypatch.undo()
    monkeypatch.setattr(rank, "SENT_TERMS", 3)
    assert rank.best_in_place(chunks, questions, 4) is None and rows_of(rank.bm25_search(chunks, questions, 4).select(*columns)) == wanted[0]


def test_many_questions_move_texts_few_times():
    """At 3 million passages and 250,000 questions a text is moved 4 times, a question and its best 75 times; few questions are still dealt to all cores."""
    assert rank.cells_of(3_000_000, 250_000, 12) == (75, 4)
    assert rank.cells_of(3_000_000, 30_000, 12) == (75, 1) and rank.cells_of(10_000, 5_000, 8) == (1, 10) and rank.cells_of(0, 0, 8) == (1, 1)
