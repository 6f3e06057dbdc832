"""Retrieval by text, by structure, by both, and in conversations.

Chunks here are annotated ones, with ``compounds`` and ``blocks``. Result rows keep the chunk's columns and add
question_id, score, rank and route. ``stored`` postings of the index save the scan of all texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import text as T
from lodestone.functions.sizes import sent_if_few
from lodestone.operators.rank import best_of_many, bm25_scores, bm25_search, few_hits, top_ranked, with_passages

#: What ranking needs of a passage besides its postings.
LIGHT = ["chunk_ord", "source_doc", "page_number", "is_bibliography", "n_tokens", "n_names", "head_key", "text_key"]

#: Questions of conversations whose pairs with passages may be rows.
SCORED_BY_ROWS = 50


def light_columns(chunks: DataFrame) -> dict[str, Column]:
    """Expressions of ``LIGHT``: stored columns where chunks have them, else from texts and names."""
    made = {"n_tokens": F.size(T.tokenize(F.col("text"))), "n_names": F.size("compounds"), "head_key": F.md5(F.left("text", F.lit(C.MARKER_CHARACTERS)).cast("binary")), "text_key": F.md5(F.col("text").cast("binary"))}
    return {c: F.col(c) if c in chunks.columns else made[c] for c in LIGHT}


def light(chunks: DataFrame) -> DataFrame:
    """Passages without their texts."""
    return chunks.select(*[v.alias(c) for c, v in light_columns(chunks).items()])


def with_block(chunks: DataFrame, block: str, entities: DataFrame | None = None) -> DataFrame:
    """Chunks that hold the structure key. From ``entities`` of the index, which are in order of keys, only this key's rows are read; they have the ``LIGHT`` columns and ``names``."""
    return entities.where(F.col("block") == block) if entities is not None else chunks.where(F.array_contains("blocks", block))


def in_documents(chunks: DataFrame, documents: list[str] | None) -> DataFrame:
    """Chunks of the chosen documents, all for none; to be applied before ranking, as statistics follow the scope."""
    return chunks.where(F.col("source_doc").isin(*documents)) if documents else chunks


def _by_richness(scope: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Without any text to go by: the keys of chunks with most names first, in corpus order, without a score."""
    first = light(scope).orderBy(F.desc("n_names"), "chunk_ord").limit(k)
    order = Window.partitionBy("question_id").orderBy(F.desc("n_names"), "chunk_ord")
    rows = questions.select("question_id").crossJoin(F.broadcast(first))
    return rows.select("question_id", "chunk_ord", F.lit(None).cast("double").alias("score"), F.row_number().over(order).alias("rank"))


def _or_else(ranked: DataFrame, fallback: DataFrame) -> DataFrame:
    """The ranked rows of each question, and the fallback's where it has none. Both meet once, so that the ranking isn't made a second time to find out."""
    rows = ranked.withColumn("given", F.lit(True)).unionByName(fallback.withColumn("given", F.lit(False)))
    return rows.withColumn("any_given", F.max("given").over(Window.partitionBy("question_id"))).where("given = any_given").drop("given", "any_given")


def _structure_ranks(chunks: DataFrame, questions: DataFrame, block: str, top_k: int, drop_references: bool, stored: DataFrame | None, entities: DataFrame | None) -> DataFrame:
    """(question_id, chunk_ord, score, rank) of structure_search."""
    scope = with_block(chunks, block, entities if stored is not None else None)
    if drop_references:
        scope = scope.where(~F.col("is_bibliography"))
    asked = questions.where(F.coalesce(F.col("question"), F.lit("")) != "")
    ranked = top_ranked(bm25_scores(scope, asked, stored=stored), top_k)
    return _or_else(ranked.select("question_id", "chunk_ord", "score", "rank"), _by_richness(scope, questions, top_k))


def structure_search(chunks: DataFrame, questions: DataFrame, block: str, top_k: int = C.TOP_K, drop_references: bool = True, stored: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """The best chunks of a structure: ranked by the question, or by number of names where it is empty or finds nothing.

    Ranking by text always leaves reference lists out, whatever ``drop_references`` says of the fallback.
    """
    ranks = _structure_ranks(chunks, questions, block, top_k, drop_references, stored, entities)
    return with_passages(ranks, chunks, few_hits(questions, top_k)).withColumn("route", F.lit("structure"))


def _once(rows: DataFrame, marker: list[str], k: int) -> DataFrame:
    """Of rows with one marker the first by ``place`` stays; k rows at most for each question."""
    first = F.row_number().over(Window.partitionBy("question_id", *marker).orderBy("place"))
    once = rows.withColumn("copy", first).where("copy = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("place"))).where(F.col("rank") <= k).drop("copy", "place", *marker)


def hybrid_search(chunks: DataFrame, questions: DataFrame, block: str, top_k: int = C.TOP_K, stored: DataFrame | None = None, terms: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Both routes in turn, so that neither crowds the other out: rank 1 of each, then rank 2, and so on."""
    few = few_hits(questions, 2 * top_k)
    text = top_ranked(bm25_scores(chunks, questions, stored=stored, terms=terms), top_k).select("question_id", "chunk_ord", "score", "rank", F.lit("text").alias("route"))
    structure = _structure_ranks(chunks, questions, block, top_k, True, stored, entities).withColumn("route", F.lit("structure"))
    placed = [r.withColumn("place", (F.col("rank") - 1) * 2 + i) for i, r in enumerate((structure, text))]
    marker = ["source_doc", "page_number", "head_key"]
    known = with_passages(reduce(DataFrame.unionByName, placed), light(chunks).select("chunk_ord", *marker), few)
    return with_passages(_once(known, marker, top_k), chunks, few)


def retrieval_query(questions: DataFrame, history: DataFrame, carry: int = C.CARRIED_QUESTIONS) -> DataFrame:
    """questions with ``contextual``: recent user turns, for a short question also the last answer, then the question.

    history is (question_id, turn, role, text); its last turns count, whatever their role.
    """
    back = Window.partitionBy("question_id").orderBy(F.desc("turn"))
    recent = history.withColumn("age", F.row_number().over(back)).where(F.col("age") <= C.HISTORY_TURNS)
    turn = F.struct("turn", "text")
    gathered = recent.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "user", turn)), asc=False).alias("asked"),
        F.max(F.when(F.col("role") == "assistant", turn))["text"].alias("answer"),
    )
    hint = F.left(F.regexp_replace("answer", r"\[Source \d+\]", ""), F.lit(C.HINT_CHARACTERS))
    short = F.size(T.query_terms(F.col("question"))) <= C.SHORT_QUESTION
    prior = F.transform(F.reverse(F.slice(F.coalesce("asked", F.array().cast("array<struct<turn:bigint,text:string>>")), 1, max(carry, 1))), lambda t: t["text"])
    if not carry:
        return questions.withColumn("contextual", F.col("question"))
    parts = F.concat(prior, F.when(short & F.col("answer").isNotNull(), F.array(hint)).otherwise(F.array().cast("array<string>")), F.array("question"))
    return questions.join(gathered, "question_id", "left").withColumn("contextual", F.array_join(parts, " ")).drop("asked", "answer")


def expand_source_pages(sources: DataFrame, chunks: DataFrame, few: bool | None = None) -> DataFrame:
    """One row for each page of ranked sources: the page's prose chunks with what neighbours share said once.

    Few pages are sent to the chunks; ``few`` says so where the caller knows the number of hits, else they are counted.
    """
    pages = ["source_doc", "page_number"]
    first = F.row_number().over(Window.partitionBy("question_id", *pages).orderBy("rank"))
    anchors = sources.withColumn("copy", first).where("copy = 1").drop("copy")
    wanted = sent_if_few(anchors.select(*pages).distinct()) if few is None else F.broadcast(anchors.select(*pages).distinct()) if few else anchors.select(*pages).distinct()
    parts = chunks.where(~F.col("is_bibliography")).join(wanted, pages, "left_semi").groupBy(*pages).agg(F.sort_array(F.collect_list(F.struct("chunk_ord", T.words(F.col("text")).alias("words")))).alias("parts"))

    def append(have: Column, part: Column) -> Column:
        following = part["words"]
        most = F.least(F.size(have), F.size(following))
        sizes = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        # the last word first, so that few lengths are compared whole
        ends = F.get(have, F.size(have) - 1)
        shared = F.coalesce(F.array_max(F.filter(sizes, lambda k: (F.get(following, k - 1) == ends) & (F.slice(have, -k, k) == F.slice(following, 1, k)))), F.lit(0))
        return F.concat(have, F.slice(following, shared + 1, F.size(following)))

    merged = parts.select(*pages, F.aggregate("parts", F.array().cast("array<string>"), append).alias("words"), F.size("parts").alias("context_chunks"))
    rows = anchors.join(merged, pages, "left").withColumn("anchor_text", F.col("text"))
    text = F.when(F.size("words") > 0, F.array_join("words", " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("context_scope", F.lit("same-page expansion")).withColumn("context_chunks", F.coalesce("context_chunks", F.lit(0))).drop("words")


def conversation_hits(chunks: DataFrame, questions: DataFrame, history: DataFrame, block: str, top_k: int = C.CHAT_TOP_K, stored: DataFrame | None = None, entities: DataFrame | None = None, few: bool | None = None) -> DataFrame:
    """Ranked chunks of the structure for each question in its conversation, before pages are expanded.

    The question's own ranking, and for follow-ups also that of the question in its context, in turn. More than
    ``SCORED_BY_ROWS`` questions are scored in cells, so that no pair of a question and a passage is a row.
    """
    few = few_hits(questions, 2 * top_k) if few is None else few
    scope = with_block(chunks, block, entities if stored is not None else None).where(~F.col("is_bibliography"))
    follow_ups = questions.where(T.is_follow_up(F.col("question"))).join(history.select("question_id").distinct(), "question_id", "left_semi")
    contextual = retrieval_query(follow_ups, history).select("question_id", F.col("contextual").alias("question"))

    def turned(asked: DataFrame, turn: int) -> DataFrame:
        return asked.select(F.struct("question_id", F.lit(turn).alias("turn")).alias("question_id"), "question")

    # both are asked at once, so that statistics of the scope are made once, and a text that many ask is ranked once
    asked = turned(questions, 0).unionByName(turned(contextual, 1)).where("question is not null").withColumn("asked", F.md5(F.col("question").cast("binary")))
    texts = asked.groupBy("asked").agg(F.first("question").alias("question")).withColumnRenamed("asked", "question_id")
    held = with_block(chunks, block)
    by_rows = few_hits(questions, 1, SCORED_BY_ROWS)
    ranked = (top_ranked(bm25_scores(scope, texts, stored=stored), top_k) if by_rows else best_of_many(held, texts, top_k)).withColumnRenamed("question_id", "asked")
    best = ranked.join(asked.select("asked", "question_id"), "asked")
    placed = best.select(F.col("question_id.question_id").alias("question_id"), "chunk_ord", "score", ((F.col("rank") - 1) * 2 + F.col("question_id.turn")).alias("place"))
    marker = ["source_doc", "page_number", "text_key"]
    hits = _once(with_passages(placed, light(scope).select("chunk_ord", *marker), few), marker, top_k)
    ranks = _or_else(hits.select("question_id", "chunk_ord", "score", "rank"), _by_richness(scope, questions, min(top_k, C.CHAT_TOP_K)))
    return with_passages(ranks, held, few).withColumn("route", F.lit("structure"))


def conversation_search(chunks: DataFrame, questions: DataFrame, history: DataFrame, block: str, top_k: int = C.CHAT_TOP_K, stored: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """conversation_hits on expanded pages."""
    few = few_hits(questions, 2 * top_k)
    return expand_source_pages(conversation_hits(chunks, questions, history, block, top_k, stored, entities, few), chunks, few)


def documents_for_structure(chunks: DataFrame, known: DataFrame, block: str, entities: DataFrame | None = None) -> DataFrame:
    """(source_doc, names): the documents of a structure with its names there; names may be empty."""
    if entities is not None:
        held = with_block(chunks, block, entities).select("source_doc", F.explode_outer("names").alias("name"))
        return held.groupBy("source_doc").agg(F.sort_array(F.collect_set("name")).alias("names"))
    scope = with_block(chunks, block).select("source_doc", "compounds")
    names = scope.select("source_doc", F.explode("compounds").alias("name")).join(known.where(F.col("block") == block).select("name"), "name", "left_semi")
    by_doc = names.groupBy("source_doc").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return scope.select("source_doc").distinct().join(by_doc, "source_doc", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def checked_retrieval(chunks: DataFrame, question: str, block: str, top_k: int, stored: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """structure_search of one question, after checks of the arguments; ``on_structure`` tells of each row that it holds the key."""
    if not question or not question.strip():
        raise ValueError("the question is empty")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 20:
        raise ValueError("top_k must be a whole number from 1 to 20")
    asked = chunks.sparkSession.createDataFrame([(0, question)], "question_id long, question string")
    return structure_search(chunks, asked, block, top_k, stored=stored, entities=entities).withColumn("on_structure", F.array_contains("blocks", block))


def compare_routes(chunks: DataFrame, questions: DataFrame, block: str, top_k: int = C.TOP_K, stored: DataFrame | None = None, terms: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Text hits and structure hits side by side, told apart by route."""
    text = bm25_search(chunks, questions, top_k, stored=stored, terms=terms)
    return text.unionByName(structure_search(chunks, questions, block, top_k, stored=stored, entities=entities).select(*text.columns))
