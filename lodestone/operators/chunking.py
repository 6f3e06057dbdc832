"""Pages to overlapping word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from lodestone import constants as C
from lodestone.functions import text as T
from lodestone.functions import tokens as A

#: What every marker of ``text.is_bibliography`` holds, and every citation; patterns without look-around, which run over bytes.
_MARKED, _CITED = r"(?i)doi|\[crossref\]|\[pubmed\]", r"[0-9]\.\s"

#: ``part`` of the ordinals of passages: those of pages come first, then what is attached to the index.
PAGE_PART, TABLE_PART, STRUCTURE_PART = 0, 1, 2


def ordinal(part: int, page: Column, idx: Column, record: Column | None = None) -> Column:
    """A passage's key, which sorts in corpus order.

    It holds the page's own key whole, of any type, so no two passages share one, however many a page has; attached
    passages have no page and are told apart by the id of their record.
    """
    own = F.lit(None).cast("string") if record is None else record
    return F.struct(F.lit(part).alias("part"), page.alias("page"), idx.cast("long").alias("idx"), own.alias("record"))


def chunk_pages(pages: DataFrame, chunk_words: int = C.CHUNK_WORDS, overlap_words: int = C.OVERLAP_WORDS, repair: bool = True, counted: bool = False) -> DataFrame:
    """(chunk_ord, source_doc, page_number, chunk_idx, text, is_bibliography) of pages (page_ord, source_doc, page_number, text), with n_tokens if ``counted``.

    Windows start every chunk_words - overlap_words words and end with the page; pages without words give none.
    ``page_ord`` is any key that sorts in reading order and is a page's own; with it chunk_ord needs no sort over the corpus.
    """
    step = max(chunk_words - overlap_words, 1)
    body = T.repair_page_text(F.col("text")) if repair else F.col("text")
    own = ["page_ord", "source_doc", "page_number"]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, number, window = A.windows(batch.column("text"), chunk_words, step)
        cuts = pa.array(window, pa.binary()).cast(pa.string())
        # no reference list is without one of these
        listed = pc.or_(pc.match_substring_regex(cuts, _MARKED), pc.greater_equal(pc.count_substring_regex(cuts, _CITED), 3))
        sizes = [pa.array(A.token_counts(cuts).astype(np.int32))] if counted else []
        return pa.RecordBatch.from_arrays([*batch.select(own).take(pa.array(text)).columns, pa.array(number.astype(np.int32)), cuts, listed, *sizes], [*own, "chunk_idx", "text", "listed", "n_tokens"][: 6 + counted])

    fields = [StructField("chunk_idx", IntegerType(), False), StructField("text", StringType(), False), StructField("listed", BooleanType(), False), StructField("n_tokens", IntegerType(), False)]
    rows = pages.select(*own, body.alias("text")).mapInArrow(A.by_slices(cut), StructType([*[pages.schema[c] for c in own], *fields[: 3 + counted]]))
    is_list = F.when(F.col("listed"), T.is_bibliography(F.col("text"))).otherwise(False)
    return rows.select(ordinal(PAGE_PART, F.col("page_ord"), F.col("chunk_idx")).alias("chunk_ord"), "source_doc", F.col("page_number").cast("long").alias("page_number"), "chunk_idx", "text", is_list.alias("is_bibliography"), *(["n_tokens"] if counted else []))


def token_counts(chunks: DataFrame) -> DataFrame:
    """(chunk_ord, n_tokens, n_distinct) for ranking statistics."""
    tokens = T.tokenize(F.col("text"))
    return chunks.select("chunk_ord", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"))
