"""Pages that arrive over time: chunks and candidate names as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.names import NameRules
from lodestone.operators.chunking import chunk_pages
from lodestone.operators.names import lexical_names

PAGES = "page_ord long, source_doc string, page_number long, text string"


def stream_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the Parquet pages that arrive in a folder; a page is whole in itself, so no state is kept."""
    return chunk_pages(spark.readStream.schema(PAGES).parquet(folder))


def start_ingest(spark: SparkSession, folder: str, out: str, rules: NameRules = NameRules(), once: bool = True) -> StreamingQuery:
    """Append chunks and their lexical names to tables under ``out``; a batch that is run again writes the same files anew."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        lexical_names(batch, rules).write.mode("overwrite").parquet(f"{out}/names/batch={number}")

    writer = stream_chunks(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/progress")
    return (writer.trigger(availableNow=True) if once else writer).start()
