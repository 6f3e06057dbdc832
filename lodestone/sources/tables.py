"""Tables in and out: pages, lexicons, and the index as a directory of Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.index import Index, structure_postings
from lodestone.operators.rank import posting_lists, term_counts

LEXICON = "name string, smiles string"
#: Rows of a page of postings. Pages are what a scan for some terms leaves out, so small ones spare most of a file.
POSTING_PAGE_ROWS = 1_000


def document_pages(documents: DataFrame) -> DataFrame:
    """Pages of text from a table of documents: each is one page of its source, in order of doc_id."""
    return documents.select(F.col("doc_id").alias("page_ord"), F.col("source").alias("source_doc"), F.col("doc_id").alias("page_number"), "text")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(name, smiles) from a JSON object of names; a value may be null. A missing file is an empty lexicon."""
    try:
        lines = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEXICON)
    return lines.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "smiles"))


def write_name_cache(cache: DataFrame, path: str) -> None:
    """Names looked up so far, nulls for those that are no compound, in order of names."""
    cache.select("name", "smiles").orderBy("name").write.mode("overwrite").parquet(path)


def merged_cache(cache: DataFrame, looked_up: DataFrame) -> DataFrame:
    """The cache with new answers; an answer that it holds already stays."""
    return cache.select("name", "smiles").unionByName(looked_up.select("name", "smiles").join(cache.select("name"), "name", "left_anti"))


def write_index(index: Index, path: str, mode: str = "overwrite") -> None:
    """Entities are in order of structures, so that their scans prune row groups. Chunks stay where they are made, and postings are segments: each task writes those of its own chunks, by term within some megabytes of text."""
    index.chunks.write.mode(mode).parquet(f"{path}/chunks")
    index.compounds.write.mode(mode).parquet(f"{path}/compounds")
    # the others follow from the chunks as they stand now, so that names aren't searched again
    spark = index.chunks.sparkSession
    chunks, known = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/compounds")
    structure_postings(chunks, known).repartitionByRange("block", "chunk_ord").sortWithinPartitions("block", "chunk_ord").write.mode(mode).parquet(f"{path}/entities")
    if index.postings is not None:
        posting_lists(chunks).write.mode(mode).option("parquet.page.row.count.limit", POSTING_PAGE_ROWS).parquet(f"{path}/postings")
        term_counts(chunks, spark.read.parquet(f"{path}/postings")).sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/terms")
    for name in ("structures", "tables", "frequencies"):
        if (table := getattr(index, name)) is not None:
            table.write.mode(mode).parquet(f"{path}/{name}")


def read_index(spark: SparkSession, *paths: str) -> Index:
    """The index at the first of the paths that holds one, so that a private copy can go before a public one."""
    for path in paths:
        try:
            chunks = spark.read.parquet(f"{path}/chunks")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        optional = {}
        for name in ("structures", "tables", "postings", "terms", "frequencies"):
            try:
                optional[name] = spark.read.parquet(f"{path}/{name}")
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        return Index(chunks, spark.read.parquet(f"{path}/compounds"), spark.read.parquet(f"{path}/entities"), **optional)
    raise FileNotFoundError(f"no index in {', '.join(paths)}")


def evidence_json(sources: DataFrame, query: str, smiles: str | None, block: str) -> DataFrame:
    """One row (question_id, json) for each question: the query, its structure and its ranked sources."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.struct("source_doc", "page_number", "text", "compounds", "blocks", "score", "route").alias("source")))), lambda x: x["source"])
    return sources.groupBy("question_id").agg(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(smiles).alias("smiles"), F.lit(block).alias("block"), rows.alias("sources"))).alias("json"))


def write_facts_csv(facts: DataFrame, path: str) -> None:
    """The six columns of a fact table, with a header."""
    facts.orderBy("solvent", "row_ord", "temperature_C").select("organic_fraction", "temperature_C", "solubility_x100", "uncertainty_x100", "source_doc", "page").write.mode("overwrite").csv(path, header=True)


def keep_crops(crops: DataFrame, path: str) -> DataFrame:
    """crops (id, content, ...) with ``image_path``, after their images were added to the table of crops at ``path``; what has no content has no path."""
    crops.where("content is not null").select("id", "content").write.mode("append").parquet(path)
    return crops.withColumn("image_path", F.when(F.col("content").isNotNull(), F.concat(F.lit(f"{path}#"), F.col("id"))))


def write_report_json(report: DataFrame, path: str) -> None:
    """An inventory or a recognition report as JSON lines."""
    report.write.mode("overwrite").json(path)


