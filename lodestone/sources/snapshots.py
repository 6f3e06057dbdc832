"""A table that several writers add to, as numbered snapshots: a reader sees the last whole one, whatever happens to a writer.

A writer merges what it read with what it has, writes that to a folder of its own, and renames the folder to the next
number. The rename fails where another writer took the number before; then the writer reads again, merges again and tries
the number after that. So no answer is lost, and a crash leaves a folder that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.tables import LEXICON, merged_cache

#: Writers that publish at the same time are waited for so often.
TRIES = 50


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots at ``path``, in order."""
    folder = _path(spark, path, "versions")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()) for s in files.listStatus(folder)) if files.exists(folder) else []


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The last snapshot, or that of a number; no rows where there is none."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/versions/{known[-1] if version is None else version:010d}")


def _published(spark: SparkSession, folder: str, path: str, number: int) -> bool:
    """Whether the folder became snapshot ``number``: false where there is one already."""
    source, target = _path(spark, folder), _path(spark, path, "versions", f"{number:010d}")
    source.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target.getParent())
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getParent().toUri() if target.toUri().getScheme() else spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def append(spark: SparkSession, path: str, schema: str, merged: Callable[[DataFrame], DataFrame]) -> int:
    """Publish what ``merged`` makes of the last snapshot, and return its number. ``merged`` runs again where another writer was first."""
    for _ in range(TRIES):
        last = max(versions(spark, path), default=0)
        folder = f"{path}/pending/{uuid.uuid4().hex}"
        merged(read(spark, path, schema, last or None)).write.parquet(folder)
        if _published(spark, folder, path, last + 1):
            return last + 1
        _delete(spark, folder)
    raise RuntimeError(f"{TRIES} other writers were first at {path}")


def _delete(spark: SparkSession, folder: str) -> None:
    target = _path(spark, folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` snapshots, for when nobody reads the others any more."""
    for number in versions(spark, path)[: -max(keep, 1)]:
        _delete(spark, f"{path}/versions/{number:010d}")


def read_name_cache(spark: SparkSession, path: str) -> DataFrame:
    """(name, smiles) of names looked up so far; a null says that a name is no compound."""
    return read(spark, path, LEXICON)


def add_to_name_cache(looked_up: DataFrame, path: str) -> int:
    """Add answers (name, smiles); an answer that the cache holds already stays, whoever wrote it."""
    return append(looked_up.sparkSession, path, LEXICON, lambda cache: merged_cache(cache, looked_up).sortWithinPartitions("name"))
