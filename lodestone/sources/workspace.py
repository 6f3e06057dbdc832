"""The folder that driver and executors share, for tables that a session builds once."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from lodestone.operators.index import Index
from lodestone.sources.tables import read_index, write_index

_built: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset a local session gets a new local folder; a cluster, whose executors couldn't see one, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
    return base.rstrip("/")


def state_of(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of the files under some paths, as the file systems that own them list them."""
    seen = hashlib.sha256()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        found = []
        while listed.hasNext():
            file = listed.next()
            found.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
        seen.update("\n".join(sorted(found)).encode())
    return seen.hexdigest()


def built_once(spark: SparkSession, key: str, build: Callable[[str], Index]) -> Index:
    """The index that ``build(folder)`` gives, written on the first call of a session and read on later ones.

    ``key`` names all that the index is made of: inputs with their state, lexicon, rules.
    """
    known = (spark.sparkContext.applicationId, key)
    if known not in _built:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        write_index(build(path), path)
        _built[known] = path
    return read_index(spark, _built[known])
