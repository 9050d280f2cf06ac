"""Folders for tables that a query writes and reads back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import retrieval

_indexes: dict[tuple, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in a temporary one only where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a shared folder for intermediate tables")
        made = tempfile.mkdtemp(prefix="factspark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        root = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def index_of(docs: DataFrame, keep: tuple[str, ...] = ()) -> str:
    """The stored BM25 index of a table's files, built once a session and anew when a file has changed."""
    spark = docs.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in sorted(docs.inputFiles())]
    states = [(p.toString(), s.getLen(), s.getModificationTime()) for p in paths for s in [p.getFileSystem(conf).getFileStatus(p)]]
    key = (spark.sparkContext.applicationId, keep, *states)
    if key not in _indexes:
        _indexes[key] = folder(spark, "bm25")
        retrieval.write_index(docs, _indexes[key], keep=keep)
    return _indexes[key]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back, for plans that use it several times."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
