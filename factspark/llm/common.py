"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one Arrow batch of whole texts may hold in a Python worker; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold; the same bound for all operators, in whatever order their plans run."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: executors need a shared folder for intermediate tables")
        folder = tempfile.mkdtemp(prefix="factspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what saved() wrote for these frames; nothing that is still to run may read them."""
    for df in frames:
        if path := _paths.pop(df, None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(docs: DataFrame) -> DataFrame:
    """All columns of docs in a struct `row`, with the address of the row: (file, place).

    The address is the row's place in its Parquet file, so that it is the same
    whenever and however often the plan runs. Frames that are more than columns
    and filters over files are written first.
    """
    plan = docs._jdf.queryExecution().analyzed().treeString()
    if not {*re.findall(r"^[\s:+-]*(\w+)", plan, re.M)} <= {"Relation", "Project", "Filter", "SubqueryAlias"}:
        docs = saved(docs, "rows")
    at = docs.metadataColumn("_metadata")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("place"))


def whole_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, null text as empty; other columns can't clash from here on.

    The id is text: pandas would make a column of longs with a null in it one of
    floats, which hold no id above 2**53. Cast it back behind Python.
    """
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text, for folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def tidy() -> None:
    """Give memory that a finished partition has freed back to the system: workers are reused, and their peaks would add up."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
