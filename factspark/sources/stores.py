"""Stored tables with point lookups, resumable batches, published versions and run reports.

Only small files (markers, manifests, a pointer) pass the driver, through
Hadoop's file systems; rows are written and read by Spark jobs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """What is there isn't what the caller took for granted."""


class Files:
    """Small files of a folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; false if there is one of this name."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def move(self, source: str, target: str) -> None:
        """Rename; a target that is there is a conflict."""
        self.fs.mkdirs(self._path(target).getParent())
        if self.exists(target) or not self.fs.rename(self._path(source), self._path(target)):
            raise Conflict(f"{target} is there already or can't be made")

    def replace(self, name: str, text: str) -> None:
        """Put a file in place of another in one step, where the file system can rename over a file."""
        fresh = f"{name}.{uuid.uuid4().hex}"
        self.create(fresh, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.fs.getConf())
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(self._path(fresh), self._path(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def fingerprint(df: DataFrame) -> dict:
    """Rows, columns, and the sum of the rows' hashes: the same in whatever order and files they are."""
    columns = sorted(df.columns)
    seen = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")).alias("h")).first()
    return {"rows": seen["n"], "columns": columns, "hash": str(seen["h"] or 0)}


# Point lookups


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_lookup(df: DataFrame, key: str, path: str, buckets: int = 64) -> None:
    """A table for point lookups by key: a folder a bucket of the key, sorted within, with Bloom filters in its row groups.

    A key of very many rows is one bucket's; its rows are spread over files by
    their hash. Null keys are kept and never found.
    """
    spark = df.sparkSession
    Files(spark, path).create("_lookup.json", json.dumps({"key": key, "buckets": buckets})) or _conflict(f"{path} is there already")
    bucketed = df.withColumn("_bucket", bucket_of(F.col(key), buckets))
    spread = bucketed.repartition(F.col("_bucket"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(4))).sortWithinPartitions("_bucket", key)
    spread.write.mode("append").partitionBy("_bucket").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def _conflict(why: str):
    raise Conflict(why)


def read_lookup(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(path), json.loads(Files(spark, path).read("_lookup.json"))


def look_up(spark: SparkSession, path: str, keys: Sequence) -> DataFrame:
    """The rows of some keys; only their buckets' files are opened, and row groups by minimum, maximum and Bloom filter. Unknown and null keys find nothing."""
    table, kind = read_lookup(spark, path)
    keys = [k for k in dict.fromkeys(keys) if k is not None]
    if not keys:
        return table.drop("_bucket").limit(0)
    asked = spark.createDataFrame([(str(k),) for k in keys], "k string").select(bucket_of(F.col("k"), kind["buckets"]).alias("b"))
    wanted = [r["b"] for r in asked.distinct().collect()]  # at most as many as keys
    return table.filter(F.col("_bucket").isin(wanted) & F.col(kind["key"]).isin(keys)).drop("_bucket")


def look_up_all(keys: DataFrame, path: str, column: str, how: str = "inner") -> DataFrame:
    """The rows of a table of keys, joined to them by bucket and key; buckets without a key are pruned while it runs where the keys are few."""
    table, kind = read_lookup(keys.sparkSession, path)
    asked = keys.withColumn("_bucket", bucket_of(F.col(column), kind["buckets"]))
    found = table.withColumnRenamed(kind["key"], column) if kind["key"] != column else table
    return asked.join(found, ["_bucket", column], how).drop("_bucket")


# Resumable batches


def write_batches(df: DataFrame, key: str, path: str, batches: int, identity: str, stop_before: int | None = None) -> dict:
    """Write df in batches by a hash of the key, each once; {"written": [...], "skipped": [...]}.

    A batch is staged, moved into place, and committed by a marker with its rows
    and hash. Started again, what is committed is skipped, what was staged or
    moved without a marker is written anew. A path that was begun with another
    identity, number of batches or schema is a conflict. stop_before ends the
    run early, as a failure would: with the batch staged, not committed.
    """
    files = Files(df.sparkSession, path)
    about = json.dumps({"identity": identity, "batches": batches, "schema": df.schema.simpleString()}, sort_keys=True)
    if not files.create("_plan.json", about) and files.read("_plan.json") != about:
        raise Conflict(f"{path} was begun with another plan")
    out: dict = {"written": [], "skipped": []}
    for n in range(batches):
        if files.exists(f"_commits/{n}.json"):
            out["skipped"].append(n)
            continue
        files.delete(f"_staging/{n}")
        files.delete(f"batch={n}")
        part = df.filter(bucket_of(F.col(key), batches) == n)
        part.write.parquet(f"{path}/_staging/{n}")
        if n == stop_before:
            raise RuntimeError(f"stopped before batch {n} was committed")
        files.move(f"_staging/{n}", f"batch={n}")
        files.create(f"_commits/{n}.json", json.dumps(fingerprint(df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch={n}"))))
        out["written"].append(n)
    return out


def read_batches(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The committed batches, with their number; verify compares each with the rows and hash of its marker."""
    files = Files(spark, path)
    done = sorted(int(n.partition(".")[0]) for n in files.names("_commits") if n.endswith(".json"))
    if not done:
        raise Conflict(f"{path} has no committed batch")
    table = spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in done])
    if verify:
        columns = sorted(c for c in table.columns if c != "batch")
        seen = table.groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")).alias("h"))
        found = {r["batch"]: (r["n"], str(r["h"])) for r in seen.collect()}  # one row a batch
        for n in done:
            mark = json.loads(files.read(f"_commits/{n}.json"))
            if found.get(n, (0, "0")) != (mark["rows"], mark["hash"]):
                raise Conflict(f"batch {n} isn't what was committed")
    return table


# Published versions


def publish(tables: dict[str, DataFrame], root: str, expected: str | None = None) -> str:
    """Stage tables, put them in place as a version with a manifest, and point to it; the version's name.

    A version is named by what is in it, so that the same content is published
    once. Readers see the old version or the new one. If the pointer isn't at
    `expected` (None: at no version), nothing is published.
    """
    spark = next(iter(tables.values())).sparkSession
    files = Files(spark, root)
    if current(spark, root) != expected:
        raise Conflict(f"{current(spark, root)} is published, not {expected}")
    stage = f"_staging/{uuid.uuid4().hex}"
    manifest = {}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{stage}/{name}")
        manifest[name] = fingerprint(spark.read.schema(df.schema).parquet(f"{root}/{stage}/{name}"))
    text = json.dumps(manifest, sort_keys=True)
    files.create(f"{stage}/manifest.json", text)
    version = spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0][:20]
    if files.exists(f"versions/{version}"):
        files.delete(stage)
    else:
        files.move(stage, f"versions/{version}")
    if not files.create("_lock", version):
        raise Conflict("another version is being published")
    try:
        if current(spark, root) != expected:
            raise Conflict(f"{current(spark, root)} was published meanwhile")
        files.replace("CURRENT", version)
    finally:
        files.delete("_lock")
    return version


def current(spark: SparkSession, root: str) -> str | None:
    files = Files(spark, root)
    return files.read("CURRENT") if files.exists("CURRENT") else None


def read_published(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A table of a version, the current one by default, after its rows and hash are compared with the manifest."""
    version = version or current(spark, root) or _conflict("nothing is published")
    manifest = json.loads(Files(spark, root).read(f"versions/{version}/manifest.json"))
    table = spark.read.parquet(f"{root}/versions/{version}/{name}")
    if fingerprint(table) != manifest[name]:
        raise Conflict(f"{name} of {version} isn't what was published")
    return table


# Run reports


def run_questions(questions: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame], path: str, identity: dict) -> int:
    """Answer the questions that the report at path has no answer for yet, and append these; how many there were.

    A report belongs to one identity (release, settings); another one is a
    conflict, as is a second run at the same time. Each question is answered
    once, whatever was done before a failure.
    """
    spark = questions.sparkSession
    files, about = Files(spark, path), json.dumps(identity, sort_keys=True)
    if not files.create("_lock", about):
        raise Conflict(f"{path} has a run at work")
    try:
        if not files.create("_identity.json", about) and files.read("_identity.json") != about:
            raise Conflict(f"{path} is the report of another run")
        left = questions.dropDuplicates([key])
        if any(n.startswith("attempt=") for n in files.names()):
            left = left.join(read_report(spark, path).select(key), key, "left_anti")
        attempt = f"attempt={len([n for n in files.names() if n.startswith('attempt=')])}"
        answer(left).write.parquet(f"{path}/_staging/{attempt}")
        files.move(f"_staging/{attempt}", attempt)
        return spark.read.parquet(f"{path}/{attempt}").count()
    finally:
        files.delete("_lock")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """All answers, with the number of the attempt that gave them."""
    return spark.read.option("basePath", path).parquet(f"{path}/attempt=*")
