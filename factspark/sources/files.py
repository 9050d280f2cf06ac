"""Sources and sinks in files: every write is a committed Spark job, so that a lost executor leaves no half of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the fact tables.
FACTS = "fact_id string, ticker string, company_name string, fiscal_year int, statement_scope string, line_code string, line_item string, metric string, value decimal(38,6), unit string, source_scale string"
GOLD = "question_id string, question string, expected string, kind string"


def report_name(path: Column) -> list[Column]:
    """ticker, report_year and statement_scope of a path .../TICKER/YEAR/DIRECTORY/x_extracted.txt."""
    parts = F.regexp_extract_all(path, F.lit(r"([^/]+)/(\d{4})/([^/]+)/[^/]*_extracted\.txt$"), F.lit(0))
    bits = F.split(F.element_at(parts, -1), "/")
    scope = F.when(bits[2].endswith("_consolidated"), "HOP_NHAT").when(bits[2].endswith("_separate"), "RIENG").when(bits[2].endswith("_aggregated"), "TONG_HOP")
    return [bits[0].alias("ticker"), bits[1].cast("int").alias("report_year"), scope.alias("statement_scope")]


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(report_id, ticker, report_year, statement_scope, raw_text, content_sha256) of a tree of extracted texts; names come from paths only."""
    path = F.col("_metadata.file_path")
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select("value", path.alias("path")).filter(F.col("path").endswith("_extracted.txt"))
    return texts.select(F.sha2("path", 256).alias("report_id"), *report_name(F.col("path")), F.col("value").alias("raw_text"), F.sha2("value", 256).alias("content_sha256"))


def write_corpus(reports: DataFrame, root: str) -> None:
    """Texts of (ticker, report_year, directory, raw_text), one file each, as read_corpus() reads them; a small fixture's writer."""
    jvm, conf = reports.sparkSession._jvm, reports.sparkSession._jsc.hadoopConfiguration()
    for r in reports.toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{r['ticker']}/{r['report_year']}/{r['directory']}/report_extracted.txt")
        out = at.getFileSystem(conf).create(at, False)
        out.write(bytearray(r["raw_text"].encode()))
        out.close()


def unique(df: DataFrame, key: str) -> DataFrame:
    """The frame; running it raises where a key occurs twice."""
    twice = df.groupBy(key).count().filter("count > 1").select(F.assert_true(F.lit(False), F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))).alias("x"))
    return df.join(F.broadcast(twice.groupBy().agg(F.count("x").alias("_n"))), F.lit(True)).drop("_n")  # one row, or an error


def write_facts(facts: DataFrame, path: str) -> None:
    facts.write.option("header", True).csv(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Typed facts; only line_code and metric may be empty, which is null; other texts, "NA" too, stay as they are."""
    raw = spark.read.option("header", True).option("nullValue", "").option("emptyValue", "").option("enforceSchema", False).schema(FACTS).csv(path)
    kept = [F.when(F.col(c) == "", None).otherwise(F.col(c)).alias(c) if c in ("line_code", "metric") else F.col(c) for c in raw.columns]
    return raw.select(*kept)


def write_catalog(facts: DataFrame, statement: str, companies: DataFrame, provenance: DataFrame, path: str) -> None:
    """Facts by statement and year, companies, provenance, and a manifest of counts and content hashes; refuses to overwrite."""
    facts.repartition(statement, "fiscal_year").write.partitionBy(statement, "fiscal_year").parquet(f"{path}/facts")
    companies.write.parquet(f"{path}/companies")
    provenance.write.json(f"{path}/provenance")
    spark = facts.sparkSession
    spark.read.parquet(f"{path}/facts").agg(F.count("*").alias("facts"), F.sum(F.xxhash64("fact_id", "value").cast("decimal(38,0)")).cast("string").alias("digest")).write.json(f"{path}/manifest")


def write_shards(df: DataFrame, path: str, rows: int = 50_000) -> None:
    """JSON lines, a new file after so many rows."""
    df.write.option("maxRecordsPerFile", rows).json(path)


def write_statements(lines: DataFrame, key: str, path: str) -> None:
    """Gzipped JSON by report: lines nested in one document a report."""
    doc = lines.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in lines.columns if c != key]))).alias("lines"))  # the lines of one report
    doc.write.option("compression", "gzip").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions of the strict schema; a line of another shape is an error."""
    return spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def history(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """An append-only log, once a key."""
    return spark.read.schema(schema).parquet(path).dropDuplicates(list(keys))


def exposition(rows: DataFrame, name: str, labels: Sequence[str], value: str) -> DataFrame:
    """Lines of the Prometheus text format for labelled values."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"')) for c in labels])
    return rows.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
