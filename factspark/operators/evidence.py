"""Evidence: matching spans, binding placeholders, gates, memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from .relational import top_n
from .retrieval import dot

#: Rows that a described result shows.
SHOWN = 500
#: pandas type names of a payload, and Spark's.
TYPES = {"int64": "long", "float64": "double", "object": "string", "bool": "boolean"}


def longest_matches(spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, name, start, stop) that stay when longer ones win, then earlier ones, and none overlaps one that stays."""
    order = F.struct((F.col("start") - F.col("stop")).alias("size"), "start", "stop", "name")
    listed = spans.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("l"))  # the matches within one question
    zero = F.slice("l", 1, 0)

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    out = listed.select(key, F.explode(F.aggregate("l", zero, step)).alias("s"))
    return out.select(key, "s.name", "s.start", "s.stop")


def bind(placeholders: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, status, value): every placeholder must be asked for once and found once; else UNBOUND or NOT_UNIQUE."""
    asked = placeholders.groupBy(key).agg(F.count("*").alias("asked"))
    values = found.groupBy(key).agg(F.count("*").alias("found"), F.first("value").alias("value"))
    both = asked.join(values, key, "left")
    status = F.when(F.col("found").isNull(), "UNBOUND").when((F.col("asked") > 1) | (F.col("found") > 1), "NOT_UNIQUE").otherwise("OK")
    return both.select(key, status.alias("status"), F.when(status == "OK", F.col("value")).alias("value"))


def gold_against_run(gold: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Gold (key, groups) with its run (key, cells): covered where the run cites a cell of every group; false without a run."""
    both = gold.join(runs, key, "left")
    met = F.forall("groups", lambda g: F.arrays_overlap(g, F.col("cells")))
    return both.withColumn("covered", F.coalesce(met, F.lit(False)))


def unlinked_declarations(texts: DataFrame, linked: DataFrame, key: str, text: str) -> DataFrame:
    """Paragraphs that no link names and that declare a unit, with its scale."""
    scale = scalar.unit_scale(F.col(text))
    return texts.join(linked, key, "left_anti").withColumn("scale", scale).filter("scale is not null")


def query_text(*parts: Column) -> Column:
    """The distinct parts of arrays in the order they first occur, nulls left out."""
    return F.array_join(F.array_distinct(F.array_compact(F.concat(*parts))), " ")


def first_failure(stages: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first stage whose condition doesn't hold; null if all do."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in stages], F.lit(None).cast("string"))


def planning_gate(companies: Column, periods: Column, metrics: Column) -> Column:
    """What a question lacks first, by how many of each were recognised: none is missing, several companies or metrics are ambiguous."""
    return (
        F.when(companies == 0, "COMPANY_MISSING").when(companies > 1, "COMPANY_AMBIGUOUS").when(periods == 0, "PERIOD_MISSING")
        .when(metrics == 0, "METRIC_MISSING").when(metrics > 1, "METRIC_AMBIGUOUS").otherwise("READY")
    )


def described(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, row_count, truncated) of results of which SHOWN rows are shown."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"), (F.count("*") > SHOWN).alias("truncated"))


def masked(wanted: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted rows with a placeholder named by their keys in place of the value; rows without evidence are an error when run."""
    met = wanted.join(evidence.withColumn("_there", F.lit(True)), list(keys), "left")
    name = F.concat(F.lit("val_"), F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256), 1, 12))
    return met.withColumn("placeholder", F.when(F.col("_there"), name).otherwise(F.raise_error(F.lit("evidence unavailable")).cast("string"))).drop("value", "_there")


def remembered(entries: DataFrame, queries: DataFrame, threshold: float, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, rank, score): entries of the query's context at or above the threshold, the best of each signature, k at most.

    queries (query_id, context, q) are a stated, bounded set.
    """
    scored = entries.join(F.broadcast(queries), "context").withColumn("score", F.round(dot(F.col(vector_col), F.col("q")), 9)).filter(F.col("score") >= threshold)
    single = top_n(scored, ["query_id", "signature"], 1, F.desc("score"), F.col(id_col)).drop("rank")
    return top_n(single, ["query_id"], k, F.desc("score"), F.col(id_col)).select("query_id", id_col, "rank", "score")


def from_payload(spark: SparkSession, payload: dict) -> DataFrame:
    """A frame of a columnar payload {columns, dtypes, data}; an unknown type or ragged columns are errors."""
    if len({len(c) for c in payload["data"]}) > 1 or len(payload["columns"]) != len(payload["data"]):
        raise ValueError("ragged payload")
    schema = ", ".join(f"`{c}` {TYPES[d]}" for c, d in zip(payload["columns"], payload["dtypes"]))
    return spark.createDataFrame(list(zip(*payload["data"])), schema)
