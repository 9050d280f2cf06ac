"""Connected components of links in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, saved


def _counted(edges: DataFrame) -> tuple[DataFrame, dict]:
    """Edges, written, with their number and a sum of their hashes, which are observed while they are written."""
    seen = Observation()
    out = saved(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
    return out, seen.get


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b), root the smallest node of its component.

    Alternates large-star and small-star until the edges are stars. Minima are
    pre-aggregated, hubs are split by the skew join.
    """
    edges, state = _counted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while state["n"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        old, before = edges, state
        edges, state = _counted(small)
        discard(old)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
