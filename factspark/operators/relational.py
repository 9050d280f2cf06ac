"""Selection, joins, aggregates and windows over long-format facts; all lazy DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def select_rows(df: DataFrame, **allowed: Sequence) -> DataFrame:
    """Rows whose every named column is among its allowed values; None leaves a column free. An empty list matches nothing."""
    tests = [F.col(c).isin(list(v)) if len(v) else F.lit(False) for c, v in allowed.items() if v is not None]
    return df.filter(reduce(Column.__and__, tests, F.lit(True)))


def add_derived(df: DataFrame, name: str, formula: Column, inputs: Sequence[str], formula_id: str) -> DataFrame:
    """A derived column and the digest of its formula and sorted inputs; an existing name is an error."""
    if name in df.columns:
        raise ValueError(f"duplicate column {name}")
    lineage = F.sha2(F.lit("|".join([formula_id, *sorted(inputs)])), 256)
    return df.withColumn(name, formula).withColumn(f"{name}_lineage", lineage)


def exactly_one(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs once."""
    single = df.groupBy(*keys).count().filter("count = 1").select(*keys)
    return df.join(single, list(keys), "left_semi")


def complete_entities(df: DataFrame, entity: str, part: str, wanted: Sequence) -> DataFrame:
    """Relational division: entities that have every wanted part."""
    found = df.filter(F.col(part).isin(list(wanted))).groupBy(entity).agg(F.countDistinct(part).alias("n"))
    return found.filter(F.col("n") == len(set(wanted))).select(entity)


def offset_join(facts: DataFrame, key: str, year: str, value: str, offset: int = 1) -> DataFrame:
    """Each fact with that of the same key `offset` years before; a gap gives null, never an older year."""
    prior = facts.select(F.col(key), (F.col(year) + offset).alias(year), F.col(value).alias("prior"))
    return facts.select(key, year, value).join(prior, [key, year], "left")


def growth(current: Column, prior: Column) -> Column:
    """Percent; null without a prior or with a prior of zero."""
    return F.try_divide(current - prior, prior) * 100


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each left row the last right value of its key at or before it: one union and one window, no pairs."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(
        right.select(key, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    order = W.partitionBy(key).orderBy(at, "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(order)).filter("_side = 1").drop("_v", "_side")


def range_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points inside half-open spans of the same key."""
    return points.join(spans, (points[key] == spans[key]) & (points[at] >= spans[start]) & (points[at] < spans[end])).drop(spans[key])


def rank_rows(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """1-based contiguous ranks within keys."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def top_n(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    return rank_rows(df, keys, *order).filter(F.col("rank") <= n)


def carry_forward(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Null values take the last one before them in the key."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(f"{value}_carried", F.coalesce(value, F.last(value, ignorenulls=True).over(w)))


def consensus(df: DataFrame, key: str, value: str, share: float = 0.95, least: int = 20) -> DataFrame:
    """The value all rows of a key agree on, or that at least `share` of at least `least` rows have; else MIXED."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    per = counts.groupBy(key).agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.max_by(value, F.struct("n", value)).alias("mode"), F.count("*").alias("kinds"))
    agreed = (F.col("kinds") == 1) | ((F.col("total") >= least) & (F.col("top") >= share * F.col("total")))
    return per.select(key, F.when(agreed, F.col("mode")).otherwise(F.lit("MIXED")).alias("consensus"), "total")


def resolve_duplicates(df: DataFrame, keys: Sequence[str], value: str, *preference: Column) -> DataFrame:
    """One row a key where all its values agree, by preference; disagreeing keys are dropped."""
    agreed = df.groupBy(*keys).agg(F.countDistinct(value).alias("_kinds")).filter("_kinds = 1").drop("_kinds")
    return top_n(df.join(agreed, list(keys), "left_semi"), keys, 1, *preference).drop("rank")


def majority_positive(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values with their sign turned in keys where most of the non-zero ones are negative."""
    habit = df.filter(F.col(value) != 0).groupBy(key).agg((F.count_if(F.col(value) < 0) * 2 > F.count("*")).alias("_turn"))
    turned = F.when(F.col("_turn"), -F.col(value)).otherwise(F.col(value))
    return df.join(habit, key, "left").withColumn(value, turned).drop("_turn")


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95% score interval, null for no trials."""
    p = F.try_divide(successes.cast("double"), n)
    centre = p + z * z / (2 * n)
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    scale = 1 + z * z / n
    return F.try_divide(centre - half, scale), F.try_divide(centre + half, scale)


def nearest_rank(value: str, p: float) -> Column:
    """The ceil(p * n)-th smallest value."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def slope(y: str, x: str) -> Column:
    """Least squares over decimals, x counted from 2000, divided once; null for under three points, 0 if x does not vary."""
    n, fx, fy = F.count("*").cast("decimal(20,0)"), (F.col(x) - 2000).cast("decimal(12,0)"), F.col(y).cast("decimal(18,2)")
    top = n.cast("double") * F.sum(fx * fy).cast("double") - F.sum(fx).cast("double") * F.sum(fy).cast("double")
    bottom = n.cast("double") * F.sum(fx * fx).cast("double") - F.sum(fx).cast("double") * F.sum(fx).cast("double")
    return F.when(F.count("*") < 3, None).when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.try_divide(top, bottom))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts for each upper bound (inclusive) and +Inf: one pass, one row a key and bound."""
    cells = [F.struct(F.lit(str(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.count(value).alias("n")))
    return df.groupBy(*keys).agg(F.array(*cells).alias("cells")).select(*keys, F.explode("cells").alias("c")).select(*keys, "c.le", "c.n")


def alert_runs(df: DataFrame, key: str, at: str, bad: Column, for_s: float = 0) -> DataFrame:
    """Maximal runs of rows for which `bad` holds (gaps and islands): key, first, last, length, fired_at.

    `at` is in seconds; fired_at is the first row at least `for_s` seconds after the run began, null if there is none.
    """
    order = W.partitionBy(key).orderBy(at)
    marked = df.withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumn("_start", (F.col("_bad") & ~F.coalesce(F.lag("_bad").over(order), F.lit(False))).cast("int"))
    run = marked.withColumn("_run", F.sum("_start").over(order)).filter("_bad")
    run = run.withColumn("_begin", F.min(at).over(W.partitionBy(key, "_run")))
    fired = F.min(F.when(F.col(at) - F.col("_begin") >= for_s, F.col(at))).alias("fired_at")
    return run.groupBy(key, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length"), fired).drop("_run")


def counter_increase(df: DataFrame, key: str, at: str, counter: str, seconds: int) -> Column:
    """Increase of a cumulative counter since the first sample at most `seconds` before; never negative."""
    w = W.partitionBy(key).orderBy(at).rangeBetween(-seconds, 0)
    return F.greatest(F.lit(0), F.col(counter) - F.first(counter).over(w))


def round_robin(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """First rows of every key, then second ones, until n."""
    turn = rank_rows(df, [key], *order)
    return turn.orderBy("rank", key).limit(n)


def banded(df: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """Column band of half-open ranges, the last one closed; null outside."""
    out = F.lit(None).cast("string")
    for i in range(len(bounds) - 2, -1, -1):
        low, high, last = bounds[i], bounds[i + 1], i == len(bounds) - 2
        inside = (F.col(value) >= low) & ((F.col(value) <= high) if last else (F.col(value) < high))
        out = F.when(inside, F.lit(f"[{low},{high}{']' if last else ')'}")).otherwise(out)
    return df.withColumn("band", out)


def slo(events: DataFrame, keys: Sequence[str], bad: Column, answered: Column, fast: Column, target: float) -> DataFrame:
    """(keys, requests, bad, availability, budget_spent, latency_attainment); the last is null without answers."""
    share = F.try_divide(F.count_if(bad), F.count("*"))
    return events.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if(bad).alias("bad"), F.round(1 - share, 6).alias("availability"),
        F.round(share / (1 - target), 4).alias("budget_spent"), F.round(F.try_divide(F.count_if(answered & fast), F.count_if(answered)), 6).alias("latency_attainment"),
    )


def sets_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both frames hold the same distinct rows; one aggregation, no join."""
    both = a.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(b.withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1)))
    seen = both.groupBy(*a.columns).agg(F.max("_l").alias("l"), F.max("_r").alias("r"))
    return seen.agg((F.count_if(F.col("l") != F.col("r")) == 0).alias("equal"))


def public(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """The allowed columns only; one that is not there is an error."""
    return df.select(*[F.col(f"`{c}`") for c in allowed])


def eligible(df: DataFrame, column: str, wanted: Sequence[str], known: Sequence[str]) -> DataFrame:
    """Rows of the wanted kinds, which must be some of the known ones."""
    if not wanted or not set(wanted) <= set(known):
        raise ValueError(f"unknown or no kinds: {sorted(wanted)}")
    return df.filter(F.col(column).isin(*wanted))


def sliced(facts: DataFrame, tickers: Sequence | None = None, metrics: Sequence[str] | None = None) -> DataFrame:
    """Facts of the tickers and metrics; without either a slice is unbounded, which is an error."""
    if not tickers and not metrics:
        raise ValueError("CATALOG_SLICE_UNBOUNDED")
    return select_rows(facts, ticker=tickers or None, metric=metrics or None)


def preferred(df: DataFrame, keys: Sequence[str], fit: Column) -> DataFrame:
    """Rows that fit; all rows of a key where none does."""
    some = df.withColumn("_fit", F.coalesce(fit, F.lit(False))).withColumn("_some", F.max("_fit").over(W.partitionBy(*keys)))
    return some.filter(F.col("_fit") | ~F.col("_some")).drop("_fit", "_some")


def pct_change(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """df with the change of a value since the row before of its key, as a share of that; null for the first row and after a zero or null."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("pct_change", F.try_divide(F.col(value) - before, before))


def describe(df: DataFrame) -> DataFrame:
    """(c, n, mean, std, min, q25, q50, q75, max) of each numeric column, nulls left out; quantiles are interpolated, exactly, in one pass over counted values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for c in df.columns])).alias("x")).select("x.*")
    counted = long.filter("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("k"))  # percentile() weighs values by their counts
    q = lambda p: F.round(F.percentile("v", F.lit(p), F.col("k")), 4)
    n, s = F.sum("k"), F.sum(F.col("v") * F.col("k"))
    spread = long.groupBy("c").agg(F.round(F.stddev_samp("v"), 4).alias("std"))
    out = counted.groupBy("c").agg(n.alias("n"), F.round(s / n, 4).alias("mean"), F.min("v").alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("v").alias("max"))
    return out.join(spread, "c").select("c", "n", "mean", "std", "min", "q25", "q50", "q75", "max")
