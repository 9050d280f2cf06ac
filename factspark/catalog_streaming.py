"""Queries that start a stream over a table's files, in keyed state, and read what it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query
from .sources.scratch import folder
from .streaming import stateful as S


def _run(t, name: str, changes: DataFrame) -> DataFrame:
    return S.logged(changes, folder(t.spark, name), folder(t.spark, f"{name}-checkpoint"))


def _second():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


@query("WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, max(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT *, coalesce(v > 50, false) AS bad, CASE WHEN coalesce(v > 50, false) AND NOT coalesce(lag(v > 50) OVER o, false) THEN 1 ELSE 0 END AS st FROM e WINDOW o AS (PARTITION BY user_id ORDER BY s)), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY s) AS run FROM m), b AS (SELECT *, min(s) OVER (PARTITION BY user_id, run) AS begin FROM r WHERE bad) SELECT user_id, min(s) AS first, max(s) AS last, count(*) AS length, min(CASE WHEN s - begin >= 7200 THEN s END) AS fired_at FROM b GROUP BY user_id, run")
def stm_alert_runs(t):
    samples = t.stream("events").select(F.col("user_id").alias("key"), _second().alias("t"), (F.col("value") > 50).cast("long").alias("bad"), F.lit(1).cast("long").alias("total"))
    return S.alerts(_run(t, "alert-runs", S.alert_changes(samples, [S.Rule("high", for_s=7200)], late=3600))).drop("rule").withColumnRenamed("key", "user_id")


BURN = [S.Rule("fast", for_s=1800, limit=0.3, long_s=21_600, short_s=3_600), S.Rule("slow", for_s=7_200, limit=0.2, long_s=86_400, short_s=14_400)]


def _burn_sql(rule: S.Rule) -> str:
    over = lambda c, seconds: f"({c} - first({c}) OVER (PARTITION BY key ORDER BY s RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW))"
    holds = " AND ".join(f"{over('total', w)} > 0 AND {over('bad', w)} > CAST({rule.limit} AS DOUBLE) * {over('total', w)}" for w in (rule.long_s, rule.short_s))
    return f"""SELECT key, '{rule.name}' AS rule, min(s) AS first, max(s) AS last, count(*) AS length, min(CASE WHEN s - begin >= {rule.for_s} THEN s END) AS fired_at FROM (
  SELECT *, min(s) OVER (PARTITION BY key, run) AS begin FROM (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY s) AS run FROM (SELECT *, {holds} AS hit FROM c)) WHERE hit) GROUP BY key, run"""


@query(f"""WITH e AS (SELECT user_id % 8 AS key, epoch_us(ts) // 1000000 AS s, sum((event_type = 'error')::INT) AS bad, count(*) AS total FROM events GROUP BY 1, 2),
c AS (SELECT key, s, sum(bad) OVER (PARTITION BY key ORDER BY s) AS bad, sum(total) OVER (PARTITION BY key ORDER BY s) AS total FROM e)
{_burn_sql(BURN[0])} UNION ALL {_burn_sql(BURN[1])}""")
def stm_burn_alerts(t):
    samples = t.stream("events").select((F.col("user_id") % 8).alias("key"), _second().alias("t"), (F.col("event_type") == "error").cast("long").alias("bad"), F.lit(1).cast("long").alias("total"))
    return S.alerts(_run(t, "burn-alerts", S.alert_changes(samples, BURN, late=3600)))


@query("SELECT user_id, CAST(row_number() OVER o AS INT) AS place, event_id FROM events WHERE user_id IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) QUALIFY row_number() OVER o <= 5")
def stm_recent_events(t):
    rows = t.stream("events").filter("user_id IS NOT NULL").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return S.recent(_run(t, "recent", S.recent_changes(rows, 5))).select(F.col("key").alias("user_id"), "place", F.col("id").alias("event_id"))
