"""Queries over statement metrics, text and period functions, and telemetry measures."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .catalog import FACTS, facts, query
from .functions import periods as P
from .functions import scalar as S
from .operators import relational as R
from .operators import statements as M

#: What the figures of an order year stand for: metric -> (column expression, SQL).
STAND_INS = {
    "NET_REVENUE": "revenue", "COGS": "cost", "GROSS_PROFIT": "revenue - cost", "LNST": "assets", "EQUITY": "cost", "TOTAL_ASSETS": "revenue",
    "LIABILITIES": "revenue - cost", "TOTAL_CAPITAL": "revenue", "CURRENT_ASSETS": "assets", "CURRENT_LIABILITIES": "cost",
}


def metrics(t) -> DataFrame:
    """(ticker, fiscal_year, scope, metric, value) of every company and year."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).alias("value")) for m, e in STAND_INS.items()])
    return facts(t).select("ticker", "fiscal_year", F.lit("HOP_NHAT").alias("scope"), F.explode(cells).alias("c")).select("ticker", "fiscal_year", "scope", "c.metric", "c.value").filter("value is not null")


def rows_of(t, rows, schema: str) -> DataFrame:
    return t("region").sparkSession.createDataFrame(rows, schema)


#: Customers whose rows per_customer() makes in one task.
CUSTOMERS_A_TASK = 20_000


def per_customer(t, rows, schema: str, *ids: str) -> DataFrame:
    """The rows for each customer of the given table, whose number is put before what the columns `ids` hold."""
    names = re.findall(r"(?:^|, )(\w+) (?![^<]*>)", schema)
    held = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    customers = t("customer").select(F.col("c_custkey").cast("string").alias("_c"))
    parts = 1 + customers.count() // CUSTOMERS_A_TASK
    if parts > 1:  # else a small file makes all rows in one task
        customers = customers.repartition(parts, "_c")
    every = customers.select("_c", F.explode(F.from_json(F.lit(held), f"array<struct<{schema}>>")).alias("r")).select("_c", "r.*")
    for c in ids:
        own = lambda x: F.concat("_c", F.lit(":"), x)
        every = every.withColumn(c, F.transform(c, own) if isinstance(every.schema[c].dataType, ArrayType) else own(F.col(c)))
    return every.drop("_c")


def per_customer_sql(rows, names: str, *ids: str) -> str:
    """What per_customer() rows must give; {c}: in other texts stands for the customer's number."""
    told = [f"c_custkey || ':' || {n} AS {n}" if n in ids else n if not any(isinstance(r[i], str) for r in rows) else f"replace({n}, '{{c}}', c_custkey::VARCHAR) AS {n}" for i, n in enumerate(names.split(", "))]
    return f"SELECT {', '.join(told)} FROM customer CROSS JOIN ({values(rows, names)}) v"


def worded(t, texts: list[str], key: str = "o_orderkey"):
    """Of an order, the text that its number picks, with its year and the ones before in place of {y}, {y-1}, {y-2}, {y-3}, and its number for {k}."""
    out = F.element_at(F.array(*map(F.lit, texts)), (F.pmod(key, F.lit(len(texts))) + 1).cast("int"))
    for back in range(4):
        out = F.replace(out, F.lit(f"{{y-{back}}}" if back else "{y}"), (F.year("o_orderdate") - back).cast("string"))
    return F.replace(out, F.lit("{k}"), F.col("o_orderkey").cast("string"))


def worded_sql(texts: list[str | None]) -> str:
    out = "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in texts) + f"][1 + o_orderkey % {len(texts)}]"
    for back in range(4):
        out = f"replace({out}, '{'{'}y{f'-{back}' if back else ''}{'}'}', (year(o_orderdate) - {back})::VARCHAR)"
    return f"replace({out}, '{{k}}', o_orderkey::VARCHAR)"


def values(rows, names: str) -> str:
    """SQL of literal rows: what a fixture must give."""
    def lit(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


@query(f"""WITH f AS (SELECT a.*, b.cost AS cost0, b.revenue AS revenue0 FROM {FACTS} a LEFT JOIN {FACTS} b ON a.ticker = b.ticker AND a.fiscal_year = b.fiscal_year + 1)
SELECT ticker, fiscal_year, ratio, round(CASE ratio WHEN 'ROE' THEN assets / nullif((cost + cost0) / 2, 0) * 100 WHEN 'ROA' THEN assets / nullif((revenue + revenue0) / 2, 0) * 100 WHEN 'GROSS_MARGIN' THEN (revenue - cost) / nullif(revenue, 0) * 100
 WHEN 'NET_MARGIN' THEN assets / nullif(revenue, 0) * 100 WHEN 'DEBT_TO_EQUITY' THEN (revenue - cost) / nullif(cost, 0) ELSE assets / nullif(cost, 0) END, 4) AS value
FROM f CROSS JOIN (VALUES ('ROE'),('ROA'),('GROSS_MARGIN'),('NET_MARGIN'),('DEBT_TO_EQUITY'),('CURRENT_RATIO')) r(ratio)""")
def mth_ratio(t):
    return M.ratios(metrics(t)).select("ticker", "fiscal_year", "ratio", F.round("value", 4).alias("value"))


LINES = [
    ("r1", "B01", "270", "current", 300.0, 1), ("r1", "B01", "100", "current", 100.0, 1), ("r1", "B01", "200", "current", 198.0, 1), ("r1", "B01", "440", "current", 303.0, 1),
    ("r1", "B01", "110", "current", 60.0, 1), ("r1", "B01", "110", "prior", 40.0, 1), ("r1", "B03", "70", "current", 60.0, 1), ("r1", "B03", "60", "current", 45.0, 1),
    ("r2", "B02", "10", "current", 500.0, 1000), ("r2", "B02", "11", "current", -300.0, 1000), ("r2", "B02", "25", "current", -20.0, 1000), ("r2", "B02", "20", "current", 200.0, 1000),
    ("r2", "B02", "22", "current", 5.0, 1000), ("r3", "B02", "50", "prior", 10.0, 1), ("r3", "B02", "60", "prior", 7.0, 1), ("r3", "B02", "51", "prior", 3.0, 1),
]
CHECKED = [
    ("r1", "B01 270 = 100 200", "current", "PASS"), ("r1", "B01 270 = 440", "current", "FAIL"), ("r1", "B01 100 = 110 120 130 140 150", "current", "FAIL"),
    ("r1", "B03 70 = B01:110", "current", "PASS"), ("r1", "B03 60 = B01:110:prior", "current", "FAIL"), ("r1", "B03 70 = 50 60 61", "current", "FAIL"),
    ("r2", "B02 20 = 10 -11", "current", "PASS"), ("r3", "B02 60 = 50 -51 -52", "prior", "PASS"),
]


@query(per_customer_sql(CHECKED, "report_id, identity, col, status", "report_id"))
def agg_identities(t):
    lines = per_customer(t, LINES, "report_id string, statement string, code string, col string, value double, unit int", "report_id")
    return M.check_identities(lines).filter("status <> 'MISSING'")


GUARDED = [("A", "TOTAL_ASSETS", 100.0), ("A", "TOTAL_CAPITAL", 100.0), ("A", "LIABILITIES", 60.0), ("A", "EQUITY", 30.0), ("B", "NET_REVENUE", 10.0), ("B", "COGS", 4.0), ("B", "GROSS_PROFIT", 6.0), ("B", "LNST", 5.0), ("C", "TOTAL_ASSETS", 9.0), ("C", "TOTAL_CAPITAL", 5.0)]


@query(per_customer_sql([("A", "TOTAL_ASSETS"), ("A", "TOTAL_CAPITAL"), ("B", "NET_REVENUE"), ("B", "COGS"), ("B", "GROSS_PROFIT"), ("B", "LNST")], "ticker, metric", "ticker"))
def agg_guard(t):
    rows = per_customer(t, GUARDED, "ticker string, metric string, value double", "ticker").withColumn("fiscal_year", F.lit(2020)).withColumn("scope", F.lit("RIENG"))
    return M.guard(rows).select("ticker", "metric")


@query(f"WITH c AS (SELECT count(*) AS n, count(cost) AS k FROM {FACTS}) SELECT 'balance_sheet' AS name, n AS checked, n AS passed, CAST(0 AS BIGINT) AS failed, CAST(1 AS DOUBLE) AS pass_rate FROM c UNION ALL SELECT 'liabilities_equity', k, k, 0, 1 FROM c UNION ALL SELECT 'gross_profit', k, k, 0, 1 FROM c UNION ALL SELECT 'income_tax', 0, 0, 0, NULL UNION ALL SELECT 'lnst_split', 0, 0, 0, NULL")
def agg_quality(t):
    return M.quality(metrics(t))


DUPLICATES = [("a", 5.0, None, False, 1), ("a", 5.0, "10", True, 2), ("a", 5.0, "10", False, 3), ("b", 5.0, "10", False, 1), ("b", 6.0, None, False, 2), ("c", 5.0, "10", False, 1), ("c", 6.0, "11", False, 2), ("d", 7.0, None, True, 1), ("d", 7.0, None, False, 2), ("e", 7.0, None, False, 1), ("e", 8.0, None, False, 2)]


@query(per_customer_sql([("a", 3), ("b", 1), ("d", 2)], "metric, spot", "metric"))
def win_keep_first(t):
    return M.resolve_metrics(per_customer(t, DUPLICATES, "metric string, value double, line_code string, carried boolean, spot int", "metric"), ["metric"], "spot").select("metric", "spot")


@query(f"SELECT ticker, metric, CASE WHEN count(DISTINCT fiscal_year) = 3 THEN sum(v) END AS total FROM (SELECT ticker, fiscal_year, 'NET_REVENUE' AS metric, revenue AS v FROM {FACTS} UNION ALL SELECT ticker, fiscal_year, 'LNST', assets FROM {FACTS} WHERE assets IS NOT NULL) WHERE fiscal_year BETWEEN 1996 AND 1998 GROUP BY 1, 2")
def agg_sum(t):
    return M.sum_years(metrics(t).filter("metric in ('NET_REVENUE', 'LNST')"), [1996, 1997, 1998]).select("ticker", "metric", "total")


@query("SELECT o_custkey, CASE WHEN count(*) < 2 THEN 'TOO_FEW' WHEN count(DISTINCT o_orderstatus) > 1 THEN 'UNIT_MISMATCH' ELSE 'OK' END AS status, CASE WHEN count(*) >= 2 AND count(DISTINCT o_orderstatus) = 1 THEN round(avg(o_totalprice), 4) END AS mean FROM orders GROUP BY 1")
def agg_average(t):
    rows = t("orders").select("o_custkey", F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("unit"))
    return M.mean_of(rows, ["o_custkey"]).select("o_custkey", "status", F.round("mean", 4).alias("mean"))


@query(f"WITH f AS (SELECT *, CASE WHEN ticker % 4 = 0 THEN revenue + 1 ELSE revenue END AS said FROM {FACTS}) SELECT a.ticker, a.fiscal_year, CASE WHEN b.ticker IS NULL THEN 'NO_NEXT_YEAR_VALUE' WHEN b.ticker % 4 = 0 THEN 'RESTATED_IN_NEXT_REPORT' ELSE 'CONFIRMED' END AS status FROM f a LEFT JOIN f b ON a.ticker = b.ticker AND b.fiscal_year = a.fiscal_year + 1")
def jn_next_year_confirm(t):
    f = facts(t)
    before = f.select("ticker", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.when(F.col("ticker") % 4 == 0, F.col("revenue") + 1).otherwise(F.col("revenue")).alias("prior"))
    rows = f.join(before, ["ticker", "fiscal_year"], "left").select("ticker", F.lit("HOP_NHAT").alias("scope"), F.lit("NET_REVENUE").alias("metric"), "fiscal_year", F.col("revenue").alias("value"), "prior")
    return M.confirm_by_next_year(rows).select("ticker", "fiscal_year", "status")


HINTS = [("a", 1, "MILLION", "VND"), ("a", 2, "THOUSAND", "VND"), ("b", 1, "MILLION", None), ("b", 1, "THOUSAND", None), ("c", 2, "RAW", "VND"), ("c", 1, "MILLION", "VND"), ("d", 3, None, None), ("e", 2, None, "VND"), ("e", 2, "RAW", "VND"), ("f", 1, "MILLION", "VND"), ("f", 1, "MILLION", "USD")]


@query(per_customer_sql([("a", "RESOLVED", "MILLION", "VND"), ("b", "AMBIGUOUS", None, None), ("c", "AMBIGUOUS", None, None), ("d", "UNRESOLVED", None, None), ("e", "RESOLVED", "RAW", "VND"), ("f", "AMBIGUOUS", None, None)], "cell, status, scale, unit", "cell"))
def agg_scale_resolve(t):
    return M.resolve_scale(per_customer(t, HINTS, "cell string, level int, scale string, unit string", "cell"), ["cell"])


@query(per_customer_sql([("a", None, "AMBIGUOUS"), ("b", None, "AMBIGUOUS"), ("c", "MILLION", "UNIT_HINT"), ("e", "RAW", "UNIT_HINT"), ("f", "MILLION", "UNIT_HINT")], "cell, scale, basis", "cell"))
def agg_table_scale(t):
    hints = per_customer(t, HINTS, "cell string, level int, scale string, unit string", "cell").filter("scale is not null")
    return M.table_scale(hints, ["cell"])


@query("SELECT o_custkey AS ticker, 'n' || CAST(mode_name AS VARCHAR) AS company_name, CASE WHEN bank THEN 'BANK' ELSE 'CORPORATE' END AS template, first_year, last_year, scopes AS statement_scopes FROM (SELECT o_custkey, min_by(p, (-n, p)) AS mode_name, max(b) AS bank, min(lo) AS first_year, max(hi) AS last_year FROM (SELECT o_custkey, o_orderpriority AS p, count(*) AS n, bool_or(false) AS b0, CAST(min(year(o_orderdate)) AS INT) AS lo, CAST(max(year(o_orderdate)) AS INT) AS hi FROM orders GROUP BY 1, 2) JOIN (SELECT o_custkey, bool_or(o_totalprice > 300000) AS b FROM orders GROUP BY 1) USING (o_custkey) GROUP BY 1) JOIN (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS scopes FROM orders GROUP BY 1) USING (o_custkey)")
def agg_companies(t):
    reports = t("orders").select(F.col("o_custkey").alias("ticker"), F.concat(F.lit("n"), "o_orderpriority").alias("company_name"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderstatus").alias("scope"), "o_totalprice")
    return M.companies(reports, reports.filter("o_totalprice > 300000"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity < 1000 AND l_quantity <> 0 AND (l_returnflag = 'R' OR l_linestatus = 'F'))")
def flt_note_as_value(t):
    scale = F.when(F.col("l_linestatus") == "F", "RAW").otherwise("MILLION")
    return t("lineitem").filter(~M.note_as_value(F.col("l_quantity"), scale, F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT f) = 1 THEN min(f) END AS class FROM (SELECT l_orderkey FROM lineitem GROUP BY 1) LEFT JOIN (SELECT l_orderkey, l_returnflag AS f FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2) USING (l_orderkey) GROUP BY 1")
def agg_content_class(t):
    rows = t("lineitem").select("l_orderkey", F.col("l_returnflag").alias("named"), F.lit(None).cast("string").alias("titled"))
    return M.content_class(rows, "l_orderkey")


@query("SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS y, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS scopes FROM orders GROUP BY 1, 2")
def agg_coverage(t):
    return t("orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("scopes"))


@query(f"SELECT 'NET_REVENUE' AS metric, count(*) AS n FROM {FACTS} UNION ALL SELECT 'LNST', count(assets) FROM {FACTS} UNION ALL SELECT 'COGS', count(cost) FROM {FACTS}")
def agg_metric_coverage(t):
    return metrics(t).filter("metric in ('NET_REVENUE', 'LNST', 'COGS')").groupBy("metric").agg(F.count("*").alias("n"))


@query("SELECT query_id, doc_id, score FROM (SELECT o_custkey AS query_id, o_orderpriority AS doc_id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def agg_best_per_doc(t):
    o = t("orders")
    best = o.groupBy(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("doc_id")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("b"))
    return best.select("query_id", "doc_id", F.col("b.o_totalprice").alias("score"))


@query("WITH w AS (SELECT event_type, value, ntile(5) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS part FROM events) SELECT event_type, round(quantile_disc(value, 0.95) FILTER (WHERE part = 5) / quantile_disc(value, 0.95) FILTER (WHERE part = 1), 6) AS ratio FROM w GROUP BY 1")
def agg_drift(t):
    part = t("events").withColumn("part", F.ntile(5).over(W.partitionBy("event_type").orderBy("ts", "event_id")))
    p95 = lambda k: F.expr(f"percentile_disc(0.95) within group (order by value) filter (where part = {k})")
    return part.groupBy("event_type").agg(F.round(F.try_divide(p95(5), p95(1)), 6).alias("ratio"))


@query("SELECT CASE WHEN value < 25 THEN '[0,25)' WHEN value < 50 THEN '[25,50)' ELSE '[50,100]' END AS band, count(*) AS cases, count(*) FILTER (WHERE event_type = 'click') AS retried, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS retry_rate FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def agg_retry(t):
    e = t("events").filter("value between 0 and 100")
    return R.banded(e, "value", [0, 25, 50, 100]).groupBy("band").agg(F.count("*").alias("cases"), F.count_if(F.col("event_type") == "click").alias("retried"), F.round(F.try_divide(F.count_if(F.col("event_type") == "click"), F.count("*")), 6).alias("retry_rate"))


@query("SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error' OR value > 100) AS bad, round(1 - count(*) FILTER (WHERE event_type = 'error' OR value > 100) / count(*), 6) AS availability, round((count(*) FILTER (WHERE event_type = 'error' OR value > 100) / count(*)) / 0.005, 4) AS budget_spent, round(count(*) FILTER (WHERE event_type = 'purchase' AND value <= 50) / nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0), 6) AS latency_attainment FROM events GROUP BY 1")
def agg_slo(t):
    return R.slo(t("events"), ["user_id"], (F.col("event_type") == "error") | (F.col("value") > 100), F.col("event_type") == "purchase", F.col("value") <= 50, target=0.995)


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.95) AS p95, round(count(*) / (epoch_ms(max(ts)) - epoch_ms(min(ts))) * 1000, 8) AS per_second FROM events GROUP BY 1")
def agg_load(t):
    span = (F.unix_millis(F.max(F.col("ts").cast("timestamp"))) - F.unix_millis(F.min(F.col("ts").cast("timestamp"))))
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), R.nearest_rank("value", 0.95).alias("p95"), F.round(F.try_divide(F.count("*"), span) * 1000, 8).alias("per_second"))


@query("SELECT round(greatest(0, (min(value) FILTER (WHERE event_type = 'purchase') + max(value) FILTER (WHERE event_type <> 'purchase')) / 2), 6) AS threshold, min(value) FILTER (WHERE event_type = 'purchase') > max(value) FILTER (WHERE event_type <> 'purchase') AS separates FROM events")
def agg_memory_threshold(t):
    low, high = F.min(F.when(F.col("event_type") == "purchase", F.col("value"))), F.max(F.when(F.col("event_type") != "purchase", F.col("value")))
    return t("events").agg(F.round(F.greatest(F.lit(0.0), (low + high) / 2), 6).alias("threshold"), (low > high).alias("separates"))


@query("SELECT o_custkey, o_orderstatus FROM orders GROUP BY 1, 2 HAVING true QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) >= 1")
def win_first_occurrence(t):
    return R.top_n(t("orders"), ["o_custkey", "o_orderstatus"], 1, F.col("o_orderkey")).select("o_custkey", "o_orderstatus")


@query("SELECT event_id, last_value(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events")
def win_previous_release(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return t("events").select("event_id", F.last(F.when(F.col("event_type") != "click", F.col("event_type")), ignorenulls=True).over(w).alias("previous"))


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000) DESC, c_mktsegment DESC, c_custkey) AS rank FROM customer")
def win_rerank(t):
    return R.rank_rows(t("customer"), ["c_nationkey"], F.desc(F.floor(F.col("c_acctbal") / 1000)), F.desc("c_mktsegment"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "rank")


@query("SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)) + (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)) = 0 AS equal")
def set_equal(t):
    return R.sets_equal(t("customer").select(F.col("c_nationkey").alias("k")), t("nation").select(F.col("n_nationkey").alias("k")))


@query("SELECT part, name FROM (SELECT 'nlargest' AS part, c_name AS name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL SELECT part, name FROM (SELECT 'nsmallest' AS part, c_name AS name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5)")
def top_pandas(t):
    c = t("customer")
    one = lambda part, *o: c.orderBy(*o).limit(5).select(F.lit(part).alias("part"), F.col("c_name").alias("name"))
    return one("nlargest", F.desc("c_acctbal"), "c_custkey").unionByName(one("nsmallest", "c_acctbal", "c_custkey"))


PERIODS = ["{y}", "{y-1}-Q4", "{y}-Q2", "{y}-9M"]


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) - CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END, [13, 12, 6, 9][1 + o_orderkey % 4], o_orderkey) AS INT) AS rank FROM orders")
def srt_chrono(t):
    return R.rank_rows(t("orders").withColumn("period", worded(t, PERIODS)), ["o_custkey"], P.chronological(F.col("period")), F.col("o_orderkey")).select("o_orderkey", F.col("rank").cast("int").alias("rank"))


TEXTS = [
    ("n1", "normalize", "ＡＢ &amp;amp; c\r\n {k}", "AB & c {k}"), ("n2", "fold", "Đơn vị tính:  TRIỆU ĐỒNG ﬁ Straße {k}", "don vi tinh: trieu dong fi strasse {k}"), ("n3", "fold_punct", "Nợ/Vốn (chủ) {k}", "no von chu {k}"),
    ("n4", "fold_in_place", "Năm {y} Đầu", "Nam {y} Dau"), ("n5", "label_key", "IV. 1. Lợi nhuận sau thuế {y} (60 = 50 - 51) (*)", "loi nhuan sau thue {y}"), ("n6", "label_key", "18.1 Vốn góp", "von gop"), ("n7", "answer_norm", "12,5 % -Ab!", "125-ab"),
    ("n8", "period_label", "{y} triệu đồng", "{y}"), ("n9", "period_label", "Quý 3 năm {y}", "{y}-Q3"), ("n10", "period_label", "Q2/{y}", "{y}-Q2"), ("n11", "period_label", "năm {y}", None), ("n12", "unit", "don vi tinh: trieu dong", "MILLION"), ("n13", "unit", "dvt: vnd", "RAW"), ("n14", "unit", "gia vang", None),
]


@query(f"SELECT o_orderkey, {worded_sql([want for *_, want in TEXTS])} AS out FROM orders")
def str_functions(t):
    made = {"normalize": S.normalize, "fold": S.fold, "fold_punct": S.fold_punct, "fold_in_place": S.fold_in_place, "label_key": S.label_key, "answer_norm": S.answer_norm, "period_label": P.period_label, "unit": S.unit_scale}
    rows = t("orders").select("o_orderkey", worded(t, [x for _, _, x, _ in TEXTS]).alias("x"), F.element_at(F.array(*[F.lit(f) for _, f, _, _ in TEXTS]), (F.pmod("o_orderkey", F.lit(len(TEXTS))) + 1).cast("int")).alias("f"))
    parts = [rows.filter(F.col("f") == name).select("o_orderkey", f(F.col("x")).alias("out")) for name, f in made.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SPANS = [("doanh thu {y-2} - {y} va {y-3}", "[{y-3}, {y-2}, {y-1}, {y}]"), ("tu 1950 den {y}", "[1950, {y}]"), ("ma 1{y} va {y}", "[{y}]"), ("khong co", "[]"), ("{y} đến năm {y-2}", "[{y-2}, {y-1}, {y}]")]


@query(f"SELECT o_orderkey, {worded_sql([want for _, want in SPANS])} AS years FROM orders")
def dt_years(t):
    return t("orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(P.years(worded(t, [x for x, _ in SPANS])).cast("array<string>"), ", "), F.lit("]")).alias("years"))


NAMED = [("doanh thu quy 3/{y} va nam {y-1}", "{y-1},{y}-Q3"), ("luy ke 9 thang {y}", "{y}-9M"), ("da quy {y}", "{y}"), ("quy 1 nam {y}, quy 2 nam {y}", "{y}-Q1,{y}-Q2")]


@query(f"SELECT o_orderkey, {worded_sql([want for _, want in NAMED])} AS periods FROM orders")
def dt_periods(t):
    return t("orders").select("o_orderkey", F.array_join(P.periods(worded(t, [x for x, _ in NAMED])), ",").alias("periods"))


HEADERS = [("nam nay", "CURRENT"), ("so dau nam", "PRIOR"), ("31/12/{y}", "CURRENT"), ("01/01/{y}", "PRIOR"), ("{y-1}", "PRIOR"), ("{y} {y-1}", None), ("thuyet minh", None), ("31.12.{y-1} vnd", "PRIOR"), ("so cuoi ky {y-3}", "CURRENT")]


@query(f"SELECT o_orderkey, {worded_sql([want for _, want in HEADERS])} AS period FROM orders")
def dt_column_period(t):
    return t("orders").select("o_orderkey", P.column_period(worded(t, [x for x, _ in HEADERS]), F.year("o_orderdate")).alias("period"))


PAIRS = [("nam nay", "nam truoc", 1), ("{y-1}", "{y}", 2), ("x", "so dau nam", 1), ("x", "y", None)]


@query("SELECT o_orderkey, [1, 2, 1, NULL][1 + o_orderkey % 4] AS current FROM orders")
def dt_orientation(t):
    return t("orders").select("o_orderkey", P.current_first(worded(t, [a for a, _, _ in PAIRS]), worded(t, [b for _, b, _ in PAIRS]), F.year("o_orderdate")).alias("current"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS INT) END AS y FROM orders")
def dt_path_periods(t):
    label = F.when(F.col("o_orderkey") % 2 == 0, "nam nay").otherwise("nam truoc")
    return t("orders").select("o_orderkey", P.path_period(label, F.year("o_orderdate")).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * (1.1 + (l_linenumber % 7) / 10) + l_linenumber % 7 + 17, 6) AS probe FROM lineitem")
def mth_perturb(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(S.perturb(F.col("l_quantity"), F.col("l_linenumber")), 6).alias("probe"))


@query("SELECT l_orderkey, l_linenumber, true AS same, abs(l_tax - l_discount) <= 1e-4 * greatest(abs(l_tax), abs(l_discount)) AS near FROM lineitem")
def mth_close(t):
    price = F.col("l_extendedprice")
    return t("lineitem").select("l_orderkey", "l_linenumber", (S.close(price / 3 * 3, price) & ~S.close(price * 1.0000001, price)).alias("same"), S.relatively_close(F.col("l_tax"), F.col("l_discount"), 1e-4).alias("near"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS cosine, CAST(1 AS DOUBLE) AS length FROM embeddings")
def mth_cosine(t):
    e = t("embeddings")
    first = F.broadcast(e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q")))  # one row
    return e.crossJoin(first).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"), F.round(S.norm(S.unit_vector(F.col("embedding"))), 6).alias("length"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_size * 1000000.0 END AS vnd FROM part")
def str_figure(t):
    label = F.when(F.col("p_size") % 2 == 0, "Lãi cơ bản trên cổ phiếu").otherwise("Doanh thu")
    return t("part").select("p_partkey", S.figure(F.col("p_size").cast("string"), label, F.lit("MILLION")).cast("double").alias("vnd"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'), ' '), lambda x: x = 'the')) AS INT) AS n FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x00-\\x7F]')")
def str_phrase_spans(t):
    plain = t("documents").filter("text is not null").filter(~F.col("text").rlike("[^\\x00-\\x7F]"))
    return plain.select("doc_id", S.phrase_count(S.fold_punct(F.col("text")), "the").alias("n"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def prj_public(t):
    return R.public(t("customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_source_type(t):
    return R.eligible(t("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"], ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("o_orderkey", "o_orderpriority")


@query(f"SELECT ticker, fiscal_year FROM {FACTS} WHERE ticker IN (1, 4, 7)")
def flt_company_slice(t):
    return R.sliced(metrics(t), tickers=[1, 4, 7]).select("ticker", "fiscal_year").distinct()


@query(f"SELECT ticker, fiscal_year, assets AS value FROM {FACTS} WHERE assets IS NOT NULL")
def flt_screening_slice(t):
    return R.sliced(metrics(t), metrics=["LNST"]).select("ticker", "fiscal_year", "value")


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS fit, max(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS anyfit FROM lineitem) SELECT l_orderkey, l_linenumber FROM x WHERE fit OR NOT anyfit")
def flt_table_class(t):
    return R.preferred(t("lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END AS DOUBLE) AS filled, round_even(p_retailprice / 7, 2) AS rounded, CAST(ceil(least(greatest(p_size, 1), 50) / 10.0) AS BIGINT) AS bin FROM part")
def udf_clean(t):
    p = t("part").withColumn("size", F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")))
    return p.fillna({"size": 0.0}).select("p_partkey", F.col("size").alias("filled"), F.bround(F.col("p_retailprice") / 7, 2).alias("rounded"), F.ceil(F.least(F.greatest(F.col("p_size"), F.lit(1)), F.lit(50)) / 10).alias("bin"))


@query("SELECT p_partkey, regexp_matches(p_name, '(?i)1') AS has, lower(trim(p_brand)) AS brand FROM part")
def udf_strings(t):
    return t("part").select("p_partkey", F.col("p_name").rlike("(?i)1").alias("has"), F.lower(F.trim("p_brand")).alias("brand"))
