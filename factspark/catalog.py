"""Registry of the engine's queries: name -> (query, SQL that gives the same rows, or None).

The driver tables stand in for facts: a customer is a company, an order year a
fiscal year, sums of order prices by status its metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import periods as P
from .functions import scalar as S
from .operators import relational as R
from .operators import retrieval as T
from .sources import scratch
from .streaming import telemetry

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables:
    """The given tables by name: t(name) as they are, t.stream(name) as a stream of their files."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str, files: int = 64) -> DataFrame:
        """At most so many files a batch. The path is a pattern, since a stream of one plain path must be of a folder."""
        return self.spark.readStream.schema(self(name).schema).option("maxFilesPerTrigger", files).parquet(f"{self.sf_dir}/{name}.parque[t]")


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in REGISTRY:
            raise ValueError(f"there is a query {f.__name__} already")
        REGISTRY[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return add


def queries():
    _register()
    return {name: q for name, (q, _) in REGISTRY.items()}


def _register() -> None:
    """The other modules of queries add theirs when they are imported."""
    from . import catalog_documents, catalog_evidence, catalog_hints, catalog_layout, catalog_linking, catalog_questions, catalog_statements, catalog_stores, catalog_streaming  # noqa: F401


def oracle_sql():
    _register()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def exact_sum(c: str) -> Column:
    return F.sum(money(c)).cast("double")


def facts(t) -> DataFrame:
    """(ticker, fiscal_year, revenue, cost, assets): one row a company and year."""
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, money("o_totalprice"))).cast("double")
    return t("orders").groupBy(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("fiscal_year")).agg(exact_sum("o_totalprice").alias("revenue"), part("F").alias("cost"), part("O").alias("assets"))


FACTS = """(SELECT o_custkey AS ticker, CAST(year(o_orderdate) AS INT) AS fiscal_year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
 CAST(sum(CASE WHEN o_orderstatus='F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS cost,
 CAST(sum(CASE WHEN o_orderstatus='O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS assets FROM orders GROUP BY 1, 2)"""


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND c_nationkey IN (1,2,3)")
def flt_select_rows(t):
    return R.select_rows(t("customer"), c_mktsegment=["BUILDING", "MACHINERY"], c_nationkey=[1, 2, 3]).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def prj_select_columns(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS net, sha256('NET|l_discount|l_extendedprice') AS net_lineage FROM lineitem")
def prj_derived(t):
    net = (money("l_extendedprice") * (1 - money("l_discount"))).cast("double")
    return R.add_derived(t("lineitem"), "net", net, ["l_extendedprice", "l_discount"], "NET").select("l_orderkey", "l_linenumber", "net", "net_lineage")


@query("SELECT sha256(CAST(event_id AS VARCHAR)) AS placeholder, event_type FROM events")
def prj_mask(t):
    return t("events").select(F.sha2(F.col("event_id").cast("string"), 256).alias("placeholder"), "event_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) IN (1996, 1997)")
def flt_metadata(t):
    return t("orders").filter((F.col("o_orderpriority") == "1-URGENT") & F.year("o_orderdate").isin(1996, 1997)).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1)")
def flt_exact_one(t):
    return R.exactly_one(t("lineitem"), "l_orderkey").select("l_orderkey", "l_partkey")


@query("SELECT o_custkey FROM orders WHERE year(o_orderdate) IN (1996,1997,1998) GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) = 3")
def flt_complete_entities(t):
    return R.complete_entities(t("orders").withColumn("y", F.year("o_orderdate")), "o_custkey", "y", [1996, 1997, 1998])


@query("SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'MISSING_METRIC' WHEN year(o_orderdate) < 1996 THEN 'OUT_OF_COVERAGE' WHEN o_orderstatus = 'P' THEN 'MISSING_SCOPE' ELSE 'OK' END AS status FROM orders")
def flt_gate(t):
    status = F.when(F.col("o_totalprice").isNull(), "MISSING_METRIC").when(F.year("o_orderdate") < 1996, "OUT_OF_COVERAGE").when(F.col("o_orderstatus") == "P", "MISSING_SCOPE").otherwise("OK")
    return t("orders").select("o_orderkey", status.alias("status"))


@query("SELECT coalesce(l_partkey, p_partkey) AS k, l_orderkey, l_linenumber, p_size FROM lineitem FULL OUTER JOIN part ON l_partkey = p_partkey")
def jn_full_outer(t):
    a = t("lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber")
    return a.join(t("part").select(F.col("p_partkey").alias("k"), "p_size"), "k", "full_outer")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def jn_candidate_chunk(t):
    return t("lineitem").join(t("orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jn_requirements(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def jn_leakage(t):
    return t("customer").join(t("orders").filter("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(f"SELECT a.ticker, a.fiscal_year, a.revenue, b.revenue AS prior FROM {FACTS} a LEFT JOIN {FACTS} b ON a.ticker = b.ticker AND a.fiscal_year = b.fiscal_year + 1")
def jn_opening(t):
    return R.offset_join(facts(t), "ticker", "fiscal_year", "revenue")


@query("SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND q.ts <= e.ts)) AS last_purchase FROM events e WHERE e.event_type = 'click'")
def jn_asof_unit(t):
    e = t("events")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return R.asof_backward(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("SELECT l_orderkey, l_linenumber, band FROM lineitem JOIN (SELECT * FROM (VALUES ('A',0,10,'low'),('A',10,30,'mid'),('N',0,25,'low'),('R',5,51,'all')) v(f,lo,hi,band)) s ON l_returnflag = f AND l_quantity >= lo AND l_quantity < hi")
def jn_header_contain(t):
    lines = t("lineitem")
    spans = lines.sparkSession.createDataFrame([("A", 0, 10, "low"), ("A", 10, 30, "mid"), ("N", 0, 25, "low"), ("R", 5, 51, "all")], "l_returnflag string, lo int, hi int, band string")
    # four fixed rows; else all lines of a flag, of which there are three, are sorted in one task
    return R.range_join(lines, F.broadcast(spans), "l_returnflag", "l_quantity", "lo", "hi").select("l_orderkey", "l_linenumber", "band")


@query("SELECT r_name, m, y FROM region CROSS JOIN (VALUES ('ROE'),('ROA')) a(m) CROSS JOIN (VALUES (2022),(2023)) b(y)")
def jn_cross(t):
    r = t("region")
    m, y = r.sparkSession.createDataFrame([("ROE",), ("ROA",)], "m string"), r.sparkSession.createDataFrame([(2022,), (2023,)], "y int")
    return r.select("r_name").crossJoin(m).crossJoin(y)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey IS NULL) AS missing, count(*) FILTER (WHERE abs(s - o_totalprice) > 1) AS mismatched FROM (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1) LEFT JOIN orders ON l_orderkey = o_orderkey")
def jn_parity(t):
    s = t("lineitem").groupBy("l_orderkey").agg(exact_sum("l_extendedprice").alias("s"))
    j = s.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("missing"), F.count_if(F.abs(F.col("s") - F.col("o_totalprice")) > 1).alias("mismatched"))


@query("SELECT d.doc_id, b.item_id FROM documents d LEFT JOIN benchmark b ON sha256(coalesce(d.text,'')) = sha256(b.text)")
def jn_content_reuse(t):
    d = t("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return d.join(t("benchmark").select("item_id", F.sha2("text", 256).alias("h")), "h", "left").select("doc_id", "item_id")


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, count(*) AS n FROM lineitem GROUP BY 1")
def agg_group(t):
    return t("lineitem").groupBy("l_returnflag").agg(exact_sum("l_quantity").alias("sum_qty"), F.min("l_quantity").alias("min_qty"), F.max("l_quantity").alias("max_qty"), F.count("*").alias("n"))


@query("SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def agg_dup_resolve(t):
    return R.resolve_duplicates(t("lineitem"), ["l_orderkey"], "l_returnflag", F.col("l_linenumber")).select("l_orderkey", "l_linenumber")


@query("WITH n AS (SELECT c_nationkey, avg(CASE WHEN c_acctbal < 2000 THEN 1.0 ELSE 0.0 END) > 0.5 AS flipped FROM customer WHERE c_acctbal <> 2000 GROUP BY 1) SELECT c_custkey, CASE WHEN flipped THEN 2000 - c_acctbal ELSE c_acctbal - 2000 END AS cost FROM customer JOIN n USING (c_nationkey)")
def agg_sign_convention(t):
    c = t("customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") - 2000).alias("v"))
    return R.majority_positive(c, "c_nationkey", "v").select("c_custkey", F.col("v").alias("cost"))


@query("WITH c AS (SELECT l_suppkey, l_linestatus, count(*) n FROM lineitem GROUP BY 1,2), p AS (SELECT l_suppkey, sum(n) total, max(n) top, max_by(l_linestatus, (n, l_linestatus)) mode, count(*) kinds FROM c GROUP BY 1) SELECT l_suppkey, CASE WHEN kinds = 1 OR (total >= 20 AND top >= 0.6*total) THEN mode ELSE 'MIXED' END AS consensus, CAST(total AS BIGINT) AS total FROM p")
def agg_consensus(t):
    return R.consensus(t("lineitem"), "l_suppkey", "l_linestatus", share=0.6)


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n FROM events GROUP BY 1")
def agg_profile(t):
    return t("events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 4) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def agg_distribution(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 4).alias("mean"), *[R.nearest_rank("value", p).alias(a) for p, a in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


@query("WITH a AS (SELECT lang, count(*)::DOUBLE n, count(*) FILTER (WHERE quality = 1)::DOUBLE k FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT lang, round((k/n + 1.96*1.96/(2*n) - 1.96*sqrt((k/n*(1-k/n) + 1.96*1.96/(4*n))/n))/(1+1.96*1.96/n), 4) AS low, round((k/n + 1.96*1.96/(2*n) + 1.96*sqrt((k/n*(1-k/n) + 1.96*1.96/(4*n))/n))/(1+1.96*1.96/n), 4) AS high FROM a")
def agg_wilson(t):
    a = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").cast("double").alias("n"))
    low, high = R.wilson(F.col("k"), F.col("n"))
    return a.select("lang", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_breakdown(t):
    o = t("orders")
    return o.groupingSets([[o["o_orderstatus"]], [o["o_orderpriority"]], []], o["o_orderstatus"], o["o_orderpriority"]).agg(F.count("*").alias("n"))


@query(f"""SELECT ticker, CASE WHEN count(*) < 3 THEN NULL WHEN min(x) = max(x) THEN 0.0 ELSE round((CAST(count(*) AS DOUBLE) * CAST(sum(x*y) AS DOUBLE) - CAST(sum(x) AS DOUBLE) * CAST(sum(y) AS DOUBLE))
 / (CAST(count(*) AS DOUBLE) * CAST(sum(x*x) AS DOUBLE) - CAST(sum(x) AS DOUBLE) * CAST(sum(x) AS DOUBLE)), 4) END AS slope FROM (SELECT ticker, CAST(fiscal_year - 2000 AS DECIMAL(12,0)) x, CAST(revenue AS DECIMAL(18,2)) y FROM {FACTS}) GROUP BY 1""")
def agg_slope(t):
    return facts(t).groupBy("ticker").agg(F.round(R.slope("revenue", "fiscal_year"), 4).alias("slope"))


@query("SELECT event_type, le, n FROM (SELECT event_type, unnest(['10','50','100','+Inf']) AS le, unnest([count(*) FILTER (WHERE value <= 10), count(*) FILTER (WHERE value <= 50), count(*) FILTER (WHERE value <= 100), count(value)]) AS n FROM events GROUP BY 1)")
def agg_histogram(t):
    return R.histogram(t("events"), ["event_type"], "value", [10, 50, 100])


@query("SELECT o_orderpriority, CASE WHEN count(p) = count(*) THEN round(sum(p * o_totalprice), 2) END AS cost FROM orders LEFT JOIN (VALUES ('1-URGENT', 2), ('2-HIGH', 1)) v(m, p) ON m = o_orderpriority GROUP BY 1")
def agg_cost(t):
    o = t("orders")
    prices = F.broadcast(o.sparkSession.createDataFrame([("1-URGENT", 2), ("2-HIGH", 1)], "o_orderpriority string, p int"))  # a price list of two rows
    cost = F.round(F.sum(F.col("p") * money("o_totalprice")).cast("double"), 2)
    return o.join(prices, "o_orderpriority", "left").groupBy("o_orderpriority").agg(F.when(F.count("p") == F.count("*"), cost).alias("cost"))


@query("SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def agg_uniqueness(t):
    return t("documents").filter("text is not null").groupBy("text").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT n_regionkey, sha256(string_agg(n_name, '|' ORDER BY n_name)) AS fingerprint FROM nation GROUP BY 1")
def agg_fingerprint(t):
    return t("nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), "|"), 256).alias("fingerprint"))


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def win_rank(t):
    return R.rank_rows(t("customer"), ["c_nationkey"], F.desc("c_acctbal"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "rank")


@query(f"SELECT a.ticker, a.fiscal_year, round((a.revenue - b.revenue) / nullif(b.revenue, 0) * 100, 4) AS growth FROM {FACTS} a LEFT JOIN {FACTS} b ON a.ticker = b.ticker AND a.fiscal_year = b.fiscal_year + 1")
def win_growth(t):
    j = R.offset_join(facts(t), "ticker", "fiscal_year", "revenue")
    return j.select("ticker", "fiscal_year", F.round(R.growth(F.col("revenue"), F.col("prior")), 4).alias("growth"))


@query("WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_type END AS layout FROM events) SELECT event_id, coalesce(layout, last_value(layout IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS layout_carried FROM e")
def win_carry_layout(t):
    e = t("events").withColumn("layout", F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    return R.carry_forward(e, "user_id", ["ts", "event_id"], "layout").select("event_id", "layout_carried")


@query("SELECT conv_id, turn FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before = 'user' AND role = 'assistant'")
def win_escalation(t):
    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    return t("conversations").withColumn("before", before).filter("before = 'user' and role = 'assistant'").select("conv_id", "turn")


@query("WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, count(*) AS n, count(*) FILTER (WHERE value > 50) AS bad FROM events GROUP BY 1, 2), c AS (SELECT user_id, s, sum(n) OVER o AS total, sum(bad) OVER o AS bad FROM e WINDOW o AS (PARTITION BY user_id ORDER BY s)), i AS (SELECT user_id, s, total - first_value(total) OVER l AS tl, bad - first_value(bad) OVER l AS bl, total - first_value(total) OVER h AS th, bad - first_value(bad) OVER h AS bh FROM c WINDOW l AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), h AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 14400 PRECEDING AND CURRENT ROW)) SELECT user_id, s, coalesce(tl > 0 AND bl / tl > 0.5 AND th > 0 AND bh / th > 0.5, false) AS burning FROM i")
def win_increase(t):
    e = t("events").groupBy("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("b"))
    w = W.partitionBy("user_id").orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    c = e.select("user_id", "s", F.sum("n").over(w).alias("total"), F.sum("b").over(w).alias("bad"))
    over = lambda seconds: F.try_divide(R.counter_increase(c, "user_id", "s", "bad", seconds), R.counter_increase(c, "user_id", "s", "total", seconds)) > 0.5
    return c.select("user_id", "s", F.coalesce(over(86400) & over(14400), F.lit(False)).alias("burning"))


@query("WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, max(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT *, v > 50 AS bad, CASE WHEN v > 50 AND NOT coalesce(lag(v > 50) OVER o, false) THEN 1 ELSE 0 END AS st FROM e WINDOW o AS (PARTITION BY user_id ORDER BY s)), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY s) AS run FROM m), b AS (SELECT *, min(s) OVER (PARTITION BY user_id, run) AS begin FROM r WHERE bad) SELECT user_id, min(s) AS first, max(s) AS last, count(*) AS length, min(CASE WHEN s - begin >= 7200 THEN s END) AS fired_at FROM b GROUP BY user_id, run")
def win_for_duration(t):
    e = t("events").groupBy("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).agg(F.max("value").alias("v"))
    return R.alert_runs(e, "user_id", "s", F.col("v") > 50, for_s=7200)


@query("SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumsum, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS rk, l_quantity - lag(l_quantity) OVER o AS diff, round(avg(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS 2 PRECEDING), 6) AS rolling FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
def win_pandas(t):
    o = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.sum(money("l_quantity")).over(o.rowsBetween(W.unboundedPreceding, 0)).cast("double").alias("cumsum"), F.rank().over(W.partitionBy("l_orderkey").orderBy("l_quantity")).alias("rk"),
        (F.col("l_quantity") - F.lag("l_quantity").over(o)).alias("diff"), F.round(F.avg("l_quantity").over(o.rowsBetween(-2, 0)), 6).alias("rolling"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY CAST(o_totalprice AS VARCHAR) DESC, o_orderkey DESC")
def srt_sort(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc(F.col("o_totalprice").cast("string")), F.desc("o_orderkey"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_n(t):
    return t("part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(CAST(c_custkey AS VARCHAR))) AS r FROM customer) WHERE r <= 5")
def smp_stratified(t):
    return R.top_n(t("customer"), ["c_mktsegment"], 5, F.sha2(F.col("c_custkey").cast("string"), 256)).select("c_mktsegment", "c_custkey")


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) ORDER BY r, c_nationkey LIMIT 60")
def smp_roundrobin(t):
    return R.round_robin(t("customer"), "c_nationkey", 60, F.col("c_custkey")).select("c_nationkey", "c_custkey")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).unionByName(t("supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).unionByName(t("supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def set_intersect(t):
    return t("orders").select(F.col("o_custkey").alias("k")).intersect(t("events").select(F.col("user_id").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders")
def set_except(t):
    return t("customer").select(F.col("c_custkey").alias("k")).exceptAll(t("orders").select(F.col("o_custkey").alias("k")))


@query("SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}\\p{M}\\p{N}\\p{Co}_]+)')) AS n_tokens FROM documents")
def str_tokenize(t):
    return t("documents").select("doc_id", F.size(T.tokens(F.coalesce("text", F.lit("")))).alias("n_tokens"))


@query("SELECT item_id, trim(regexp_replace(lower(replace(strip_accents(text), 'ß', 'ss')), '\\s+', ' ', 'g')) AS folded FROM benchmark")
def str_fold(t):
    return t("benchmark").select("item_id", S.fold(F.col("text")).alias("folded"))


@query("""SELECT p_partkey, form, CASE form WHEN 'dash' THEN 'MISSING' WHEN 'anglo' THEN 'AMBIGUOUS' WHEN 'word' THEN 'NOT_NUMERIC' WHEN 'open' THEN 'MALFORMED' ELSE 'PARSED' END AS status,
 CASE form WHEN 'paren' THEN -p_retailprice WHEN 'grouped' THEN p_retailprice WHEN 'plus' THEN CAST(p_size AS DOUBLE) WHEN 'percent' THEN CAST(p_size AS DOUBLE) END AS value, form = 'percent' AS percent
 FROM part CROSS JOIN (VALUES ('dash'),('anglo'),('word'),('open'),('paren'),('grouped'),('plus'),('percent')) v(form)""")
def str_numeric_parse(t):
    printed, size = F.translate(F.format_number("p_retailprice", 2), ",.", ".,"), F.col("p_size").cast("string")
    forms = {"dash": F.lit(" – "), "anglo": F.lit("1,234,567"), "word": F.concat(F.lit("a"), size), "open": F.concat(F.lit("("), size), "paren": F.concat(F.lit("("), printed, F.lit(")")), "grouped": printed, "plus": F.concat(F.lit("+"), size), "percent": F.concat(size, F.lit(" %"))}
    rows = t("part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("raw")) for k, v in forms.items()])).alias("f")).select("p_partkey", "f.*")
    status, value, percent = S.parse_number(F.col("raw"))
    return rows.select("p_partkey", "form", status.alias("status"), value.cast("double").alias("value"), percent.alias("percent"))


@query("SELECT o_custkey, list_sort(list(DISTINCT CAST(year(o_orderdate) AS INT)))::VARCHAR AS years FROM orders GROUP BY 1")
def dt_report_years(t):
    period = F.concat(F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("-Q"), F.quarter("o_orderdate"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("-"), F.month("o_orderdate"), F.lit("M"))).otherwise(F.lit("")))
    listed = t("orders").groupBy("o_custkey").agg(F.collect_list(period).alias("p"))
    return listed.select("o_custkey", F.concat(F.lit("["), F.array_join(P.report_years(F.col("p")), ", "), F.lit("]")).alias("years"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(28,6)) / 1000 AS DOUBLE) AS thousands FROM orders")
def mth_scale(t):
    return t("orders").select("o_orderkey", S.to_scale(F.col("o_totalprice"), "RAW", "THOUSAND").cast("double").alias("thousands"))


@query("SELECT 'f_' || substr(sha256(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 20) AS fact_id FROM lineitem")
def fact_ids(t):
    return t("lineitem").select(S.fact_id(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("fact_id"))


BM25_SQL = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text,'')), '([\\p{L}\\p{M}\\p{N}\\p{Co}_]+)') AS ts FROM documents),
s AS (SELECT count(*) n, avg(len(ts)) mean FROM d), p AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS token FROM d),
q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'that'), (2, 'und'), (2, 'die'), (3, 'les')) v(query_id, token)),
tf AS (SELECT query_id, token, doc_id, length, count(*) AS tf FROM p JOIN q USING (token) GROUP BY ALL), df AS (SELECT query_id, token, count(*) AS df FROM tf GROUP BY ALL),
need AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1),
sc AS (SELECT query_id, doc_id, count(*) AS got, sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*length/mean))) AS score FROM tf JOIN df USING (query_id, token), s GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc JOIN need USING (query_id) WHERE got = need QUALIFY rank <= 20"""


@query(BM25_SQL)
def ret_bm25(t):
    docs = t("documents")
    asked = docs.sparkSession.createDataFrame([(1, "the that"), (2, "Und die"), (3, "les")], "query_id int, text string")
    return T.search_index(scratch.index_of(docs), asked, 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(BM25_SQL.replace("SELECT doc_id, regexp", "SELECT doc_id, lang, regexp").replace("SELECT doc_id, len(ts)", "SELECT doc_id, lang, len(ts)").replace(
    "(VALUES (1, 'the'), (1, 'that'), (2, 'und'), (2, 'die'), (3, 'les')) v(query_id, token)", "(VALUES (1, 1, 'the'), (1, 1, 'that'), (1, 2, 'of'), (2, 3, 'und')) v(query_id, t, token)"
).replace("SELECT query_id, token, doc_id, length, count(*) AS tf FROM p JOIN q USING (token)", "SELECT query_id, t, token, doc_id, lang, length, count(*) AS tf FROM p JOIN q USING (token)").replace(
    "SELECT query_id, token, count(*) AS df FROM tf", "SELECT query_id, t, token, count(*) AS df FROM tf").replace("SELECT query_id, count(*) AS need FROM q GROUP BY 1", "SELECT query_id, t, count(*) AS need FROM q GROUP BY ALL").replace(
    "SELECT query_id, doc_id, count(*) AS got", "SELECT query_id, t, doc_id, lang, count(*) AS got").replace("JOIN df USING (query_id, token), s", "JOIN df USING (query_id, t, token), s").replace(
    "FROM sc JOIN need USING (query_id) WHERE got = need", "FROM (SELECT query_id, doc_id, max(score) AS score FROM sc JOIN need USING (query_id, t) WHERE got = need AND lang = 'en' GROUP BY ALL)"))
def ret_bm25_where(t):
    """Two texts of one query, of which a document keeps the better score, over English documents; the statistics are of all."""
    docs = t("documents")
    asked = docs.sparkSession.createDataFrame([(1, "the that"), (1, "of"), (2, "und")], "query_id int, text string")
    found = T.search_index(scratch.index_of(docs, ("lang",)), asked, 20, where=F.col("lang") == "en")
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0) WHERE rank <= 10")
def ret_vector(t):
    e = t("embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return T.vector_search(e, asked, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


RRF_LISTS = "(SELECT c_custkey AS doc_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer QUALIFY r <= 100) a FULL OUTER JOIN (SELECT c_custkey AS doc_id, row_number() OVER (ORDER BY c_name, c_custkey) AS q FROM customer QUALIFY q <= 100) b USING (doc_id)"


@query(f"SELECT doc_id, round(score, 8) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, coalesce(1.0/(60+r), 0) + coalesce(1.0/(60+q), 0) AS score FROM {RRF_LISTS}) QUALIFY rank <= 150")
def ret_rrf(t):
    c = t("customer").select(F.lit(1).alias("query_id"), F.col("c_custkey").alias("doc_id"), "c_acctbal", "c_name")
    top = lambda *o: R.top_n(c, ["query_id"], 100, *o)
    return T.fused([top(F.desc("c_acctbal"), F.col("doc_id")), top(F.col("c_name"), F.col("doc_id"))], 150).select("doc_id", F.round("score", 8).alias("score"), "rank")


@query("WITH r AS (SELECT o_custkey AS q, o_orderkey AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), w AS (SELECT o_custkey AS q, o_orderkey AS d FROM orders WHERE o_orderstatus = 'F') SELECT w.q AS query_id, round(count(r.rank) / count(*), 6) AS recall, round(1.0 / min(r.rank), 6) AS rr FROM w LEFT JOIN (SELECT * FROM r WHERE rank <= 3) r ON w.q = r.q AND w.d = r.d GROUP BY 1")
def agg_recall_mrr(t):
    o = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), "o_totalprice", "o_orderstatus")
    ranked = R.rank_rows(o, ["query_id"], F.desc("o_totalprice"), F.col("doc_id"))
    out = T.recall_and_mrr(ranked, o.filter("o_orderstatus = 'F'"), 3)
    return out.select("query_id", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"))


@query("SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus='O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM orders GROUP BY 1")
def udf_pivot(t):
    return t("orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1))).select("o_custkey", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("SELECT p_partkey, 'size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def udf_melt(t):
    p = t("part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "variable", "value")


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(quantile_cont(l_quantity, 0.25), 4) AS q25 FROM lineitem GROUP BY 1")
def udf_describe(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.percentile("l_quantity", 0.25), 4).alias("q25"))


@query("SELECT o_orderkey, round(100 * (o_totalprice - lag(o_totalprice) OVER w) / nullif(lag(o_totalprice) OVER w, 0), 6) AS pct_change, round(ln(o_totalprice), 6) AS log FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def udf_pct_change(t):
    return R.pct_change(t("orders"), "o_custkey", "o_totalprice", "o_orderdate", "o_orderkey").select("o_orderkey", F.round(100 * F.col("pct_change"), 6).alias("pct_change"), F.round(F.log("o_totalprice"), 6).alias("log"))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events WHERE value IS NOT NULL AND user_id % 3 <> 0")
def udf_dropna(t):
    """to_numeric of texts, and rows without a null."""
    e = t("events").withColumn("kept", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
    return e.dropna(subset=["value", "kept"]).select("event_id", F.regexp_extract("props", "[0-9]+", 0).try_cast("double").alias("k"))


@query("""SELECT c, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75, max(v) AS max
FROM (SELECT 'quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem) GROUP BY c""")
def udf_describe_all(t):
    return R.describe(t("lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")))


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stm_windows(t):
    return telemetry.windowed_counts(t("events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER o >= INTERVAL '30 minutes' OR lag(ts) OVER o IS NULL THEN 1 ELSE 0 END AS st FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def stm_sessions(t):
    return telemetry.sessions(t("events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
