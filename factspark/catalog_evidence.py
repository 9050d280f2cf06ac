"""Queries over evidence, binding, refusal gates and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .catalog_statements import per_customer, per_customer_sql
from .operators import evidence as E
from .operators import relational as R

SPANS = [("q", "a", 0, 4), ("q", "b", 2, 9), ("q", "c", 9, 12), ("q", "d", 10, 12), ("q", "e", 20, 21), ("r", "x", 0, 3), ("r", "y", 2, 5)]


@query(per_customer_sql([("q", "b"), ("q", "c"), ("q", "e"), ("r", "x")], "k, name", "k"))
def jn_overlap_anti(t):
    return E.longest_matches(per_customer(t, SPANS, "k string, name string, start int, stop int", "k"), "k").select("k", "name")


@query("SELECT l_orderkey, CASE WHEN count(o_orderkey) = 0 THEN 'UNBOUND' WHEN count(*) > 1 THEN 'NOT_UNIQUE' ELSE 'OK' END AS status FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_custkey % 3 <> 0) ON l_orderkey = o_orderkey GROUP BY 1")
def jn_bind(t):
    holders = t("lineitem").select(F.col("l_orderkey").alias("placeholder"))
    found = t("orders").filter("o_custkey % 3 <> 0").select(F.col("o_orderkey").alias("placeholder"), F.col("o_totalprice").alias("value"))
    return E.bind(holders, found, "placeholder").select(F.col("placeholder").alias("l_orderkey"), "status")


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS cited, bool_or(role = 'assistant' AND turn <= 2) AS covered FROM conversations GROUP BY 1")
def jn_gold_run(t):
    c = t("conversations")
    gold = c.groupBy("conv_id").agg(F.array(F.array(F.lit(1), F.lit(2), F.lit(0))).alias("groups"))
    runs = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.collect_list(F.col("turn").cast("int")).alias("cells"))
    return E.gold_against_run(gold, runs, "conv_id").select("conv_id", F.coalesce(F.size("cells"), F.lit(0)).cast("long").alias("cited"), "covered")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def jn_unit_decl(t):
    texts = t("orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "don vi tinh: trieu dong").otherwise("loi mo dau").alias("text"))
    linked = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return E.unlinked_declarations(texts, linked, "o_orderkey", "text").select("o_orderkey")


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ' ') || ' ' || CAST(o_custkey AS VARCHAR) AS text FROM orders GROUP BY 1")
def ret_query_build(t):
    asked = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("metrics"))
    return asked.select("o_custkey", E.query_text(F.col("metrics"), F.array(F.col("o_custkey").cast("string"), F.lit(None).cast("string"), F.element_at("metrics", 1))).alias("text"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'BM25' WHEN event_id % 3 = 0 THEN 'FUSION' WHEN event_id % 5 = 0 THEN 'RERANK' END AS stage FROM events")
def ret_failure_stage(t):
    e = t("events")
    stages = [("BM25", F.col("event_type") != "click"), ("FUSION", F.col("event_id") % 3 != 0), ("RERANK", F.col("event_id") % 5 != 0)]
    return e.select("event_id", E.first_failure(stages).alias("stage"))


@query("SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY q.vec_id, e.vec_id // 4 ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS own FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.label = q.label WHERE list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.05) WHERE own = 1) WHERE rank <= 3")
def ret_memory(t):
    e = t("embeddings").withColumn("signature", F.floor(F.col("vec_id") / 4)).withColumnRenamed("label", "context")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "context", F.col("embedding").alias("q"))
    return E.remembered(e, asked, 0.05, 3).select("query_id", "vec_id", "rank")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'COMPANY_MISSING' WHEN o_custkey % 7 = 1 THEN 'COMPANY_AMBIGUOUS' WHEN o_orderstatus = 'P' THEN 'PERIOD_MISSING' WHEN o_orderpriority = '5-LOW' THEN 'METRIC_AMBIGUOUS' ELSE 'READY' END AS gate FROM orders")
def flt_planning_gate(t):
    companies = F.when(F.col("o_custkey") % 7 == 0, 0).when(F.col("o_custkey") % 7 == 1, 2).otherwise(1)
    return t("orders").select("o_orderkey", E.planning_gate(companies, F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), F.when(F.col("o_orderpriority") == "5-LOW", 3).otherwise(1)).alias("gate"))


@query("SELECT event_type, count(*) AS row_count, count(*) > 500 AS truncated FROM events GROUP BY 1")
def prj_describe(t):
    return E.described(t("events"), ["event_type"])


@query("SELECT conv_id, turn, placeholder FROM (SELECT conv_id, turn, 'val_' || substr(sha256(CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)), 1, 12) AS placeholder FROM conversations WHERE role = 'user')")
def jn_mask_chain(t):
    c = t("conversations")
    wanted = c.filter("role = 'user'").select("conv_id", "turn")
    return E.masked(wanted, c.select("conv_id", "turn", F.length("text").alias("value")), ["conv_id", "turn"]).select("conv_id", "turn", "placeholder")


@query("SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def src_corpusindex(t):
    return t("lineitem").select("l_orderkey").distinct().join(t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")).distinct(), "l_orderkey", "left_semi")


@query("SELECT n_nationkey, n_name FROM nation")
def src_payload(t):
    n = t("nation")
    data = n.orderBy("n_nationkey").select("n_nationkey", "n_name").limit(500).collect()  # a payload has 500 rows at most
    payload = {"columns": ["n_nationkey", "n_name"], "dtypes": ["int64", "object"], "data": [[r[0] for r in data], [r[1] for r in data]]}
    return E.from_payload(n.sparkSession, payload).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT vec_id, rank FROM (SELECT vec_id, row_number() OVER (ORDER BY round(embedding[1]::DOUBLE, 9) DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 10")
def top_shard(t):
    e = t("embeddings").withColumn("one", F.lit(1)).withColumn("x", F.round(F.col("embedding")[0].cast("double"), 9))
    return R.top_n(e, ["one"], 10, F.desc("x"), F.col("vec_id")).select("vec_id", "rank")
