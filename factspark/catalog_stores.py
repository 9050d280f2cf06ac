"""Queries over stored tables: point lookups, resumed batches, published versions, run reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import query
from .functions import scalar as S
from .operators import linking as L
from .sources import stores
from .sources.scratch import folder

ORDINAL = "(SELECT doc_id, CAST(doc_id % 16 AS INT) AS shard, CAST(row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) - 1 AS INT) AS record, md5(coalesce(text, '')) AS digest FROM documents)"


@query(f"SELECT vec_id, shard, record, digest FROM embeddings JOIN {ORDINAL} ON doc_id = vec_id WHERE vec_id % 50 = 0")
def src_chunk_point(t):
    """Chunks by (shard, record) of the vectors' metadata, of every 50th vector."""
    shard = F.pmod("doc_id", F.lit(16)).cast("int")
    chunks = t("documents").select("doc_id", shard.alias("shard"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    chunks = chunks.withColumn("record", (F.row_number().over(W.partitionBy("shard").orderBy("doc_id")) - 1).cast("int"))
    address = F.concat_ws(":", "shard", "record").alias("address")
    chunk_path, meta_path = folder(t.spark, "chunks"), folder(t.spark, "vector-metadata")
    stores.write_lookup(chunks.select(address, "digest"), "address", chunk_path, 16)
    stores.write_lookup(t("embeddings").select("vec_id").join(chunks, F.col("vec_id") == F.col("doc_id")).select("vec_id", "shard", "record"), "vec_id", meta_path, 16)
    asked = stores.look_up_all(t("embeddings").filter("vec_id % 50 = 0").select("vec_id"), meta_path, "vec_id")
    return stores.look_up_all(asked.withColumn("address", address), chunk_path, "address").drop("address")


@query("SELECT o_orderkey, 'DIRECT' AS association, l_linenumber AS hint, l_returnflag AS said FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 40 = 0 UNION ALL SELECT o_orderkey, 'LINKED', CAST(NULL AS INT), c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 40 = 0")
def src_sidecar(t):
    """Hints of orders, directly by their key and through their link to a customer, from two stored tables."""
    hints, links = folder(t.spark, "hints"), folder(t.spark, "links")
    stores.write_lookup(t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", hints)
    stores.write_lookup(t("customer").select("c_custkey", "c_mktsegment"), "c_custkey", links)
    asked = t("orders").filter("o_orderkey % 40 = 0").select("o_orderkey", "o_custkey")
    direct = stores.look_up_all(asked.select("o_orderkey"), hints, "o_orderkey").select("o_orderkey", F.lit("DIRECT").alias("association"), F.col("l_linenumber").alias("hint"), F.col("l_returnflag").alias("said"))
    linked = stores.look_up_all(asked, links, "o_custkey").select("o_orderkey", F.lit("LINKED").alias("association"), F.lit(None).cast("int").alias("hint"), F.col("c_mktsegment").alias("said"))
    return direct.unionByName(linked)


CLASSES = [("BALANCE_SHEET", "can doi ke toan"), ("INCOME_STATEMENT", "ket qua (hoat dong )?kinh doanh"), ("CASH_FLOW", "luu chuyen tien te")]
TITLES = ["Bảng cân đối kế toán", "Báo cáo kết quả hoạt động kinh doanh", "Lưu chuyển tiền tệ", "Bảng cân đối kế toán và kết quả kinh doanh", "Thuyết minh"]


@query("SELECT o_orderkey, ['BALANCE_SHEET', 'INCOME_STATEMENT', 'CASH_FLOW', NULL, NULL][1 + o_custkey % 5] AS class FROM orders WHERE o_orderkey % 25 = 0")
def src_tableclass(t):
    """Classes of the tables that orders ask for, from a stored table that was classified once by titles."""
    path = folder(t.spark, "table-classes")
    title = F.element_at(F.array(*map(F.lit, TITLES)), F.pmod("o_custkey", F.lit(5)).cast("int") + 1)
    stores.write_lookup(t("orders").select("o_orderkey", L.table_class(title, CLASSES).alias("class")), "o_orderkey", path)
    return stores.look_up_all(t("orders").filter("o_orderkey % 25 = 0").select("o_orderkey"), path, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def snk_resume(t):
    """Orders written in eight batches by a run that fails at the fourth and one that goes on."""
    path, rows = folder(t.spark, "resumed"), t("orders").select("o_orderkey", "o_totalprice")
    try:
        stores.write_batches(rows, "o_orderkey", path, 8, "orders", stop_before=3)
    except RuntimeError:
        done = stores.write_batches(rows, "o_orderkey", path, 8, "orders")
        assert done == {"written": [3, 4, 5, 6, 7], "skipped": [0, 1, 2]}
    return stores.read_batches(t.spark, path).drop("batch")


@query("SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS balance FROM customer")
def snk_atomic(t):
    """A second version of a table, published in place of the first."""
    root = folder(t.spark, "published")
    first = stores.publish({"customer": t("customer").select("c_custkey", F.col("c_acctbal").alias("balance"))}, root)
    changed = stores.read_published(t.spark, root, "customer").withColumn("balance", F.col("balance") + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(1))
    stores.publish({"customer": changed}, root, expected=first)
    return stores.read_published(t.spark, root, "customer")


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 END AS attempt, count(*) AS turns FROM conversations GROUP BY 1")
def snk_runs(t):
    """Conversations answered by a run over a third of them, and one over all that finds the rest."""
    path, talks = folder(t.spark, "runs"), t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    for part in (talks.filter("conv_id % 3 = 0"), talks):
        stores.run_questions(part, "conv_id", lambda left: left, path, {"release": "r1"})
    return stores.read_report(t.spark, path).select("conv_id", "attempt", "turns")
