"""Queries over declared units and the windows of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query
from .operators import hints as H

#: What stands before a customer's tables: text, the scale it declares, and the places of the declaration in it.
SAID = [("Đơn vị tính: triệu đồng. ", "MILLION", 13, 23), ("ĐVT VND. ", "RAW", 4, 7), ("Đơn vị: VND/cổ phiếu. ", None, None, None), ("Thuyết minh. ", None, None, None), ("đơn vị tính nghìn VND. ", "THOUSAND", 12, 21)]
GAPS = [0, 900, 1_100, 1_300]


def declared_pages(t) -> DataFrame:
    """(o_custkey, text): a page a customer, with a text, a gap and a table for each order."""
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(k, F.lit(len(xs))) + 1).cast("int"))
    part = F.concat(pick([s[0] for s in SAID], F.col("o_orderkey")), F.repeat(F.lit("x"), pick(GAPS, F.floor(F.col("o_orderkey") / 5))), F.lit("<table><tr><td>"), F.col("o_orderkey"), F.lit("</td></tr></table>"))
    rows = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("p")))).alias("l"))  # of one customer
    return rows.select("o_custkey", F.array_join(F.transform("l", lambda x: x["p"]), "").alias("text"))


def _case(i: int) -> str:
    return "[" + ", ".join("NULL" if s[i] is None else f"'{s[i]}'" if isinstance(s[i], str) else str(s[i]) for s in SAID) + "][1 + o_orderkey % 5]"


PARTS = f"""(SELECT *, sum(size) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - size AS begin, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM (
  SELECT o_custkey, o_orderkey, gap, length(said) + gap + 33 + length(o_orderkey::VARCHAR) AS size, length(said) AS n, scale, a, b, said
  FROM (SELECT o_custkey, o_orderkey, {_case(0)} AS said, {_case(1)} AS scale, {_case(2)} AS a, {_case(3)} AS b, [0, 900, 1100, 1300][1 + o_orderkey // 5 % 4] AS gap FROM orders)))"""


@query(f"SELECT o_custkey, CAST(begin + a AS INT) AS first, CAST(begin + b AS INT) AS last, substr(said, a + 1, b - a) AS raw, scale FROM {PARTS} WHERE scale IS NOT NULL")
def str_unit_hints(t):
    return H.unit_hints(declared_pages(t), "text")


@query(f"SELECT o_custkey, CAST(i AS INT) AS table_index, CAST(begin + a AS INT) AS first, scale FROM {PARTS} WHERE scale IS NOT NULL AND n + gap - a <= 1200")
def jn_window_text(t):
    pages = declared_pages(t)
    return H.in_windows(H.table_spans(pages, "text"), H.unit_hints(pages, "text"), ["o_custkey"]).select("o_custkey", "table_index", "first", "scale")
