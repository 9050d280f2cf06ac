"""Queries over printed statements: header paths, roles of columns, lines, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query
from .functions import scalar as S
from .operators import documents as D
from .operators import layout as Y
from .sources.scratch import stored

#: Heads of statements() by the customer's number: named periods, a span over years, code column first, none (a page that goes on).
HEADS = [
    "<tr><th>Chỉ tiêu</th><th>Mã số</th><th>Thuyết minh</th><th>Năm nay</th><th>Năm trước</th></tr>",
    "<tr><td rowspan=2>Chỉ tiêu</td><td rowspan=2>Mã số</td><td rowspan=2>Thuyết minh</td><td colspan=2>Số liệu</td></tr><tr><td>2024</td><td>2023</td></tr>",
    "<tr><th>Mã số</th><th>Chỉ tiêu</th><th>Note</th><th>2023</th><th>2024</th></tr>",
    "<tr><td></td><td></td><td></td><td></td><td></td></tr>",
]


def _printed(c: str):
    money = F.translate(F.format_number(F.abs(c), 2), ",.", ".,")
    return F.when(F.col(c) < 0, F.concat(F.lit("("), money, F.lit(")"))).otherwise(money)


def statements(t) -> DataFrame:
    """A report a customer: a page with one table, a line an order with its price and its price a year before; every fourth customer has a second page that goes on without a head."""
    o = t("orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("current"), (F.col("o_totalprice") - 200_000).alias("prior"), F.concat(F.lit("Đơn hàng "), "o_orderpriority", F.lit(" "), F.col("o_orderkey")).alias("label"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    label, code, note, now, then = (cell(c) for c in (F.col("label"), F.lpad((F.col("o_orderkey") % 90 + 10).cast("string"), 2, "0"), F.concat(F.lit("V."), F.col("o_orderkey") % 7), _printed("current"), _printed("prior")))
    kind = F.col("o_custkey") % 3
    row = F.when(kind == 2, F.concat(F.lit("<tr>"), code, label, note, then, now, F.lit("</tr>"))).otherwise(F.concat(F.lit("<tr>"), label, code, note, now, then, F.lit("</tr>")))
    more = (F.col("o_custkey") % 4 == 0) & (F.col("o_orderkey") % 2 == 0)  # on the second page
    rows = o.withColumn("page", F.when(more, 1).otherwise(0)).groupBy("o_custkey", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    head = F.when(F.col("page") == 1, F.lit(HEADS[3])).otherwise(F.element_at(F.array(*map(F.lit, HEADS[:3])), (kind + 1).cast("int")))
    page = F.concat(F.lit("===== PAGE "), F.col("page") + 1, F.lit(" =====\nBáo cáo\n<table>"), head, F.col("rows"), F.lit("</table>\n"))
    pages = rows.select("o_custkey", F.struct("page", page.alias("text")).alias("p")).groupBy(F.col("o_custkey").cast("string").alias("report_id"))
    return pages.agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]), "").alias("raw_text"))


def statement_cells(t) -> DataFrame:
    """Written once, since the queries read cells several times, and as it is then no estimate of the parser's rows is needed."""
    return stored(Y.figures(D.spans(D.pages(statements(t)))), "cells")


WHO = "(SELECT *, o_custkey % 3 AS kind, o_custkey % 4 = 0 AND o_orderkey % 2 = 0 AS more FROM orders)"
PAGES = f"(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY more) - 1 AS page_index, bool_or(NOT more) OVER (PARTITION BY o_custkey) AS headed FROM (SELECT DISTINCT o_custkey, kind, more FROM {WHO}))"


@query(f"""SELECT CAST(o_custkey AS VARCHAR) AS report_id, CAST(page_index AS INT) AS page_index, 3 + i AS "column",
  CASE kind WHEN 0 THEN ['Năm nay', 'Năm trước'][1 + i] WHEN 1 THEN ['Số liệu > 2024', 'Số liệu > 2023'][1 + i] ELSE ['2023', '2024'][1 + i] END AS path
  FROM {PAGES} CROSS JOIN (VALUES (0), (1)) v(i) WHERE NOT more""")
def doc_header_paths(t):
    paths = Y.column_paths(statement_cells(t))
    return paths.select("report_id", "page_index", "column", F.array_join("path", " > ").alias("path"))


@query(f"""SELECT CAST(o_custkey AS VARCHAR) AS report_id, CAST(page_index AS INT) AS page_index, CASE WHEN kind = 2 THEN 0 ELSE 1 END AS code, CASE WHEN NOT more THEN 2 END AS note,
  CASE WHEN more AND NOT headed THEN NULL WHEN kind = 2 THEN 4 ELSE 3 END AS "current", CASE WHEN more AND NOT headed THEN NULL WHEN kind = 2 THEN 3 ELSE 4 END AS prior,
  CASE WHEN NOT more THEN 'HEADER' WHEN headed THEN 'INHERITED' ELSE 'NO_CURRENT_COLUMN' END AS basis FROM {PAGES} WHERE NOT (more AND NOT headed)""")
def doc_layout(t):
    found = Y.layouts(statement_cells(t), F.lit(2024))
    return found.filter("basis <> 'NO_CURRENT_COLUMN'").select("report_id", "page_index", "code", "note", "current", "prior", "basis")


@query(f"SELECT o_orderkey, 'Đơn hàng ' || o_orderpriority || ' ' || o_orderkey AS label, CAST(o_orderkey % 90 + 10 AS VARCHAR) AS code, round(o_totalprice, 2) AS \"current\", round(o_totalprice - 200000, 2) AS prior FROM {WHO} w WHERE NOT more OR EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = w.o_custkey AND b.o_orderkey % 2 = 1)")
def doc_statement_lines(t):
    c = statement_cells(t)
    number = lambda x: S.parse_number(F.col(x))[1].cast("double")
    lines = Y.lines(c, Y.layouts(c, F.lit(2024)))
    label = F.regexp_replace("label", r" V\.\d$", "")  # a page without a head has no note column
    return lines.select(F.regexp_extract("label", r" (\d+)(?: V\.\d)?$", 1).cast("long").alias("o_orderkey"), label.alias("label"), "code", number("current").alias("current"), number("prior").alias("prior"))


@query(f"""WITH RECURSIVE r AS (SELECT CAST(o_custkey AS VARCHAR) AS report_id, CAST(page_index AS INT) AS page_index, o_orderkey, row_number() OVER (PARTITION BY o_custkey, page_index ORDER BY o_orderkey) AS i,
  7 + len(string_split(o_orderpriority, ' ')) AS n, 40 - CASE WHEN more THEN 0 ELSE [10, 10, 7][1 + kind] END AS room FROM {WHO} w JOIN {PAGES} p USING (o_custkey, kind, more)),
packed AS (SELECT report_id, page_index, i, o_orderkey, 0 AS chunk, n AS load FROM r WHERE i = 1 UNION ALL
  SELECT r.report_id, r.page_index, r.i, r.o_orderkey, CASE WHEN p.load + r.n > room THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.load + r.n > room THEN r.n ELSE p.load + r.n END
  FROM packed p JOIN r ON r.report_id = p.report_id AND r.page_index = p.page_index AND r.i = p.i + 1)
SELECT report_id, page_index, o_orderkey, chunk FROM packed""")
def doc_table_chunks(t):
    c = statement_cells(t)
    key = F.max(F.regexp_extract("text", r"^Đơn hàng .* (\d+)$", 1).try_cast("long"))
    rows = c.groupBy(*Y.TABLE, "row").agg(key.alias("o_orderkey"))
    return Y.table_chunks(c, 40).join(rows.filter("o_orderkey IS NOT NULL").hint("merge"), [*Y.TABLE, "row"]).select("report_id", "page_index", "o_orderkey", "chunk")
