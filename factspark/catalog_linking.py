"""Queries over links, hints, lines, metric codes and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .catalog_statements import per_customer, per_customer_sql, rows_of, values
from .operators import linking as L

CANDIDATES = [("t", "TABLE", "T1", None, ["c1", "c2", "c1"]), ("p", "TEXT", None, "P1", None), ("q", "TEXT", None, "P9", None)]
HINTS = [("h1", "c1", "T1", "CELL"), ("h2", "T1", "T1", "CAPTION"), ("h3", "P1", None, "TEXT"), ("h4", "c3", "T1", "HEADER"), ("h5", "c2", "T1", "TEXT"), ("h6", "P9", None, "CELL")]
LINKS = [("T1", "P1"), ("T1", "P1"), ("T2", "P1")]


def _candidates(t):
    return per_customer(t, CANDIDATES, "candidate_id string, source_type string, table_id string, paragraph_id string, cells array<string>", "candidate_id", "table_id", "paragraph_id", "cells")


def _links(t):
    return per_customer(t, LINKS, "table_id string, paragraph_id string", "table_id", "paragraph_id")


@query(per_customer_sql([("t", "h1", "DIRECT"), ("t", "h2", "DIRECT"), ("t", "h3", "LINKED"), ("p", "h3", "DIRECT"), ("p", "h1", "LINKED"), ("p", "h2", "LINKED"), ("p", "h4", "LINKED")], "candidate_id, hint_id, association", "candidate_id", "hint_id"))
def jn_hints(t):
    return L.candidate_hints(_candidates(t), per_customer(t, HINTS, "hint_id string, source_ref string, table_id string, kind string", "hint_id", "source_ref", "table_id"), _links(t))


@query(per_customer_sql([("p", "{c}:T1 {c}:T2"), ("q", "")], "candidate_id, table_ids", "candidate_id"))
def ret_narrative(t):
    return L.narrative_tables(_candidates(t), _links(t)).select("candidate_id", F.array_join("table_ids", " ").alias("table_ids"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'EXACT_ROW_PATH' WHEN l_linestatus = 'R' THEN 'EXACT_COLUMN_PATH' WHEN l_quantity > 25 THEN 'EXACT_PERIOD_LABEL' ELSE 'STRUCTURAL' END AS basis FROM lineitem")
def ret_locate(t):
    x = t("lineitem")
    period = F.when(F.col("l_quantity") > 25, "2024")
    return x.select("l_orderkey", "l_linenumber", L.match_basis(F.lit("R"), period, F.array("l_returnflag"), F.array("l_linestatus")).alias("basis"))


CELLS = [
    ("a", "T1", "r1", 2023, "OTHER", "NET", "2023", 5.0), ("b", "T2", "r1", 2023, "INCOME_STATEMENT", "NET", "2023", 5.0), ("c", "T3", "r2", 2024, "OTHER", "NET", "2023", 5.0),
    ("d", "T1", "r1", 2023, "OTHER", "COST", "2022", 1.0), ("e", "T3", "r2", 2024, "OTHER", "COST", "2022", 2.0), ("f", "T3", "r2", 2024, "OTHER", "TAX", "2024", None), ("g", "T4", "r2", 2024, "OTHER", "TAX", "2024", None),
    ("h", "T4", "r2", 2024, "OTHER", "DEBT", "2024", 7.0), ("i", "T3", "r2", 2024, None, "DEBT", "2024", 7.0),
]
REQUIREMENTS = [("1", "NET", "2023"), ("2", "COST", "2022"), ("3", "TAX", "2024"), ("4", "DEBT", "2024"), ("5", "NONE", "2024"), ("6", "COST", None), ("7", None, "1999")]


@query(per_customer_sql([("q", *r) for r in [("1", "b", "RESOLVED"), ("2", "d", "AMBIGUOUS"), ("2", "e", "AMBIGUOUS"), ("3", "f", "AMBIGUOUS"), ("3", "g", "AMBIGUOUS"), ("4", "i", "RESOLVED"), ("5", None, "UNRESOLVED"), ("6", "d", "AMBIGUOUS"), ("6", "e", "AMBIGUOUS"), ("7", None, "UNRESOLVED")]], "question_id, requirement_id, cell_id, status", "question_id"))
def jn_schema_link(t):
    cells = per_customer(t, [("q", *r) for r in CELLS], "question_id string, cell_id string, table_id string, report_id string, report_year int, table_class string, metric string, period string, value double", "question_id")
    asked = per_customer(t, [("q", *r) for r in REQUIREMENTS], "question_id string, requirement_id string, metric string, period string", "question_id")
    return L.link_schema(asked, cells)


RULES = [("REVENUE", "INCOME", ["01", "10"], r"doanh thu"), ("NET_REVENUE", "INCOME", ["10"], r"doanh thu thuan"), ("CASH", "BALANCE", ["110"], r"^tien")]
CODED = [("a", "INCOME", "01", "Doanh thu bán hàng"), ("b", "INCOME", "10", "Doanh thu thuần"), ("c", "INCOME", "01", "Chi phí"), ("d", "BALANCE", "110", "Tiền"), ("e", "BALANCE", None, "Tiền"), ("f", "CTCK", "20", "Doanh thu")]


@query(per_customer_sql([("a", "REVENUE"), ("b", None), ("c", None), ("d", "CASH"), ("e", None), ("f", "REVENUE")], "id, metric", "id"))
def str_metric_code(t):
    rows = per_customer(t, CODED, "id string, statement string, code string, label string", "id")
    return rows.select("id", L.metric_of_code(F.col("statement"), F.col("code"), F.col("label"), RULES, {("CTCK", "20"): "REVENUE"}).alias("metric"))


@query(per_customer_sql([("a", None), ("b", None), ("c", None), ("d", "CASH"), ("e", "CASH"), ("f", None)], "id, metric", "id"))
def str_bank_label(t):
    rows = per_customer(t, CODED, "id string, statement string, code string, label string", "id")
    return rows.select("id", L.metric_of_label(F.col("statement"), F.col("label"), [("CASH", "BALANCE", "tien"), ("SALES", "INCOME", "doanh")]).alias("metric"))


WINDOWS = [("a", "Bảng cân đối kế toán"), ("b", "Báo cáo kết quả kinh doanh"), ("c", "Bảng cân đối kế toán và kết quả kinh doanh"), ("d", "Thuyết minh"), ("e", None)]


@query(per_customer_sql([("a", "BALANCE_SHEET"), ("b", "INCOME_STATEMENT"), ("c", None), ("d", None), ("e", None)], "id, class", "id"))
def str_table_class(t):
    rules = [("BALANCE_SHEET", "can doi ke toan"), ("INCOME_STATEMENT", "ket qua (hoat dong )?kinh doanh")]
    return per_customer(t, WINDOWS, "id string, text string", "id").select("id", L.table_class(F.col("text"), rules).alias("class"))


GRID = [
    ("T", 0, ["h1", "h2", "h3", "h4"], ["Chỉ tiêu", "Mã", "2024", "2023"], 2), ("T", 1, ["s", "s2", "s3", "s4"], ["TÀI SẢN", "", "", ""], 2),
    ("T", 2, ["f", "f", "f", "f"], ["Ngắn hạn"] * 4, 2), ("T", 3, ["a", "b", "c", "d"], ["Tiền", "110", "5", "4"], 2), ("T", 4, ["e", "g", "m", "m"], ["Thuế", "", "9", "9"], 2),
    ("T", 5, ["i", "j", "k", "l"], ["", "", "1", "2"], 2), ("T", 6, ["n", "o", "p", "q"], ["Nợ", "300", "-", ""], 2),
]
GRID_SCHEMA = "table_id string, grid_row int, slots array<string>, texts array<string>, header_end int"


@query(per_customer_sql([("T", 3, "Tiền", "110", "c"), ("T", 6, "Nợ", "300", "p")], "table_id, grid_row, label, code, cell_id", "table_id"))
def doc_rows(t):
    return L.data_rows(per_customer(t, GRID, GRID_SCHEMA, "table_id"), 2, 0, 1)


@query(per_customer_sql([("T", 1, "TÀI SẢN", None, "s3", "s4"), ("T", 2, "Ngắn hạn", None, None, None), ("T", 3, "Tiền", "110", "c", "d"), ("T", 4, "Thuế", None, None, None), ("T", 6, "Nợ", "300", "p", "q")], "table_id, grid_row, label, code, current_id, prior_id", "table_id"))
def doc_lines(t):
    return L.printed_lines(per_customer(t, GRID, GRID_SCHEMA, "table_id"), 2, 3, 0, 1)


@query("WITH s AS (SELECT conv_id, min(turn) AS started FROM conversations WHERE turn >= 2 AND role = 'assistant' GROUP BY 1) SELECT conv_id, turn FROM conversations JOIN s USING (conv_id) WHERE turn >= started")
def doc_notes(t):
    c = t("conversations").withColumn("after", F.lit(2)).withColumn("kind", F.when(F.col("role") == "assistant", "text").otherwise("table"))
    blocks = c.select(F.col("conv_id").alias("report_id"), F.col("turn").alias("start"), "kind", F.lit("Thuyết minh").alias("text"), "after")
    return L.notes_blocks(blocks, "^thuyet minh").select(F.col("report_id").alias("conv_id"), F.col("start").alias("turn"))


@query("SELECT o_orderkey, passed, CASE WHEN NOT passed THEN 'REQUIRED_' || source || '_EVIDENCE_MISSING' END AS reason FROM (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'TABLE' ELSE 'TEXT' END AS source, EXISTS (SELECT 1 FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber) WHERE l_orderkey = o_orderkey AND a.l_returnflag = 'R' AND b.l_linestatus = 'F') AS passed FROM orders WHERE o_orderstatus <> 'P')")
def ver_support(t):
    asked = t("orders").select(F.col("o_orderkey").alias("requirement_id"), F.when(F.col("o_custkey") % 2 == 0, "TABLE").otherwise("TEXT").alias("source_type"), (F.col("o_orderstatus") != "P").alias("required"))
    lines = t("lineitem").select(F.col("l_orderkey").alias("requirement_id"), F.col("l_linenumber").alias("evidence_id"), "l_returnflag", "l_linestatus")
    found = L.evidence_support(asked, lines.filter("l_returnflag = 'R'"), lines.filter("l_linestatus = 'F'").select("requirement_id", "evidence_id"))
    return found.withColumnRenamed("requirement_id", "o_orderkey")


RUNS = [
    ("a", "p", "p", "SCALAR", "SCALAR", [(1.0, "RAW", "VND")], None), ("b", "p", "x", "SCALAR", "SCALAR", None, None), ("c", "p", "p", "SCALAR", "ORDERED_VALUES", [(1.0, None, None)], [(1.0, None, None), (2.0, None, None)]),
    ("d", "p", "p", "ORDERED_VALUES", "ORDERED_VALUES", [(2.0, "OTHER", ""), (1.0, None, None)], [(1.0, None, None), (2.0, None, None)]), ("e", "p", "p", "SCALAR", "SCALAR", [(None, None, "VND")], None),
]


@query(per_customer_sql([("a", ""), ("b", "PROGRAM_ID_MISMATCH SUCCESS_OUTPUT_MISSING"), ("c", "OUTPUT_KIND_MISMATCH ORDERED_VALUE_COUNT_MISMATCH"), ("d", "INVALID_SCALE_STRUCTURE INVALID_UNIT_STRUCTURE ORDERED_VALUES_ORDER_MISMATCH"), ("e", "INVALID_CANONICAL_DECIMAL")], "id, reasons", "id"))
def ver_numeric(t):
    datum = "array<struct<value: double, scale: string, unit: string>>"
    data = lambda v: v and [dict(zip(("value", "scale", "unit"), x)) for x in v]
    rows = per_customer(t, [(*r[:5], *map(data, r[5:])) for r in RUNS], f"id string, program string, ran string, kind string, wanted_kind string, vals {datum}, wanted {datum}", "id")
    return rows.select("id", F.array_join(L.numeric_reasons(*map(F.col, ("program", "ran", "kind", "wanted_kind", "vals", "wanted"))), " ").alias("reasons"))


ENTRIES = [("Doanh  thu?", "f1", 1.0, "v1", "PASS", "5", 1), ("doanh thu?", "f1", 1.0, "v1", "PASS", "6", 2), ("Nợ?", "f2", 0.5, "v1", "PASS", "7", 1), ("Thuế?", "f3", 1.0, "v1", "REFUSED", None, 1), ("Vốn?", "f4", 1.0, "v0", "PASS", "8", 1)]
ASKED = [("1", " DOANH thu?", "f1", 1.0, "v1"), ("2", "nợ?", "f2", 0.5, "v1"), ("3", "Thuế?", "f3", 1.0, "v1"), ("4", "Vốn?", "f4", 1.0, "v1"), ("5", "Khác", "f1", 1.0, "v1")]


@query(values([("QUERY", "1", "6"), ("QUERY", "2", "7"), ("FIELD", "1", "6"), ("FIELD", "2", "7"), ("FIELD", "5", "6"), ("ADAPTIVE", "1", "6"), ("ADAPTIVE", "5", "6")], "policy, asked_id, answer"))
def ret_cache(t):
    asked = rows_of(t, ASKED, "asked_id string, question string, fields string, confidence double, fingerprint string")
    entries = rows_of(t, ENTRIES, "question string, fields string, confidence double, fingerprint string, status string, answer string, put int")
    hits = [L.cache_hits(entries, asked, p).select(F.lit(p).alias("policy"), "asked_id", "answer") for p in ("QUERY", "FIELD", "ADAPTIVE", "NONE")]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).unionByName(hits[3])
