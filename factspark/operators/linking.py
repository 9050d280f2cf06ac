"""Links between candidates, cells, hints, lines and requirements, and the checks made on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar


def candidate_hints(candidates: DataFrame, hints: DataFrame, links: DataFrame) -> DataFrame:
    """(candidate_id, hint_id, association) of candidates (candidate_id, source_type, table_id, paragraph_id, cells).

    hints (hint_id, source_ref, table_id, kind); links (table_id, paragraph_id).
    A table's own cells, headers and caption and a paragraph's own text are
    DIRECT, what the links lead to is LINKED; each is given once. Candidates
    without hints give no rows.
    """
    table, text = candidates.filter("source_type = 'TABLE'"), candidates.filter("source_type = 'TEXT'")
    kind = F.col("kind")
    # all sides grow with the reports: none may be taken for small and sent to the driver
    links = links.hint("merge")
    by_ref = hints.select(F.col("source_ref").alias("ref"), "hint_id", "kind")
    own = [
        table.select("candidate_id", F.explode("cells").alias("ref")).join(by_ref.filter(kind.isin("HEADER", "CELL")).hint("merge"), "ref"),
        table.select("candidate_id", F.col("table_id").alias("ref")).join(by_ref.filter(kind == "CAPTION").hint("merge"), "ref"),
        text.select("candidate_id", F.col("paragraph_id").alias("ref")).join(by_ref.filter(kind == "TEXT").hint("merge"), "ref"),
    ]
    other = [
        table.select("candidate_id", "table_id").join(links, "table_id").select("candidate_id", F.col("paragraph_id").alias("ref")).join(by_ref.filter(kind == "TEXT").hint("merge"), "ref"),
        text.select("candidate_id", "paragraph_id").join(links, "paragraph_id").select("candidate_id", "table_id").join(hints.filter(kind != "TEXT").select("table_id", "hint_id").hint("merge"), "table_id"),
    ]
    named = [df.select("candidate_id", "hint_id", F.lit(name).alias("association")) for name, part in (("DIRECT", own), ("LINKED", other)) for df in part]
    return reduce(DataFrame.unionByName, named).distinct()


def narrative_tables(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """TEXT candidates (candidate_id, paragraph_id) with table_ids, the sorted distinct tables that their paragraph is linked to; empty if none."""
    text = candidates.filter("source_type = 'TEXT'")
    named = links.groupBy("paragraph_id").agg(F.array_sort(F.collect_set("table_id")).alias("table_ids"))  # of one paragraph
    return text.join(named.hint("merge"), "paragraph_id", "left").select("candidate_id", F.coalesce("table_ids", F.array().cast("array<string>")).alias("table_ids"))


def match_basis(metric: Column, period: Column, row_labels: Column, column_labels: Column) -> Column:
    """How a cell was located: by its row's labels, its column's, its period, its place, or not at all."""
    return (
        F.when(F.array_contains(row_labels, metric), "EXACT_ROW_PATH").when(F.array_contains(column_labels, metric), "EXACT_COLUMN_PATH")
        .when(period.isNotNull(), "EXACT_PERIOD_LABEL").when(F.size(F.concat(row_labels, column_labels)) > 0, "STRUCTURAL").otherwise("NONE")
    )


def link_schema(requirements: DataFrame, cells: DataFrame) -> DataFrame:
    """(question_id, requirement_id, cell_id, status) of requirements (question_id, requirement_id, metric, period) and cells.

    cells (question_id, cell_id, table_id, report_id, report_year, table_class,
    metric, period, value) are what was found for a question. A null metric or
    period asks for nothing. Cells of a report of the
    period's year go before others; one figure printed again in its report is
    taken once, from an income statement, else from the table with most cells.
    One cell left is RESOLVED, several are AMBIGUOUS, none is one UNRESOLVED row
    with a null cell_id.
    """
    # tables of one question lie together, so that their sizes and the join need no second shuffle; no estimate of Spark's may send either side to the driver
    per_table = F.count("*").over(W.partitionBy("question_id", "table_id"))
    sized = cells.filter("table_id is not null").repartition("question_id").withColumn("cells", per_table).withColumn("found", F.lit(True))
    asked = requirements.select("question_id", "requirement_id", F.col("metric").alias("m"), F.col("period").alias("p")).alias("a")
    same = (F.col("a.question_id") == F.col("c.question_id")) & (F.col("m").isNull() | (F.col("m") == F.col("metric"))) & (F.col("p").isNull() | (F.col("p") == F.col("period")))
    met = asked.join(sized.hint("merge").alias("c"), same, "left").drop(F.col("c.question_id"))
    one = W.partitionBy("question_id", "requirement_id")
    met = met.withColumn("year", F.coalesce(F.col("report_year").cast("string") == F.substring("p", 1, 4), F.lit(False)))
    met = met.withColumn("years", F.max("year").over(one)).filter(F.col("year") == F.col("years"))
    # a set of one value is told by its ends; a null value is never the same figure
    ends = lambda c: F.min(c).over(one) == F.max(c).over(one)
    met = met.withColumn("single", ends("report_id") & ends("value") & (F.count("value").over(one) == F.count("*").over(one)))
    order = one.orderBy(F.coalesce(F.col("table_class") != "INCOME_STATEMENT", F.lit(True)), F.desc("cells"), "cell_id")
    met = met.withColumn("at", F.row_number().over(order)).filter(~F.coalesce("single", F.lit(False)) | (F.col("at") == 1))
    status = F.when(F.col("found").isNull(), "UNRESOLVED").when(F.count("*").over(one) == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return met.select("question_id", "requirement_id", "cell_id", status.alias("status"))


def only_match(matches: Sequence[tuple[str, Column]]) -> Column:
    """The name whose condition holds if it is the only one; else null."""
    held = F.array_distinct(F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in matches])))
    return F.when(F.size(held) == 1, held[0])


def metric_of_code(statement: Column, code: Column, label: Column, rules: Sequence[tuple[str, str, Sequence[str], str]], first: Mapping[tuple[str, str], str] | None = None) -> Column:
    """Metric of a coded row by rules (metric, statement, codes, pattern over the folded label): code and label must agree.

    `first` gives metrics by (statement, code) that go before, where their pattern
    holds. Null unless exactly one rule matches.
    """
    folded = scalar.fold(label)
    patterns = {metric: pattern for metric, _, _, pattern in rules}
    early = [F.when((statement == s) & (code == c) & folded.rlike(patterns[m]), F.lit(m)) for (s, c), m in (first or {}).items()]
    last = only_match([(m, (statement == s) & code.isin(*codes) & folded.rlike(pattern)) for m, s, codes, pattern in rules])
    return F.coalesce(*early, last)


def metric_of_label(statement: Column, label: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Metric of a row without a code by rules (metric, statement, pattern of the whole label key); null unless exactly one matches."""
    key = scalar.label_key(label)
    return only_match([(m, (statement == s) & key.rlike(rf"\A(?:{pattern})\z")) for m, s, pattern in rules])


def table_class(window: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Class of a table by rules (class, pattern) over the folded text before it; null where none or several classes match."""
    folded = scalar.fold(window)
    return only_match([(name, folded.rlike(pattern)) for name, pattern in rules])


def _own(slots: Column, at: int) -> Column:
    """The cell at a column if no other column of its row holds it too."""
    cell = F.element_at(slots, at + 1)
    return F.when(F.size(F.filter(slots, lambda x: x == cell)) == 1, cell)


def data_rows(rows: DataFrame, current: int, label: int, code: int) -> DataFrame:
    """(table_id, grid_row, label, code, cell_id) of the rows (table_id, grid_row, slots, texts, header_end) that print one figure.

    slots are the cell ids by column, texts their texts. Rows of one cell, rows
    whose figure is merged over columns, and rows without label and code go.
    """
    named = rows.filter("grid_row >= coalesce(header_end, 0)").select("table_id", "grid_row", "slots", F.nullif(F.element_at("texts", label + 1), F.lit("")).alias("label"), F.nullif(F.element_at("texts", code + 1), F.lit("")).alias("code"))
    full = F.size(F.array_distinct("slots")) == 1
    kept = named.filter(~full & (F.col("label").isNotNull() | F.col("code").isNotNull()))
    return kept.select("table_id", "grid_row", "label", "code", _own(F.col("slots"), current).alias("cell_id")).filter("cell_id is not null")


def printed_lines(rows: DataFrame, current: int, prior: int, label: int, code: int) -> DataFrame:
    """(table_id, grid_row, label, code, current_id, prior_id): every printed line, headings and empty figures too.

    Rows of one cell are headings if they lie behind the header. Above the first
    figure only a label without code and figures is a line, and only if the row
    above doesn't print the same cell.
    """
    before = F.lag(F.element_at("slots", label + 1)).over(W.partitionBy("table_id").orderBy("grid_row"))
    full = F.size(F.array_distinct("slots")) == 1
    text = lambda at: F.nullif(F.element_at("texts", at + 1), F.lit(""))
    header = F.col("grid_row") < F.coalesce("header_end", F.lit(0))
    lines = rows.withColumn("again", F.coalesce(before == F.element_at("slots", label + 1), F.lit(False)))
    bare = text(code).isNull() & text(current).isNull() & text(prior).isNull() & ~F.col("again")
    keep = F.when(full, text(label).isNotNull() & ~header).otherwise((text(label).isNotNull() | text(code).isNotNull()) & (~header | bare))
    own = lambda at: F.when(~full, _own(F.col("slots"), at))
    return lines.filter(keep).select("table_id", "grid_row", text(label).alias("label"), F.when(~full, text(code)).alias("code"), own(current).alias("current_id"), own(prior).alias("prior_id"))


def notes_blocks(blocks: DataFrame, heading: str, after: str = "after") -> DataFrame:
    """The blocks (report_id, start, kind, text, after) of a report from its first text that matches `heading` behind `after` on."""
    behind = blocks.filter(F.col("start") >= F.col(after))
    first = behind.filter((F.col("kind") == "text") & scalar.fold(F.col("text")).rlike(heading)).groupBy("report_id").agg(F.min("start").alias("started"))
    return behind.join(first, "report_id").filter("start >= started")


def evidence_support(requirements: DataFrame, covered: DataFrame, declared: DataFrame) -> DataFrame:
    """(requirement_id, passed, reason) of required requirements (requirement_id, source_type, required).

    covered and declared are (requirement_id, evidence_id): a requirement passes
    if some evidence is in both.
    """
    met = covered.select("requirement_id", "evidence_id").join(declared, ["requirement_id", "evidence_id"], "left_semi").select("requirement_id").distinct()
    asked = requirements.filter("required").join(met.withColumn("passed", F.lit(True)), "requirement_id", "left")
    passed = F.coalesce("passed", F.lit(False))
    reason = F.when(~passed, F.concat(F.lit("REQUIRED_"), "source_type", F.lit("_EVIDENCE_MISSING")))
    return asked.select("requirement_id", passed.alias("passed"), reason.alias("reason"))


def numeric_reasons(program_id: Column, ran_id: Column, kind: Column, wanted_kind: Column, values: Column, wanted: Column) -> Column:
    """What is wrong with a run's output, in order: its program, output, kind, number of values, each value's form, their order.

    values and wanted are arrays of (value, scale, unit); a null `values` is a
    missing output, after which nothing else is checked.
    """
    ordered = wanted_kind == "ORDERED_VALUES"
    count = F.when(ordered, F.size(wanted)).otherwise(1)
    def bad(test) -> Column:
        return F.coalesce(F.exists(values, test), F.lit(False))

    checks = [
        (~ran_id.eqNullSafe(program_id), "PROGRAM_ID_MISMATCH"),
        (values.isNull(), "SUCCESS_OUTPUT_MISSING"),
        (values.isNotNull() & ~kind.eqNullSafe(wanted_kind), "OUTPUT_KIND_MISMATCH"),
        (values.isNotNull() & (F.size(values) != count), F.when(ordered, "ORDERED_VALUE_COUNT_MISMATCH").otherwise("SCALAR_VALUE_COUNT_MISMATCH")),
        (bad(lambda v: v["value"].isNull()), "INVALID_CANONICAL_DECIMAL"),
        (bad(lambda v: F.coalesce(v["scale"] == "OTHER", F.lit(False))), "INVALID_SCALE_STRUCTURE"),
        (bad(lambda v: F.coalesce(v["unit"] == "", F.lit(False))), "INVALID_UNIT_STRUCTURE"),
        (values.isNotNull() & ordered & (F.size(values) == F.size(wanted)) & (F.transform(values, lambda v: v["value"]) != F.transform(wanted, lambda v: v["value"])), "ORDERED_VALUES_ORDER_MISMATCH"),
    ]
    return F.array_compact(F.array(*[F.when(wrong, reason if isinstance(reason, Column) else F.lit(reason)) for wrong, reason in checks]))


def cache_hits(entries: DataFrame, asked: DataFrame, policy: str, least: float = 1.0) -> DataFrame:
    """(asked_id, answer) of questions (asked_id, question, fields, confidence, fingerprint) that the cache can answer.

    entries (question, fields, confidence, fingerprint, status, answer, put) count if
    verified (status PASS with an answer). The key is the question's plain form
    (QUERY), its fields (FIELD), or its fields where the confidence is at least
    `least` (ADAPTIVE); NONE never hits. The latest entry of a key stands, and
    not once its fingerprint has changed.
    """
    def keyed(df: DataFrame) -> DataFrame:
        plain = F.lower(F.trim(F.regexp_replace("question", r"\s+", " ")))
        key = {"QUERY": plain, "FIELD": F.col("fields"), "ADAPTIVE": F.when(F.col("confidence") >= least, F.col("fields")), "NONE": F.lit(None).cast("string")}[policy]
        return df.withColumn("signature", F.sha2(key, 256)).filter("signature is not null")

    stored = keyed(entries.filter("status = 'PASS' and answer is not null"))
    latest = stored.groupBy("signature").agg(F.max_by(F.struct("fingerprint", "answer"), "put").alias("e"))
    return keyed(asked).join(latest, "signature").filter(F.col("fingerprint") == F.col("e.fingerprint")).select("asked_id", F.col("e.answer").alias("answer"))
