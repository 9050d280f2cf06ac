"""Edge cases of links, lines and checks: empty tables, nulls, ties and repeated rows."""

from pyspark.sql import functions as F

from factspark.operators import linking as L

CELLS = "question_id string, cell_id string, table_id string, report_id string, report_year int, table_class string, metric string, period string, value double"


def test_schema_link_without_cells_is_unresolved(spark):
    asked = spark.createDataFrame([("q", "1", "NET", "2023"), ("q", "2", None, None)], "question_id string, requirement_id string, metric string, period string")
    got = L.link_schema(asked, spark.createDataFrame([], CELLS))
    assert sorted(map(tuple, got.collect())) == [("q", "1", None, "UNRESOLVED"), ("q", "2", None, "UNRESOLVED")]


def test_schema_link_null_value_is_no_single_figure(spark):
    asked = spark.createDataFrame([("q", "1", "NET", "2023")], "question_id string, requirement_id string, metric string, period string")
    cells = [("q", "a", "T", "r", 2023, None, "NET", "2023", 5.0), ("q", "b", "T", "r", 2023, None, "NET", "2023", None)]
    got = L.link_schema(asked, spark.createDataFrame(cells, CELLS))
    assert sorted(map(tuple, got.collect())) == [("q", "1", "a", "AMBIGUOUS"), ("q", "1", "b", "AMBIGUOUS")]


def test_requirement_that_asks_for_nothing_takes_every_cell(spark):
    asked = spark.createDataFrame([("q", "1", None, None)], "question_id string, requirement_id string, metric string, period string")
    cells = [("q", "a", "T", "r", 2023, None, "NET", "2023", 5.0), ("q", "b", "U", "s", 2023, None, "COST", "2022", 6.0), ("other", "c", "U", "s", 2023, None, "COST", "2022", 6.0)]
    got = L.link_schema(asked, spark.createDataFrame(cells, CELLS))
    assert sorted(map(tuple, got.collect())) == [("q", "1", "a", "AMBIGUOUS"), ("q", "1", "b", "AMBIGUOUS")]


def test_support_needs_the_same_evidence_on_both_sides(spark):
    asked = spark.createDataFrame([("1", "TABLE", True), ("2", "TEXT", True), ("3", "TEXT", False)], "requirement_id string, source_type string, required boolean")
    pairs = "requirement_id string, evidence_id string"
    covered = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], pairs)
    declared = spark.createDataFrame([("1", "a"), ("2", "c")], pairs)
    got = L.evidence_support(asked, covered, declared).collect()
    assert sorted(map(tuple, got)) == [("1", True, None), ("2", False, "REQUIRED_TEXT_EVIDENCE_MISSING")]


def test_cache_unknown_question_and_null_fields_never_hit(spark):
    entries = spark.createDataFrame([("q", None, 1.0, "v", "PASS", "1", 1)], "question string, fields string, confidence double, fingerprint string, status string, answer string, put int")
    asked = spark.createDataFrame([("1", "other", None, 1.0, "v")], "asked_id string, question string, fields string, confidence double, fingerprint string")
    for policy in ("QUERY", "FIELD", "ADAPTIVE", "NONE"):
        assert L.cache_hits(entries, asked, policy).count() == 0


def test_only_match_of_null_and_two_is_null(spark):
    rows = spark.createDataFrame([("ab",), ("a",), (None,)], "x string")
    got = rows.select(L.only_match([("A", F.col("x").contains("a")), ("B", F.col("x").contains("b"))])).collect()
    assert [r[0] for r in got] == [None, "A", None]


def test_schema_link_sends_no_side_to_the_driver(spark):
    """However small Spark believes the cells to be: rows that are made from a file are taken for its size."""
    asked = spark.createDataFrame([("q", "1", "NET", "2023")], "question_id string, requirement_id string, metric string, period string")
    cells = spark.createDataFrame([("q", "a", "T", "r", 2023, None, "NET", "2023", 5.0), ("q", "b", None, "r", 2023, None, "NET", "2023", 6.0)], CELLS)
    got = L.link_schema(asked, cells)
    assert [tuple(r) for r in got.collect()] == [("q", "1", "a", "RESOLVED")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_hints_send_no_side_to_the_driver(spark):
    candidates = spark.createDataFrame([("t", "TABLE", "T1", None, ["c1"]), ("p", "TEXT", None, "P1", None)], "candidate_id string, source_type string, table_id string, paragraph_id string, cells array<string>")
    hints = spark.createDataFrame([("h1", "c1", "T1", "CELL"), ("h2", "P1", None, "TEXT")], "hint_id string, source_ref string, table_id string, kind string")
    got = L.candidate_hints(candidates, hints, spark.createDataFrame([("T1", "P1")], "table_id string, paragraph_id string"))
    assert sorted(map(tuple, got.collect())) == [("p", "h1", "LINKED"), ("p", "h2", "DIRECT"), ("t", "h1", "DIRECT"), ("t", "h2", "LINKED")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
