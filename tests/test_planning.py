"""Gates, plans, programs and verified answers on questions that are easy to misplan."""

import pytest
from pyspark.sql import functions as F

from factspark.operators import planning as G

UNDERSTOOD = "question_id long, companies array<string>, company_status string, metrics array<string>, ratios array<string>, required_metrics array<string>, years array<int>, scope string, operation string"
ROWS = [
    (1, ["a"], "RESOLVED", ["EQUITY"], [], ["EQUITY"], [2020], "RIENG", "NONE"),
    (2, ["a"], "RESOLVED", [], ["ROE"], ["LNST", "EQUITY"], [2021], "RIENG", "RATIO"),
    (3, ["a"], "RESOLVED", ["LNST"], [], ["LNST"], [2021, 2020], "RIENG", "growth"),
    (4, ["a"], "RESOLVED", ["LNST"], [], ["LNST"], [2020], "RIENG", "growth"),
    (5, ["a"], "RESOLVED", ["LNST"], [], ["LNST"], [2020], None, "NONE"),
    (6, [], "UNRESOLVED", ["LNST"], [], ["LNST"], [2020], "RIENG", "NONE"),
    (7, ["a"], "RESOLVED", ["LNST"], ["ROE"], ["LNST", "EQUITY"], [2020], "RIENG", "NONE"),
    (8, ["a"], "RESOLVED", [], ["ROE", "ROA"], ["LNST", "EQUITY"], [2020], "RIENG", "NONE"),
    (9, ["a"], "RESOLVED", ["LNST"], [], ["LNST"], [2020], "RIENG", "UNKNOWN"),
    (10, ["a"], "RESOLVED", [], ["DEBT_TO_EQUITY"], ["LIABILITIES", "EQUITY"], [2020, 2021], "RIENG", "COMPARE"),
    (11, ["a"], "RESOLVED", ["LNST", "EQUITY"], [], ["LNST", "EQUITY"], [2020], "RIENG", "NONE"),
    (12, ["a"], "RESOLVED", ["LNST"], [], ["LNST"], [], "RIENG", "NONE"),
    (13, ["a"], "RESOLVED", ["LNST"], [], ["LNST"], [2020], "RIENG", "RATIO"),
    (14, ["a"], "RESOLVED", [], ["ROE"], ["LNST", "EQUITY"], [2020, 2021], "RIENG", "aggregate"),
]
VALUES = {("EQUITY", 2020): 10.0, ("EQUITY", 2021): 30.0, ("LNST", 2020): 4.0, ("LNST", 2021): 5.0, ("LIABILITIES", 2020): 5.0, ("LIABILITIES", 2021): 0.0}


@pytest.fixture
def plans(spark):
    return G.plan(spark.createDataFrame(ROWS, UNDERSTOOD))


@pytest.fixture
def facts(spark):
    rows = [(f"{m}{y}", "a", "RIENG", m, y, v, "VND") for (m, y), v in VALUES.items()]
    return spark.createDataFrame(rows, "fact_id string, company string, scope string, metric string, year int, value double, unit string")


def test_the_gate_tells_the_first_failure(spark):
    rows = [(i, [j >= i for j in range(7)]) for i in range(8)] + [(9, [None] * 7)]
    df = spark.createDataFrame(rows, "i int, f array<boolean>")
    decision, code = G.gate(*[F.col("f")[j] for j in range(7)])
    got = {r.i: (r.d, r.c) for r in df.select("i", decision.alias("d"), code.alias("c")).collect()}
    assert got == {i: (G.GATE[i][1], G.GATE[i][0]) for i in range(7)} | {7: ("PROCEED", None), 9: ("PROCEED", None)}


def test_reasons(plans):
    got = {r.question_id: r.abstain_reason for r in plans.collect()}
    assert got == {
        1: None, 2: None, 3: None, 4: "INVALID_PERIOD_REQUIREMENT", 5: "MISSING_STATEMENT_SCOPE", 6: "PLANNING_GATE_BLOCKED", 7: "UNSUPPORTED_RATIO", 8: "UNSUPPORTED_RATIO",
        9: "UNKNOWN_OPERATION", 10: None, 11: None, 12: "PLANNING_GATE_BLOCKED", 13: "UNKNOWN_OPERATION", 14: "UNSUPPORTED_RATIO",
    }
    routes = {r.question_id: (r.question_type, r.reasoning_mode, r.model_tier, r.verify_profile, r.max_retries) for r in plans.filter("abstain_reason IS NULL").collect()}
    assert routes[1] == ("LOOKUP", "DIRECT", "CHEAP", "LIGHT", 1) and routes[11][3] == "FULL" and routes[3] == ("MULTI_PERIOD", "PROGRAM", "STRONG", "FULL", 2)


def test_programs_and_their_results(plans, facts):
    steps = {}
    for r in G.programs(plans).collect():
        steps.setdefault(r.question_id, []).append((r.step, r.op, r.inputs))
    assert sorted(steps[2]) == [(1, "FORMULA ROE", ["LNST@2021", "EQUITY@2021", "EQUITY@2020"])] and sorted(steps[3]) == [(1, "FORMULA GROWTH_RATE", ["LNST@2020", "LNST@2021"])]
    assert sorted(steps[11]) == [(1, "IDENTITY", ["LNST@2020"]), (2, "IDENTITY", ["EQUITY@2020"]), (3, "COLLECT", ["#1", "#2"])] and set(steps) == {1, 2, 3, 10, 11}
    ran = {(r.question_id, r.step): r.value for r in G.executed(G.programs(plans), plans, facts).collect()}
    assert ran == {(1, 1): 10.0, (2, 1): 25.0, (3, 1): 25.0, (10, 1): 0.5, (10, 2): 0.0, (11, 1): 4.0, (11, 2): 10.0}
    told = {(r.question_id, r.target, r.output_year): (r.value, r.unit, r.reason) for r in G.expected(plans, facts).collect()}
    assert told[2, "ROE", 2021] == (25.0, "PERCENT", None) and told[3, "LNST", 2021] == (25.0, "PERCENT", None) and told[10, "DEBT_TO_EQUITY", 2021] == (0.0, "TIMES", None) and told[1, "EQUITY", 2020] == (10.0, "VND", None)


def test_missing_doubled_and_mixed_facts(spark, plans, facts):
    reasons = lambda f: {r.question_id: r.reason for r in G.expected(plans, f).collect()}
    assert reasons(facts.filter("fact_id <> 'EQUITY2020'"))[2] == "REFERENCE_INPUT_UNAVAILABLE" and reasons(facts.union(facts))[3] == "REFERENCE_INPUT_UNAVAILABLE"
    assert reasons(facts.withColumn("unit", F.col("fact_id")))[3] == "UNIT_MISMATCH" and reasons(facts.withColumn("value", F.lit(0.0)))[3] == "ZERO_DENOMINATOR"
    assert G.expected(plans, facts.limit(0)).filter("reason IS NULL").count() == 0 and G.plan(spark.createDataFrame([], UNDERSTOOD)).count() == 0


def test_verified_answers(spark, plans, facts):
    ran = {r.question_id: (r.value, r.probe) for r in G.executed(G.programs(plans).filter("question_id IN (1, 2, 3)"), plans, facts).collect()}
    ids = {1: ["EQUITY2020"], 2: ["EQUITY2020", "EQUITY2021", "LNST2021"], 3: ["LNST2021", "LNST2020"]}
    unit = {1: "VND", 2: "PERCENT", 3: "PERCENT"}
    schema = "question_id long, value double, unit string, fact_ids array<string>, probe double"
    check = lambda *rows: {r.question_id: r.failed for r in G.verified(spark.createDataFrame(list(rows), schema), plans, facts).collect()}
    assert check(*[(q, ran[q][0], unit[q], ids[q], ran[q][1]) for q in (1, 2, 3)]) == {1: [], 2: [], 3: []}
    wrong = check((1, 10.1, None, ids[1], None), (2, ran[2][0], "PERCENT", None, ran[2][0]), (3, None, "VND", [], 0.0), (4, 1.0, "VND", [], 1.0), (None, 1.0, "VND", [], 1.0))
    assert wrong == {1: ["RESULT_UNIT", "FORMULA_RESULT", "FORMULA_PROGRAM"], 2: ["SOURCE_ROWS", "FORMULA_PROGRAM"], 3: ["SOURCE_ROWS", "RESULT_UNIT", "FORMULA_RESULT", "FORMULA_PROGRAM"], 4: ["NO_PLAN"], None: ["NO_PLAN"]}
    # inputs in the wrong places give another value
    turned = spark.createDataFrame([(3, 1, "FORMULA GROWTH_RATE", ["LNST@2021", "LNST@2020"])], "question_id long, step int, op string, inputs array<string>")
    assert G.executed(turned, plans, facts).first().value == -20.0


def test_only_named_facts_go_on_and_tell_the_same(spark, plans, facts):
    others = spark.createDataFrame([("x", "b", "RIENG", "LNST", 2020, 1.0, "VND"), ("y", "a", "HOP_NHAT", "LNST", 2020, 1.0, "VND"), ("z", "a", "RIENG", "COGS", 2020, 1.0, "VND"), ("v", "a", "RIENG", "EQUITY", 2020, 1.0, "VND"), ("n", None, None, None, None, 1.0, "VND")], facts.schema)
    every = facts.union(others)
    more = spark.createDataFrame([(1, 9, "IDENTITY", ["COGS@2020"])], G.programs(plans).schema)
    steps = G.programs(plans).union(more)
    named = G.facts_named(every, plans, steps)
    assert {r.fact_id for r in named.collect()} == {f"{m}{y}" for m, y in VALUES} | {"z", "v"}
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(G.expected(plans, named)) == rows(G.expected(plans, every))
    assert rows(G.executed(steps, plans, named)) == rows(G.executed(steps, plans, every))


def test_t2p_writes_the_facts_that_questions_name(spark, monkeypatch):
    from factspark import catalog_questions as Q
    from factspark.catalog import Tables

    t, sizes, stored = Tables(spark, "/root/testdata/sf0.001"), {}, Q.stored
    monkeypatch.setattr(Q, "stored", lambda df, name: [out := stored(df, name), sizes.update({name: out.count()})][0])
    Q.ver_t2p(t)
    assert 0 < sizes["facts"] < Q.metric_facts(t).count() / 10
