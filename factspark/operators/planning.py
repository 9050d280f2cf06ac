"""Plans, requirements and programs of understood questions, and checks of their answers, all as rows.

A question that can't be planned keeps its row and says why. Requirements and
program steps are exploded from each question's own metrics and periods; facts
meet them in one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import scalar as S

#: Ratios over the average of the opening and the closing balance, and those in percent.
AVERAGED, IN_PERCENT = ("ROE", "ROA"), ("ROE", "ROA", "GROSS_MARGIN", "NET_MARGIN")
#: Formula of an operation and how many periods it takes: (least, most).
FORMULAS = {"GROWTH": ("GROWTH_RATE", 2, 2), "AGGREGATE": ("AVERAGE", 2, None), "RATIO": (None, 1, 1), "COMPARE": (None, 2, None), "NONE": (None, 1, None)}
#: The first failed boundary of a gate, in order: code, decision.
GATE = [
    ("UNKNOWN_COMPANY", "NO_DATA"), ("UNAVAILABLE_DATA", "UNSUPPORTED"), ("SUB_ANNUAL_PERIOD", "UNSUPPORTED"), ("MISSING_COMPANY_OR_METRIC", "NEEDS_CLARIFICATION"),
    ("MISSING_PERIOD", "NEEDS_CLARIFICATION"), ("OUT_OF_COVERAGE", "NO_DATA"), ("MISSING_SCOPE", "NEEDS_CLARIFICATION"),
]


def gate(*failed: Column) -> tuple[Column, Column]:
    """(decision, code) of the first of the seven predicates of GATE that holds; PROCEED and null without any. A null predicate doesn't hold."""
    code = decision = F.lit(None).cast("string")
    for (name, told), f in reversed(list(zip(GATE, failed, strict=True))):
        hit = F.coalesce(f, F.lit(False))
        code, decision = F.when(hit, name).otherwise(code), F.when(hit, told).otherwise(decision)
    return F.coalesce(decision, F.lit("PROCEED")), code


def plan(understood: DataFrame) -> DataFrame:
    """understood with operation, ratio, question_type, formula_id, periods, reasoning_mode, model_tier, verify_profile, max_retries and abstain_reason.

    The reason is the first of UNKNOWN_OPERATION, PLANNING_GATE_BLOCKED (no one
    company, no metric or no period), MISSING_STATEMENT_SCOPE, UNSUPPORTED_RATIO
    (several ratios, ratios beside metrics, or growth or an average of a ratio)
    and INVALID_PERIOD_REQUIREMENT; null where there is a plan, and then only the
    other columns hold.
    """
    has_ratio = F.size("ratios") > 0
    told = F.upper("operation")
    operation = F.when(has_ratio & (told == "NONE"), "RATIO").when(~has_ratio & (told == "RATIO"), "UNKNOWN").otherwise(told)
    p = understood.withColumn("operation", operation).withColumn("ratio", F.when(F.size("ratios") == 1, F.get("ratios", 0))).withColumn("periods", F.array_sort("years"))
    n, by = F.size("periods"), lambda i: F.coalesce(*[F.when(F.col("operation") == k, F.lit(v[i])) for k, v in FORMULAS.items()])
    blocked = (F.col("company_status") != "RESOLVED") | (F.size("required_metrics") == 0) | (n == 0)
    odd_ratio = has_ratio & (F.col("ratio").isNull() | (F.size("metrics") > 0) | F.col("operation").isin("GROWTH", "AGGREGATE"))
    reason = (
        F.when(F.col("operation") == "UNKNOWN", "UNKNOWN_OPERATION").when(blocked, "PLANNING_GATE_BLOCKED").when(F.col("scope").isNull(), "MISSING_STATEMENT_SCOPE")
        .when(odd_ratio, "UNSUPPORTED_RATIO").when((n < by(1)) | (n > by(2)), "INVALID_PERIOD_REQUIREMENT")
    )
    kind = F.when(F.col("operation") == "NONE", "LOOKUP").when(F.col("operation") == "RATIO", "DERIVED_RATIO").when(F.col("operation") == "AGGREGATE", "AGGREGATE").otherwise("MULTI_PERIOD")
    lookup, formula = F.col("operation") == "NONE", F.coalesce(by(0), F.col("ratio"))
    light = lookup & (F.size("metrics") * n == 1)
    return p.select(
        "*", kind.alias("question_type"), formula.alias("formula_id"), F.when(formula.isNotNull(), "PROGRAM").otherwise("DIRECT").alias("reasoning_mode"), F.when(formula.isNotNull(), "STRONG").otherwise("CHEAP").alias("model_tier"),
        F.when(light, "LIGHT").otherwise("FULL").alias("verify_profile"), F.when(lookup, 1).otherwise(2).alias("max_retries"), reason.alias("abstain_reason"),
    )


def requirements(plans: DataFrame, id_col: str = "question_id") -> DataFrame:
    """(id, company, scope, target, output_year, role, metric, year): what the plans need to know, a row each.

    role is VALUE, NUMERATOR, DENOMINATOR or OPENING; output_year is the period that the value is for.
    """
    def needs(target: Column, years: Column, fields: Sequence[tuple[str, Column, int]]) -> Column:
        return F.flatten(F.transform(years, lambda y: F.array(*[F.struct(target.alias("target"), y.alias("output_year"), F.lit(role).alias("role"), metric.alias("metric"), (y - back).alias("year")) for role, metric, back in fields])))

    plain = F.flatten(F.transform("metrics", lambda m: needs(m, F.col("periods"), [("VALUE", m, 0)])))
    parts = lambda i: F.coalesce(*[F.when(F.col("ratio") == r, needed[i]) for r, (_, needed) in X.RATIOS.items()])
    both = [("NUMERATOR", parts(0), 0), ("DENOMINATOR", parts(1), 0)]
    made = F.when(F.col("ratio").isin(*AVERAGED), needs(F.col("ratio"), F.col("periods"), [*both, ("OPENING", parts(1), 1)])).otherwise(needs(F.col("ratio"), F.col("periods"), both))
    every = F.when(F.col("ratio").isNotNull(), made).otherwise(plain)
    allowed = plans.filter("abstain_reason IS NULL").select(id_col, F.get("companies", 0).alias("company"), "scope", every.alias("all"))
    return allowed.select(id_col, "company", "scope", F.inline("all"))


def programs(plans: DataFrame, id_col: str = "question_id") -> DataFrame:
    """(id, step, op, inputs): IDENTITY of each value and COLLECT of several for look-ups, FORMULA over placed values else, and COLLECT where there are several results.

    Inputs are metric@year, or #step for an earlier step. Steps count from 1.
    """
    at = lambda m, y: F.concat(m, F.lit("@"), y.cast("string"))
    step = lambda op, inputs: F.struct(op.alias("op"), inputs.alias("inputs"))
    years = F.col("periods")
    parts = lambda i: F.coalesce(*[F.when(F.col("ratio") == r, needed[i]) for r, (_, needed) in X.RATIOS.items()])
    formula = F.concat(F.lit("FORMULA "), F.col("formula_id"))
    opening = lambda y: F.when(F.col("ratio").isin(*AVERAGED), F.array(at(parts(1), y - 1))).otherwise(F.array().cast("array<string>"))
    ratios = F.transform(years, lambda y: step(formula, F.concat(F.array(at(parts(0), y), at(parts(1), y)), opening(y))))
    over_time = F.transform("metrics", lambda m: step(formula, F.transform(years, lambda y: at(m, y))))
    single = F.flatten(F.transform("metrics", lambda m: F.transform(years, lambda y: step(F.lit("IDENTITY"), F.array(at(m, y))))))
    steps = F.when(F.col("ratio").isNotNull(), ratios).when(F.col("formula_id").isNotNull(), over_time).otherwise(single)
    ends = F.when(F.size(steps) > 1, F.concat(steps, F.array(step(F.lit("COLLECT"), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("#"), i.cast("string"))))))).otherwise(steps)
    out = plans.filter("abstain_reason IS NULL").select(id_col, F.posexplode(ends).alias("at", "s"))
    return out.select(id_col, (F.col("at") + 1).alias("step"), "s.op", "s.inputs")


def result(operation: Column, ratio: Column) -> Column:
    """The value of one target from its requirements' values, as an aggregate over columns role, value, year; probe it with other values under the same names."""
    value = F.col("value").cast("double")
    of = lambda role: F.max(F.when(F.col("role") == role, value))
    below = F.when(ratio.isin(*AVERAGED), (of("DENOMINATOR") + of("OPENING")) / 2).otherwise(of("DENOMINATOR"))
    first, last = F.min_by(value, "year"), F.max_by(value, "year")
    return (
        F.when(ratio.isNotNull(), F.try_divide(of("NUMERATOR"), below) * F.when(ratio.isin(*IN_PERCENT), 100).otherwise(1))
        .when(operation == "GROWTH", F.try_divide(last - first, first) * 100).when(operation == "AGGREGATE", F.avg(value)).otherwise(F.max(value))
    )


def expected(plans: DataFrame, facts: DataFrame, id_col: str = "question_id") -> DataFrame:
    """(id, target, output_year, value, unit, fact_ids, reason): every result computed from the facts, apart from any program.

    facts: (fact_id, company, scope, metric, year, value, unit). A requirement
    needs exactly one fact, else the reason is REFERENCE_INPUT_UNAVAILABLE; then
    UNIT_MISMATCH, ZERO_DENOMINATOR. Growth and averages are one result, of the last year.
    """
    needed = requirements(plans, id_col).join(plans.select(id_col, "operation", "ratio"), id_col)
    one = facts.groupBy("company", "scope", "metric", "year").agg(F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("fact_id", "value", "unit")])
    met = needed.join(one, ["company", "scope", "metric", "year"], "left")
    over_time = F.col("operation").isin("GROWTH", "AGGREGATE")
    out = met.groupBy(id_col, "target", F.when(~over_time, F.col("output_year")).alias("at"), "operation", "ratio").agg(
        result(F.col("operation"), F.col("ratio")).alias("value"), F.max("output_year").alias("output_year"), F.count_if(F.coalesce("rows", F.lit(0)) != 1).alias("_missing"), F.count_distinct("unit").alias("_units"), F.max("unit").alias("_unit"), F.array_sort(F.collect_set("fact_id")).alias("fact_ids")
    )  # of one question
    reason = F.when(F.col("_missing") > 0, "REFERENCE_INPUT_UNAVAILABLE").when(F.col("_units") > 1, "UNIT_MISMATCH").when(F.col("value").isNull(), "ZERO_DENOMINATOR")
    unit = F.when((F.col("operation") == "GROWTH") | F.col("ratio").isin(*IN_PERCENT), "PERCENT").when(F.col("ratio").isNotNull(), "TIMES").otherwise(F.col("_unit"))
    return out.select(id_col, "target", "output_year", F.when(reason.isNull(), F.col("value")).alias("value"), F.when(reason.isNull(), unit).alias("unit"), "fact_ids", reason.alias("reason"))


def facts_named(facts: DataFrame, plans: DataFrame, programs: DataFrame, id_col: str = "question_id") -> DataFrame:
    """The facts that the plans need or the programs read, all of a company, scope, metric and year; expected() and executed() tell the same from them.

    Facts meet one row a company and year, so that facts which are made by
    company and year are not dealt out once more.
    """
    key = ["company", "scope", "metric", "year"]
    who = plans.select(id_col, F.get("companies", 0).alias("company"), "scope")
    read = programs.filter("op <> 'COLLECT'").select(id_col, F.explode("inputs").alias("input")).select(id_col, *_place("input")).join(who, id_col)
    named = requirements(plans, id_col).select(key).union(read.select(key))
    wanted = named.groupBy("company", "year").agg(F.collect_set(F.struct("scope", "metric")).alias("_wanted"))  # of one vocabulary
    return facts.join(wanted.hint("shuffle_hash"), ["company", "year"]).filter(F.array_contains("_wanted", F.struct("scope", "metric"))).select(*facts.columns)


def _place(c: str) -> tuple[Column, Column]:
    """(metric, year) of an input metric@year."""
    return F.split_part(c, F.lit("@"), F.lit(1)).alias("metric"), F.split_part(c, F.lit("@"), F.lit(2)).cast("int").alias("year")


def executed(programs: DataFrame, plans: DataFrame, facts: DataFrame, id_col: str = "question_id") -> DataFrame:
    """(id, step, value, probe): the results of the programs' steps but COLLECT, over the facts, and over the facts' perturbed values.

    Inputs are read by their place, so that a program with its inputs in the wrong places shows.
    """
    who = plans.select(id_col, F.get("companies", 0).alias("company"), "scope")
    inputs = programs.filter("op <> 'COLLECT'").select(id_col, "step", "op", F.posexplode("inputs").alias("at", "input"))
    named = inputs.select("*", *_place("input")).join(who, id_col)
    met = named.join(facts.select("company", "scope", "metric", "year", F.col("value").cast("double").alias("value"), probe_of(facts).alias("probe")), ["company", "scope", "metric", "year"], "left")

    def run(c: str) -> Column:
        v = F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(c).alias("v")))), lambda x: x["v"])  # inputs of one step
        ratio = F.try_divide(F.get(v, 0), F.when(F.size(v) > 2, (F.get(v, 1) + F.get(v, 2)) / 2).otherwise(F.get(v, 1)))
        named_ratio = F.regexp_extract("op", "^FORMULA (.*)$", 1)
        growth = F.try_divide(F.get(v, 1) - F.get(v, 0), F.get(v, 0)) * 100
        average = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
        return F.when(F.col("op") == "IDENTITY", F.get(v, 0)).when(named_ratio == "GROWTH_RATE", growth).when(named_ratio == "AVERAGE", average).when(named_ratio.isin(*IN_PERCENT), ratio * 100).otherwise(ratio)

    return met.groupBy(id_col, "step", "op").agg(run("value").alias("value"), run("probe").alias("probe")).drop("op")


def probe_of(facts: DataFrame) -> Column:
    """A fact's value moved by its id, so that wrong inputs and coincidences show."""
    return S.perturb(F.col("value").cast("double"), F.pmod(F.xxhash64("fact_id"), F.lit(1000)))


def verified(answers: DataFrame, plans: DataFrame, facts: DataFrame, id_col: str = "question_id") -> DataFrame:
    """(id, passed, failed): the checks that each answer fails, in order, against results computed anew.

    answers: (id, value, unit, fact_ids, probe), one a question whose plan has
    one result; probe is the program's value over probe_of() facts. Checks:
    the reason of expected(); SOURCE_ROWS, the cited facts are the needed ones;
    RESULT_UNIT; FORMULA_RESULT; FORMULA_PROGRAM, the program agrees on moved
    values too. An answer without a plan fails as NO_PLAN.
    """
    want = expected(plans, facts, id_col)
    moved = expected(plans, facts.withColumn("value", probe_of(facts)), id_col)
    sizes = want.groupBy(id_col).agg(F.count("*").alias("_results"))
    both = want.join(moved.select(id_col, "target", "output_year", F.col("value").alias("_moved")), [id_col, "target", "output_year"]).join(sizes.filter("_results = 1"), id_col)
    renamed = both.select(id_col, F.col("value").alias("_value"), F.col("unit").alias("_unit"), F.col("fact_ids").alias("_ids"), "reason", "_moved", F.lit(True).alias("_planned"))
    a = answers.join(renamed, id_col, "left")
    same = lambda x, y: F.coalesce(S.relatively_close(x, y, 1e-9), F.lit(False))
    checks = [
        ("SOURCE_ROWS", F.coalesce(F.array_sort("fact_ids") == F.col("_ids"), F.lit(False))), ("RESULT_UNIT", F.col("unit").eqNullSafe(F.col("_unit"))),
        ("FORMULA_RESULT", same(F.col("value"), F.col("_value"))), ("FORMULA_PROGRAM", same(F.col("probe"), F.col("_moved"))),
    ]
    failed = F.filter(F.array(*[F.when(~ok, name) for name, ok in checks]), lambda x: x.isNotNull())
    told = F.when(F.col("_planned").isNull(), F.array(F.lit("NO_PLAN"))).when(F.col("reason").isNotNull(), F.array("reason")).otherwise(failed)
    return a.select(id_col, (F.size(told) == 0).alias("passed"), told.alias("failed"))
