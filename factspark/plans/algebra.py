"""A five-step table algebra and the three-step program over bound values.

Both are checked on the driver and become one lazy DataFrame plan.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import select_rows

#: Aggregate functions of GROUP.
FUNCTIONS = {"SUM": F.sum, "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}
FORMULAS = {"RATIO": "a / b * 100", "GROWTH_RATE": "(b - a) / a * 100", "DIFFERENCE": "a - b"}
MOST_STEPS, MOST_DEPTH = 256, 64


class PlanError(ValueError):
    """A plan that can't run; the code says why."""


@dataclass(frozen=True)
class Step:
    """One step: its operation and its arguments by name."""

    op: str
    args: dict = field(default_factory=dict)

    def fingerprint(self, before: str) -> str:
        return hashlib.sha256(json.dumps([before, self.op, self.args], sort_keys=True).encode()).hexdigest()


def run_steps(df: DataFrame, steps: list[Step]) -> tuple[DataFrame, list[tuple[int, str, str, str]]]:
    """The lazy result, and a history row (step, operation, fingerprint before, after) for each step."""
    if len(steps) > MOST_STEPS:
        raise PlanError("TOO_MANY_STEPS")
    mark, history = hashlib.sha256(",".join(df.columns).encode()).hexdigest(), []
    for i, step in enumerate(steps):
        df = _applied(df, step)
        after = step.fingerprint(mark)
        history.append((i, step.op, mark, after))
        mark = after
    return df, history


def _applied(df: DataFrame, step: Step) -> DataFrame:
    a = step.args

    def there(*names: str) -> None:
        if missing := [n for n in names if n not in df.columns]:
            raise PlanError(f"UNKNOWN_COLUMN: {missing[0]}")

    if step.op == "SELECT_ROWS":
        there(a["column"])
        return select_rows(df, **{a["column"]: a["values"]})
    if step.op == "SELECT_COLUMNS":
        there(*a["columns"])
        if len(set(a["columns"])) < len(a["columns"]):
            raise PlanError("DUPLICATE_COLUMN")
        return df.select(*a["columns"])
    if step.op == "ADD_DERIVED_COLUMN":
        there(*a["inputs"])
        if a["name"] in df.columns:
            raise PlanError(f"DUPLICATE_COLUMN: {a['name']}")
        if a["formula"] not in FORMULAS:
            raise PlanError(f"UNKNOWN_FORMULA: {a['formula']}")
        left, right = (f"cast(`{c}` as double)" for c in a["inputs"])
        text = {"RATIO": f"try_divide({left}, {right}) * 100", "GROWTH_RATE": f"try_divide({right} - {left}, {left}) * 100", "DIFFERENCE": f"{left} - {right}"}
        return df.withColumn(a["name"], F.expr(text[a["formula"]]))
    if step.op == "GROUP":
        there(a["by"], a["agg"])
        if a["function"] not in FUNCTIONS:
            raise PlanError(f"UNKNOWN_FUNCTION: {a['function']}")
        return df.groupBy(a["by"]).agg(FUNCTIONS[a["function"]](a["agg"]).alias(a["agg"]))
    if step.op == "SORT":
        there(a["by"])
        key = F.col(a["by"]).cast("string")
        return df.orderBy(key.desc() if a.get("descending") else key.asc(), *([F.col(a["tie"]).desc() if a.get("descending") else F.col(a["tie"])] if "tie" in a else []))
    raise PlanError(f"UNKNOWN_OPERATION: {step.op}")


def plan(columns: list[str], want: dict) -> list[Step]:
    """The bounded plan for a wish: rows, then columns, then a derived column, then a group. Parts that aren't wished for are left out."""
    steps = []
    if "rows" in want:
        steps.append(Step("SELECT_ROWS", want["rows"]))
    need = [c for c in columns if c in {*want.get("keep", columns), *want.get("derive", {}).get("inputs", ()), *want.get("group", {}).values()}]
    if need != columns:
        steps.append(Step("SELECT_COLUMNS", {"columns": need}))
    if "derive" in want:
        steps.append(Step("ADD_DERIVED_COLUMN", want["derive"]))
    if "group" in want:
        steps.append(Step("GROUP", want["group"]))
    return steps


@dataclass(frozen=True)
class Node:
    """IDENTITY, COLLECT or FORMULA over names of inputs or earlier nodes."""

    name: str
    op: str
    refs: tuple[str, ...]
    formula: str | None = None


def validate(inputs: list[str], nodes: list[Node], output: str) -> None:
    """Raise PlanError unless references are known and acyclic, arities fit, every input is used and limits hold."""
    if len(inputs) > MOST_STEPS or len(nodes) > MOST_STEPS:
        raise PlanError("TOO_LARGE")
    depth = dict.fromkeys(inputs, 0)
    used: set[str] = set()
    for node in nodes:
        if node.name in depth:
            raise PlanError(f"DUPLICATE_NAME: {node.name}")
        if unknown := [r for r in node.refs if r not in depth]:
            raise PlanError(f"UNKNOWN_REFERENCE: {unknown[0]}")  # also what a cycle comes to
        arity = {"IDENTITY": 1, "FORMULA": 2}.get(node.op)
        if node.op not in ("IDENTITY", "COLLECT", "FORMULA") or (arity and len(node.refs) != arity) or not node.refs:
            raise PlanError(f"BAD_STEP: {node.name}")
        if node.op == "FORMULA" and node.formula not in FORMULAS:
            raise PlanError(f"UNKNOWN_FORMULA: {node.formula}")
        depth[node.name] = 1 + max(depth[r] for r in node.refs)
        used |= set(node.refs)
    if output not in depth or max(depth.values(), default=0) > MOST_DEPTH:
        raise PlanError("BAD_OUTPUT")
    if unused := [i for i in inputs if i not in used and i != output]:
        raise PlanError(f"UNUSED_INPUT: {unused[0]}")


def run_program(values: DataFrame, inputs: list[str], nodes: list[Node], output: str) -> DataFrame:
    """Rows with column result: the program over the named columns of each row. A zero denominator gives null.

    All inputs must have one unit (column unit_<name>, if there), else result is null and status UNIT_MISMATCH.
    """
    validate(inputs, nodes, output)
    made = {name: F.col(name).cast("double") for name in inputs}
    for node in nodes:
        refs = [made[r] for r in node.refs]
        if node.op == "IDENTITY":
            made[node.name] = refs[0]
        elif node.op == "COLLECT":
            made[node.name] = F.array(*refs)
        else:
            a, b = refs
            made[node.name] = {"RATIO": F.try_divide(a, b) * 100, "GROWTH_RATE": F.try_divide(b - a, a) * 100, "DIFFERENCE": a - b}[node.formula]
    units = [f"unit_{i}" for i in inputs if f"unit_{i}" in values.columns]
    same = F.size(F.array_distinct(F.array(*units))) == 1 if units else F.lit(True)
    return values.withColumn("status", F.when(same, "OK").otherwise("UNIT_MISMATCH")).withColumn("result", F.when(same, made[output]))


#: What a failed check leads to, by category.
RETRIES = (("GROUNDING", "RETRY_RETRIEVAL"), ("SUPPORT", "RETRY_RETRIEVAL"), ("NUMERIC", "RETRY_PROGRAMMER"), ("SCALE_UNIT", "RETRY_PROGRAMMER"), ("LOGIC", "RETRY_PROGRAMMER"), ("POLICY", "ABSTAIN"))


def retry_action(failures: DataFrame, most: int = 2) -> DataFrame:
    """Failures (category, attempt) with their action; ABSTAIN after `most` attempts, and an unknown category is an error."""
    policy = failures.sparkSession.createDataFrame(RETRIES, "category string, action string")
    known = failures.join(F.broadcast(policy), "category", "left")  # six rows
    unknown = F.raise_error(F.concat(F.lit("unknown category "), F.col("category")))
    return known.withColumn("action", F.when(F.col("attempt") >= most, "ABSTAIN").otherwise(F.coalesce("action", unknown.cast("string"))))


def profile(requests: DataFrame) -> DataFrame:
    """LIGHT for one requirement of a lookup without a formula, else FULL."""
    light = (F.col("operation") == "LOOKUP") & (F.col("requirements") == 1) & F.col("formula").isNull()
    return requests.withColumn("profile", F.when(F.coalesce(light, F.lit(False)), "LIGHT").otherwise("FULL"))


def grounding(cited: DataFrame, cells: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, check, passed): a row for each field of a citation that must equal the cell's, and one that the cell is there."""
    there = cells.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    checks = [F.struct(F.lit("EXISTS").alias("check"), F.col("_there").isNotNull().alias("passed"))]
    checks += [F.struct(F.lit(f.upper()).alias("check"), (F.col(f).eqNullSafe(F.col(f"_{f}")) & F.col("_there").isNotNull()).alias("passed")) for f in fields]
    return cited.join(there, key, "left").select(key, F.explode(F.array(*checks)).alias("c")).select(key, "c.check", "c.passed")
