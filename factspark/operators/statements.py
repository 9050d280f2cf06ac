"""Rules over statement lines and metrics in long form; every one a lazy plan.

Metrics are rows (ticker, fiscal_year, scope, metric, value); lines are rows
(report_id, statement, code, col, value, unit), col being current or prior.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["ticker", "fiscal_year", "scope"]
#: Ratio, numerator, denominator, whether the denominator is the mean of opening and closing, multiplier.
RATIOS = (
    ("ROE", "LNST", "EQUITY", True, 100),
    ("ROA", "LNST", "TOTAL_ASSETS", True, 100),
    ("GROSS_MARGIN", "GROSS_PROFIT", "NET_REVENUE", False, 100),
    ("NET_MARGIN", "LNST", "NET_REVENUE", False, 100),
    ("DEBT_TO_EQUITY", "LIABILITIES", "EQUITY", False, 1),
    ("CURRENT_RATIO", "CURRENT_ASSETS", "CURRENT_LIABILITIES", False, 1),
)
#: Total line, and the lines that add up to it; a minus subtracts. B01 balance sheet, B02 income, B03 cash flow.
IDENTITIES = (
    "B01 100 = 110 120 130 140 150",
    "B01 200 = 210 220 230 240 250 260",
    "B01 270 = 100 200",
    "B01 300 = 310 330",
    "B01 400 = 410 430",
    "B01 440 = 300 400",
    "B01 270 = 440",
    "B02 10 = 01 -02",
    "B02 20 = 10 -11",
    "B02 30 = 20 21 -22 24 -25 -26",
    "B02 40 = 31 -32",
    "B02 50 = 30 40",
    "B02 60 = 50 -51 -52",
    "B02 60 = 61 62",
    "B03 50 = 20 30 40",
    "B03 70 = 50 60 61",
    "B03 70 = B01:110",
    "B03 60 = B01:110:prior",
)
#: Expense lines whose sign is a matter of print, and those that tell the habit.
EXPENSES = ("02", "11", "22", "25", "26", "32", "51", "52")
PROBES = ("11", "22", "25", "26")
#: The quality checks, a total and its signed parts.
QUALITY = (
    ("balance_sheet", "TOTAL_CAPITAL", {"TOTAL_ASSETS": 1}),
    ("liabilities_equity", "TOTAL_CAPITAL", {"LIABILITIES": 1, "EQUITY": 1}),
    ("income_tax", "LNST", {"PROFIT_BEFORE_TAX": 1, "CURRENT_TAX": -1, "DEFERRED_TAX": -1}),
    ("lnst_split", "LNST", {"LNST_PARENT": 1, "LNST_MINORITY": 1}),
    ("gross_profit", "GROSS_PROFIT", {"NET_REVENUE": 1, "COGS": -1}),
)


def ratios(metrics: DataFrame) -> DataFrame:
    """(key, ratio, value) for all six; null without an input, or with a denominator of zero; gaps in years are no opening."""
    names = sorted({m for _, a, b, _, _ in RATIOS for m in (a, b)})
    wide = metrics.groupBy(*KEY).pivot("metric", names).agg(F.max("value"))
    order = W.partitionBy("ticker", "scope").orderBy("fiscal_year")
    before = F.lag("fiscal_year").over(order) == F.col("fiscal_year") - 1
    opening = {m: F.when(before, F.lag(m).over(order)) for m in ("EQUITY", "TOTAL_ASSETS")}
    wide = wide.select("*", *[c.alias(f"{m}_opening") for m, c in opening.items()])

    def one(name: str, top: str, bottom: str, mean: bool, factor: int) -> Column:
        base = (F.col(bottom) + F.col(f"{bottom}_opening")) / 2 if mean else F.col(bottom)
        return F.struct(F.lit(name).alias("ratio"), (F.try_divide(F.col(top).cast("double"), base.cast("double")) * factor).alias("value"))

    return wide.select(*KEY, F.explode(F.array(*[one(*r) for r in RATIOS])).alias("r")).select(*KEY, "r.ratio", "r.value")


def identity_terms() -> list[tuple[str, str, str, str, int, str | None]]:
    """IDENTITIES as rows: name, column checked, statement, code, sign (0 for the total), column read."""
    out = []
    for text in IDENTITIES:
        left, right = text.split(" = ")
        form, total = left.split()
        for col in ("current",) if right.endswith(":prior") else ("current", "prior"):
            out.append((text, col, form, total, 0, col))
            for part in right.split():
                bits = part.lstrip("-").split(":")
                where, code = (bits[0], bits[1]) if len(bits) > 1 else (form, bits[0])
                out.append((text, col, where, code, -1 if part[0] == "-" else 1, bits[2] if len(bits) > 2 else col))
    return out


def as_costs(lines: DataFrame) -> DataFrame:
    """Lines with expense lines as positive costs in reports that print most of the non-zero probes as negatives."""
    probe = (F.col("statement") == "B02") & F.col("code").isin(*PROBES) & (F.col("col") == "current") & (F.col("value") != 0)
    habit = lines.filter(probe).groupBy("report_id").agg((F.count_if(F.col("value") < 0) * 2 > F.count("*")).alias("flipped")).filter("flipped")
    turn = F.col("flipped").isNotNull() & (F.col("statement") == "B02") & F.col("code").isin(*EXPENSES)
    return lines.join(habit.hint("merge"), "report_id", "left").withColumn("value", F.when(turn, -F.col("value")).otherwise(F.col("value"))).drop("flipped")


def check_identities(lines: DataFrame) -> DataFrame:
    """(report_id, identity, col, status) of all identities; within two units and 1e-9 of the total is PASS.

    An absent part counts as zero; MISSING without the total or without any part.
    """
    rules = lines.sparkSession.createDataFrame(identity_terms(), "identity string, checked string, statement string, code string, sign int, col string")
    names = [F.struct(F.lit(i).alias("identity"), F.lit(c).alias("checked")) for i, c in sorted({(i, c) for i, c, *_ in identity_terms()})]
    met = as_costs(lines).join(F.broadcast(rules), ["statement", "code", "col"], "left")  # 35 checks of at most eight terms
    total, part = F.col("sign") == 0, F.col("sign") != 0
    sums = met.groupBy("report_id", "identity", "checked").agg(
        F.max(F.when(total, F.col("value"))).alias("total"), F.sum(F.when(part, F.col("sign") * F.col("value"))).alias("parts"), F.max("unit").alias("unit")
    )
    off = F.abs(F.col("parts") - F.col("total"))
    status = F.when(F.col("total").isNull() | F.col("parts").isNull(), "MISSING").when(off <= 2 * F.col("unit") + F.abs(F.col("total")) * 1e-9, "PASS").otherwise("FAIL")
    # the few checks of one report in one row, so that those without lines need no join of every report with every check
    told = sums.groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("identity").isNotNull(), F.struct(F.struct("identity", "checked"), status.alias("status"))))).alias("m"))
    every = told.select("report_id", "m", F.explode(F.array(*names)).alias("n"))
    return every.select("report_id", "n.identity", F.col("n.checked").alias("col"), F.coalesce(F.try_element_at("m", "n"), F.lit("MISSING")).alias("status"))


def guard(metrics: DataFrame, rules: Sequence[tuple[str, str, dict[str, int]]] = QUALITY, unit: float = 1.0) -> DataFrame:
    """Metrics without those of a failed identity that no passing identity of the same key holds as well."""
    wide = metrics.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))  # a key has some forty metrics
    get = lambda name: F.col("m")[name]

    def verdict(total: str, parts: dict[str, int]) -> Column:
        off = F.abs(reduce(Column.__add__, [get(p) * s for p, s in parts.items()]) - get(total))
        return off <= 2 * unit + F.abs(get(total)) * 1e-9

    none = F.array().cast("array<string>")
    names = lambda ok: F.flatten(F.array(*[F.when(verdict(t, p) == ok, F.array(*map(F.lit, (t, *p)))).otherwise(none) for _, t, p in rules]))
    judged = wide.select(*KEY, F.array_except(names(F.lit(False)), names(F.lit(True))).alias("bad"))
    cleared = judged.select(*KEY, F.explode("bad").alias("metric"))
    return metrics.join(cleared, [*KEY, "metric"], "left_anti")


def quality(metrics: DataFrame) -> DataFrame:
    """(name, checked, passed, failed, pass_rate) of the quality checks over keys that have all their metrics."""
    names = sorted({m for _, t, p in QUALITY for m in (t, *p)})
    wide = metrics.groupBy(*KEY).pivot("metric", names).agg(F.max("value"))
    cells = []
    for name, total, parts in QUALITY:
        off = F.abs(reduce(Column.__add__, [F.col(p) * s for p, s in parts.items()]) - F.col(total))
        ok = off <= F.greatest(F.lit(1.0), F.abs(F.col(total)) * 1e-9)
        cells.append(F.struct(F.lit(name).alias("name"), F.count(ok.cast("int")).alias("checked"), F.count_if(ok).alias("passed")))
    rows = wide.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return rows.select("name", "checked", "passed", (F.col("checked") - F.col("passed")).alias("failed"), F.round(F.try_divide("passed", "checked"), 4).alias("pass_rate"))


def resolve_metrics(facts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key: rows that agree keep one; where only the coded rows agree, the others go; else all go.

    Kept is a coded row that is no carry-over of a page, then any coded one, then
    any that is no carry-over, then the first. Columns: value, line_code, carried.
    """
    every = W.partitionBy(*keys)
    kinds = F.size(F.collect_set("value").over(every))
    coded = F.size(F.collect_set(F.when(F.col("line_code").isNotNull(), F.col("value"))).over(every))
    seen = facts.withColumn("_kinds", kinds).withColumn("_coded", coded)
    fit = seen.filter((F.col("_kinds") == 1) | ((F.col("_coded") == 1) & F.col("line_code").isNotNull()))
    rank = F.row_number().over(every.orderBy(F.col("line_code").isNull(), "carried", order))
    return fit.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_kinds", "_coded")


def sum_years(metrics: DataFrame, years: Sequence[int]) -> DataFrame:
    """(ticker, scope, metric, total) over exactly the years; null unless each is there."""
    wanted = metrics.filter(F.col("fiscal_year").isin(*years))
    return wanted.groupBy("ticker", "scope", "metric").agg(F.when(F.countDistinct("fiscal_year") == len(set(years)), F.sum("value")).alias("total"))


def mean_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status, mean) of value: at least two inputs, one unit; PERCENT doesn't mix with amounts."""
    agg = rows.groupBy(*keys).agg(F.count("value").alias("n"), F.size(F.collect_set(F.coalesce("unit", F.lit("")))).alias("units"), F.avg("value").alias("mean"))
    status = F.when(F.col("n") < 2, "TOO_FEW").when(F.col("units") > 1, "UNIT_MISMATCH").otherwise("OK")
    return agg.select(*keys, status.alias("status"), F.when(status == "OK", F.col("mean")).alias("mean"))


def confirm_by_next_year(values: DataFrame) -> DataFrame:
    """Each (ticker, scope, metric, fiscal_year, value) with what the next report's prior column says of it."""
    later = values.select("ticker", "scope", "metric", (F.col("fiscal_year") - 1).alias("fiscal_year"), F.col("prior").alias("said"), F.lit(True).alias("there"))
    joined = values.join(later, ["ticker", "scope", "metric", "fiscal_year"], "left")
    status = F.when(F.col("there").isNull(), "NO_NEXT_YEAR_VALUE").when(F.col("said").eqNullSafe(F.col("value")), "CONFIRMED").otherwise("RESTATED_IN_NEXT_REPORT")
    return joined.select("ticker", "scope", "metric", "fiscal_year", "value", status.alias("status"))


def table_scale(hints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, scale, basis): a magnitude beats RAW, two magnitudes are ambiguous. Hints hold key and scale."""
    found = hints.groupBy(*keys).agg(F.collect_set(F.when(F.col("scale") != "RAW", F.col("scale"))).alias("m"), F.bool_or(F.col("scale") == "RAW").alias("raw"))
    scale = F.when(F.size("m") == 1, F.col("m")[0]).when((F.size("m") == 0) & F.col("raw"), "RAW")
    return found.select(*keys, scale.alias("scale"), F.when(F.size("m") > 1, "AMBIGUOUS").when(scale.isNull(), "NONE").otherwise("UNIT_HINT").alias("basis"))


def resolve_scale(hints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status, scale, unit) from hints (level, scale, unit): the lowest level wins.

    AMBIGUOUS if that level holds two scales or units, or if RAW and a magnitude
    are said at any level; UNRESOLVED without any scale or unit.
    """
    clue = F.col("scale").isNotNull() | F.col("unit").isNotNull()
    marked = hints.withColumn("_best", F.min(F.when(clue, F.col("level"))).over(W.partitionBy(*keys)))
    top = F.col("level") == F.col("_best")
    found = marked.groupBy(*keys).agg(
        F.collect_set(F.when(top, F.col("scale"))).alias("s"), F.collect_set(F.when(top, F.col("unit"))).alias("u"),
        (F.coalesce(F.bool_or(F.col("scale") == "RAW"), F.lit(False)) & F.coalesce(F.bool_or(F.col("scale").isin("THOUSAND", "MILLION", "BILLION")), F.lit(False))).alias("clash"),
        F.max("_best").alias("best"),
    )
    status = F.when(F.col("best").isNull(), "UNRESOLVED").when((F.size("s") > 1) | (F.size("u") > 1) | F.col("clash"), "AMBIGUOUS").otherwise("RESOLVED")
    only = lambda c: F.when((status == "RESOLVED") & (F.size(c) == 1), F.col(c)[0])
    return found.select(*keys, status.alias("status"), only("s").alias("scale"), only("u").alias("unit"))


def companies(reports: DataFrame, banks: DataFrame) -> DataFrame:
    """One row a ticker: commonest name (ties to the first by name), template, first and last year, sorted scopes."""
    names = reports.groupBy("ticker", "company_name").agg(F.count("*").alias("n"), F.min("fiscal_year").alias("a"), F.max("fiscal_year").alias("b"), F.collect_set("scope").alias("s"))
    best = F.min_by("company_name", F.struct(-F.col("n"), "company_name"))
    rows = names.groupBy("ticker").agg(best.alias("company_name"), F.min("a").alias("first_year"), F.max("b").alias("last_year"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))), ",").alias("statement_scopes"))
    flagged = rows.join(banks.select("ticker").distinct().withColumn("_bank", F.lit(True)), "ticker", "left")
    return flagged.select("ticker", "company_name", F.when(F.col("_bank"), "BANK").otherwise("CORPORATE").alias("template"), "first_year", "last_year", "statement_scopes")


def note_as_value(value: Column, scale: Column, shifted: Column) -> Column:
    """Whether a figure is a note's number that stands in the amount column: 1 to 3 digits, shifted, or unscaled and below 1,000."""
    small = (F.abs(value) < 1000) & (value != 0)
    return F.coalesce(small & (shifted | (scale == "RAW")), F.lit(False))


def content_class(rows: DataFrame, table: str) -> DataFrame:
    """(table, class): a table without a titled class takes the one that at least two of its coded rows name, if only one does."""
    counted = rows.filter(F.col("named").isNotNull()).groupBy(table, "named").agg(F.count("*").alias("n")).filter("n >= 2")
    found = counted.groupBy(table).agg(F.count("*").alias("k"), F.min("named").alias("named")).filter("k = 1")
    titled = rows.groupBy(table).agg(F.max("titled").alias("titled"))
    return titled.join(found, table, "left").select(table, F.coalesce("titled", "named").alias("class"))
