"""Declarations of scale and unit with their places in the text, and the tables whose window they stand in."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .documents import table_ranges

#: Characters before a table that may declare its unit.
WINDOW = 1200
# Words, without marks, that scale a unit, and the unit's names.
SCALE_WORDS = {"trieu": "MILLION", "nghin": "THOUSAND", "ngan": "THOUSAND", "ty": "BILLION"}
UNIT_WORDS = ("vnd", "dong")
HINT = "array<struct<first: int, last: int, raw: string, scale: string>>"


class _Bases(dict):
    """What plain() makes of a character, by its number; found once for each character of a worker's texts."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0].lower()
        self[code] = "d" if base == "đ" else base if len(base) == 1 else c
        return self[code]


_BASES = _Bases()


def plain(text: str) -> str:
    """Lower case without marks, character by character, so that places hold."""
    return text.translate(_BASES)


def declarations(text: str) -> list[dict]:
    """Places of declared units: a label, a scale or none, a currency; a rate, as in VND/share, is none.

    [first, last) spans scale and currency in the text as it is.
    """
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[a-z]+|[:/]", plain(text))]
    out = []
    for i, (word, _, _) in enumerate(words):
        at = i + 1 if word == "dvt" else i + 2 if word == "don" and [w for w, _, _ in words[i + 1 : i + 2]] == ["vi"] else None
        if at is None:
            continue
        while at < len(words) and words[at][0] in ("tinh", ":", "tien", "te"):
            at += 1
        scaled = at < len(words) and words[at][0] in SCALE_WORDS
        unit = at + 1 if scaled else at
        if unit < len(words) and words[unit][0] in UNIT_WORDS and not (unit + 1 < len(words) and words[unit + 1][0] == "/"):
            first, last = words[at][1], words[unit][2]
            out.append({"first": first, "last": last, "raw": text[first:last], "scale": SCALE_WORDS[words[at][0]] if scaled else "RAW"})
    return out


def _hints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: declarations(x or ""))


def unit_hints(texts: DataFrame, text_col: str) -> DataFrame:
    """texts, a row for each declaration, with first, last, raw and scale; the text itself is left out."""
    keys = [c for c in texts.columns if c != text_col]
    return texts.select(*keys, F.explode(F.pandas_udf(_hints, HINT)(text_col)).alias("h")).select(*keys, "h.*")


def _ranges(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: [{"first": a, "last": b} for a, b, *_ in table_ranges(x or "")])


def table_spans(texts: DataFrame, text_col: str) -> DataFrame:
    """texts, a row for each table in them, with table_index, first and last; the text itself is left out."""
    keys = [c for c in texts.columns if c != text_col]
    spans = F.pandas_udf(_ranges, "array<struct<first: int, last: int>>")(text_col)
    return texts.select(*keys, F.posexplode(spans).alias("table_index", "s")).select(*keys, "table_index", "s.*")


def in_windows(tables: DataFrame, spans: DataFrame, page: list[str], most: int = WINDOW) -> DataFrame:
    """spans with the table_index of the table whose window holds them whole; others are left out.

    A table's window is what stands before it on its page, `most` characters at
    most, back to the end of the table before. Windows don't overlap, so that
    each span belongs to the next table's or to none: one sort a page in place of
    a join of intervals. Nested or overlapping tables count by their outer ends.
    """
    names = [c for c in spans.columns if c not in page]
    order = W.partitionBy(*page).orderBy("first")
    bounds = tables.withColumn("_from", F.greatest(F.coalesce(F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), F.col("first") - most))
    both = bounds.select(*page, F.col("first").alias("_at"), F.lit(1).alias("_kind"), F.struct("table_index", "first", "_from").alias("_table"), F.lit(None).cast(spans.select(F.struct(*names).alias("x")).schema["x"].dataType).alias("_span"))
    both = both.unionByName(spans.select(*page, F.col("last").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(both.schema["_table"].dataType).alias("_table"), F.struct(*names).alias("_span")))
    ahead = W.partitionBy(*page).orderBy("_at", "_kind").rowsBetween(0, W.unboundedFollowing)
    met = both.withColumn("_next", F.first("_table", ignorenulls=True).over(ahead)).filter("_span IS NOT NULL AND _span.first >= _next._from")
    return met.select(*page, "_next.table_index", "_span.*")
