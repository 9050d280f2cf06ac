"""From raw report text to pages, tables, cells, grids and facts.

Pages and paragraphs are split by JVM expressions; tables need a tag scanner, so
that step runs as mapInArrow over one page a row.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the line that starts a page.
PAGE = r"(?m)^===== PAGE ([0-9]+) =====[ \t]*$"
MOST_SPAN = 1000


def pages(reports: DataFrame) -> DataFrame:
    """(report_id, page_index, page_number, content, issues) of reports (report_id, raw_text).

    Issues: DUPLICATE_PAGE_NUMBER, NON_MONOTONIC_PAGE_NUMBER. Page numbers below
    one make no page; a report without a marker has none.
    """
    parts = F.slice(F.split("raw_text", PAGE), 2, 1_000_000)
    numbers = F.transform(F.regexp_extract_all("raw_text", F.lit(PAGE), 1), lambda n: n.cast("int"))
    split = reports.select("report_id", F.posexplode(F.arrays_zip(numbers.alias("n"), parts.alias("t")))).select("report_id", F.col("pos").alias("at"), F.col("col.n").alias("page_number"), F.col("col.t").alias("content"))
    order = W.partitionBy("report_id").orderBy("at")
    split = split.filter("page_number >= 1")
    again = F.row_number().over(W.partitionBy("report_id", "page_number").orderBy("at")) > 1
    back = F.col("page_number") <= F.lag("page_number").over(order)
    issues = F.filter(F.array(F.when(again, "DUPLICATE_PAGE_NUMBER"), F.when(back, "NON_MONOTONIC_PAGE_NUMBER")), lambda x: x.isNotNull())
    return split.select("report_id", (F.row_number().over(order) - 1).alias("page_index"), "page_number", "content", issues.alias("issues"))


def table_ranges(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, closed) of the outermost tables; quotes may hold '>', and an unclosed table ends where the next begins or the text does."""
    out, depth, begin = [], 0, 0
    for tag in re.finditer(r"""<\s*(/?)\s*table\b(?:[^>"']|"[^"]*"|'[^']*')*>""", text, re.I):
        if not tag[1]:
            if depth == 0:
                begin = tag.start()
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append((begin, tag.end(), True))
    if depth:
        out.append((begin, len(text), False))
    return out


class _Cells(HTMLParser):
    """Cells of one table in source order: (row, text, rowspan, colspan, header)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[list] = []
        self.row, self.depth, self.open, self.issues = -1, 0, False, []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.row, self.open = self.row + 1, False
        elif self.depth == 1 and tag in ("td", "th"):
            if self.row < 0:
                self.row = 0
            given = dict(attrs)
            self.cells.append([self.row, "", self._span(given.get("rowspan")), self._span(given.get("colspan")), tag == "th"])
            self.open = True
        elif tag == "br" and self.open:
            self.cells[-1][1] += "\n"

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        if self.depth <= 1 and tag in ("td", "th", "tr", "table"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.cells[-1][1] += data

    def _span(self, raw: str | None) -> int:
        if raw is None:
            return 1
        if not raw.strip().isdigit() or not 1 <= int(raw) <= MOST_SPAN:
            self.issues.append("INVALID_SPAN")
            return 1
        return int(raw)


class Overlap(ValueError):
    """Spans of a table overlap."""


class NotPlain(ValueError):
    """A table has what only the parser reads."""


def placed(cells: Iterable[list]) -> Iterator[tuple[int, int, int, list, bool]]:
    """(row, column, number of the cell, cell, header) of every slot, by row and column.

    Cells come row by row, go to the first free column of their row and cover
    their spans; only rows that spans reach into are held. header: all cells that
    begin in the row are header cells. Raises Overlap where spans overlap.
    """
    below: dict[int, dict[int, tuple[int, list]]] = {}
    number, last = 0, -1
    for row, group in groupby(cells, itemgetter(0)):
        for r in range(last + 1, row) if below else ():
            yield from ((r, c, *x, False) for c, x in sorted(below.pop(r, {}).items()))
        own, last = list(group), row
        head = all(cell[4] for cell in own)
        taken = below.pop(row, {})
        if not taken and all(cell[2] == cell[3] == 1 for cell in own):
            for c, cell in enumerate(own):
                yield row, c, number + c, cell, head
            number += len(own)
            continue
        column = 0
        for cell in own:
            while column in taken:
                column += 1
            for r in range(row, row + cell[2]):
                line = taken if r == row else below.setdefault(r, {})
                for c in range(column, column + cell[3]):
                    if c in line:
                        raise Overlap
                    line[c] = number, cell
            number += 1
        yield from ((row, c, *x, head) for c, x in sorted(taken.items()))
    for r in sorted(below):
        yield from ((r, c, *x, False) for c, x in sorted(below[r].items()))


#: Tags of a table that is read without the parser: closed, not nested, in lower case, its spans plain numbers, its texts without references.
TAG = re.compile(r"""<(/?)(table|tr|td|th)((?: [a-z]+(?:=(?:[0-9]+|"[^"<&\s]*"))?)*)>""")
SPANS = re.compile(r"""(?<= )(rowspan|colspan)(?:=(?:([0-9]+)|"([^"]*)"))?(?= |$)""")
#: Characters that are read at a time; a table of more is read twice, so that its cells are never held at once.
PIECE = 1 << 18


def _tags(text: str) -> Iterator[tuple[str, str, str, str]]:
    """(close, tag, attributes, text up to the next tag) of a plain table. No tag holds a second '<', so pieces end before one."""
    at = 0
    while at < len(text):
        end = text.find("<", at + PIECE)
        end = len(text) if end < 0 else end
        parts = TAG.split(text[at:end])
        data = "".join(parts[::4])
        if parts[0] or "<" in data or "&" in data:
            raise NotPlain
        yield from zip(parts[1::4], parts[2::4], parts[3::4], parts[4::4])
        at = end


def _plain(text: str) -> Iterator[list]:
    """What _Cells reads from a plain table, faster; raises NotPlain for any other, at the latest at its end."""
    tags = _tags(text)
    if next(tags, ("", ""))[:2] != ("", "table"):
        raise NotPlain
    row, ended = -1, False
    for close, tag, given, inside in tags:
        if ended:
            raise NotPlain
        if tag == "table":
            if not close or inside:
                raise NotPlain
            ended = True
        elif close:
            if given or inside.strip():
                raise NotPlain
        elif tag == "tr":
            row += 1
            if inside.strip():
                raise NotPlain
        else:
            row = max(row, 0)
            down = across = 1
            if given:
                for name, number, quoted in SPANS.findall(given):
                    number = number or quoted
                    if not number.isascii() or not number.isdigit() or not 1 <= int(number) <= MOST_SPAN:
                        raise NotPlain
                    down, across = (int(number), across) if name == "rowspan" else (down, int(number))
            yield [row, inside, down, across, tag == "th"]
    if not ended:
        raise NotPlain


def plain_cells(text: str) -> list[list] | None:
    """The cells of a plain table; None for any other."""
    try:
        return list(_plain(text))
    except NotPlain:
        return None


#: Slots that the parser gives on at once.
SLOTS_A_BATCH = 20_000


def _cells_of(text: str, closed: bool) -> tuple[str, list[list]]:
    """(status, cells) of one table."""
    cells = plain_cells(text) if closed else None
    if cells is not None:
        return "PARSED", cells
    parser = _Cells()
    parser.feed(text)
    parser.close()
    return "RECOVERED" if parser.issues or not closed else "PARSED", parser.cells


def _by_parser(text: str, parser: _Cells) -> Iterator[list]:
    """The parser's cells; only the last one can still get text from what follows."""
    for at in range(0, len(text), PIECE):
        parser.feed(text[at : at + PIECE])
        done, parser.cells = parser.cells[:-1], parser.cells[-1:]
        yield from done
    parser.close()
    yield from parser.cells


def _placed_of(text: str, closed: bool) -> tuple[str, Iterable[tuple[int, int, int, list, bool]]]:
    """(status, slots) of one table; none where spans overlap, which is known at its end only."""
    try:
        if len(text) <= PIECE:
            status, cells = _cells_of(text, closed)
            return status, list(placed(cells))
        if closed:
            try:
                deque(placed(_plain(text)), 0)
                return "PARSED", placed(_plain(text))
            except NotPlain:
                pass
        parser = _Cells()
        deque(placed(_by_parser(text, parser)), 0)
        return "RECOVERED" if parser.issues or not closed else "PARSED", placed(_by_parser(text, _Cells()))
    except Overlap:
        return "", ()


def _slots_of(text: str, closed: bool) -> Iterator[tuple[str, int, int, int, str, bool, bool]]:
    """(status, row, column, cell, text, header, anchor) of the slots of one table."""
    status, found = _placed_of(text, closed)
    for r, c, i, cell, head in found:
        yield status, r, c, i, cell[1], head, r == cell[0]


def _spans_of(text: str, closed: bool) -> Iterator[tuple[int, int, int, int, int, str]]:
    """(cell, row, column, down, across, text) of the cells of one table."""
    after = 0
    for r, c, i, cell, _ in _placed_of(text, closed)[1]:
        if i == after:  # its first slot
            yield i, r, c, cell[2], cell[3], cell[1]
            after += 1


SLOTS = "report_id string, page_index int, table_index int, status string, grid_row int, grid_column int, cell int, text string, header boolean, anchor boolean"


ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def _parsed(batches: Iterator[pa.RecordBatch], rows_of=_slots_of, names: str = SLOTS) -> Iterator[pa.RecordBatch]:
    """A page is a Python text only while it is parsed, and its rows go on in parts."""
    schema = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in names.split(", ")])
    out: list[tuple] = []
    for batch in batches:
        for report, page, content in zip(*(batch.column(c) for c in ("report_id", "page_index", "content"))):
            report, page, text = report.as_py(), page.as_py(), content.as_py()
            for number, (start, end, closed) in enumerate(table_ranges(text)):
                for row in rows_of(text[start:end], closed):
                    out.append((report, page, number, *row))
                    if len(out) == SLOTS_A_BATCH:
                        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                        out = []
    if out:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


CELLS = "report_id string, page_index int, table_index int, cell int, row int, column int, down int, across int, text string"


def _tables(paged: DataFrame) -> DataFrame:
    return paged.filter(F.col("content").rlike("(?i)<\\s*table")).select(F.col("report_id").cast("string").alias("report_id"), "page_index", "content")


def slots(paged: DataFrame) -> DataFrame:
    """One row a grid slot of every table of the pages; merged cells fill all their slots. header: the row has header cells only."""
    return _tables(paged).mapInArrow(_parsed, SLOTS)


def spans(paged: DataFrame) -> DataFrame:
    """One row a cell of every table of the pages, in place of its slots: (table, cell, row, column, down, across, text)."""
    return _tables(paged).mapInArrow(lambda batches: _parsed(batches, _spans_of, CELLS), CELLS)


TABLE = ["report_id", "page_index", "table_index"]


def with_paths(grid_slots: DataFrame) -> DataFrame:
    """Body slots with the path of header texts above them, repeats of a merged header once, and the row's first text as label."""
    heads = grid_slots.filter("header").groupBy(*TABLE, "grid_column").agg(F.sort_array(F.collect_list(F.struct("grid_row", F.trim("text").alias("t")))).alias("h"))  # of one column
    path = F.aggregate("h", F.array().cast("array<string>"), lambda s, x: F.when((F.size(s) > 0) & (F.element_at(s, -1) == x["t"]), s).otherwise(F.concat(s, F.array(x["t"]))))
    body = grid_slots.filter("not header")
    label = F.first(F.trim("text")).over(W.partitionBy(*TABLE, "grid_row").orderBy("grid_column"))
    return body.withColumn("label", label).join(heads.select(*TABLE, "grid_column", path.alias("path")), [*TABLE, "grid_column"], "left")


def paragraphs(paged: DataFrame) -> DataFrame:
    """(report_id, page_index, paragraph_index, text): what blank lines part, tables left out."""
    bare = F.regexp_replace("content", r"(?is)<\s*table\b.*?(<\s*/\s*table\s*>|$)", "\n\n")
    parts = F.filter(F.transform(F.split(bare, r"\n[ \t]*\n"), F.trim), lambda p: F.regexp_replace(p, r"\s+", "") != "")
    return paged.select("report_id", "page_index", F.posexplode(parts).alias("paragraph_index", "text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))


def represented(body: DataFrame) -> DataFrame:
    """One JSON document a table: its rows of label and cells in order."""
    rows = body.groupBy(*TABLE, "grid_row").agg(F.first("label").alias("label"), F.sort_array(F.collect_list(F.struct("grid_column", "text"))).alias("cells"))
    return rows.groupBy(*TABLE).agg(F.to_json(F.sort_array(F.collect_list(F.struct("grid_row", "label", "cells")))).alias("content"))


def chunks(units: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Units packed greedily in order into chunks of at most `most`; a larger unit is a chunk of its own. Adds column chunk."""
    seq = units.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, size))).alias("u"))  # the rows of one table
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("load"), F.array().cast("array<int>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        new = (s["load"] > 0) & (s["load"] + x[size] > most)
        at = F.when(new, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(at.alias("chunk"), F.when(new, x[size].cast("long")).otherwise(s["load"] + x[size]).alias("load"), F.concat(s["all"], F.array(at)).alias("all"))

    done = seq.select(key, "u", F.aggregate("u", zero, step)["all"].alias("c"))
    return done.select(key, F.explode(F.arrays_zip("u", "c")).alias("z")).select(key, F.col(f"z.u.{order}").alias(order), F.col(f"z.u.{size}").alias(size), F.col("z.c").alias("chunk"))


def adjacent(blocks: DataFrame) -> DataFrame:
    """(page, table_at, text_at): a table and the paragraph next before it, where each has the other only.

    blocks: (page, at, kind) with kind TABLE or TEXT; one window, no pairs.
    """
    order = W.partitionBy("page").orderBy("at")
    near = blocks.withColumn("before", F.lag("kind").over(order)).withColumn("from", F.lag("at").over(order))
    return near.filter("kind = 'TABLE' and before = 'TEXT'").select("page", F.col("at").alias("table_at"), F.col("from").alias("text_at"))
