"""Structure of printed tables: body rows, header bands, nested header paths, roles of columns, budgeted chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import scalar as S

TABLE = ["report_id", "page_index", "table_index"]
#: Share of body rows that must have their first figure in the same column.
DOMINANT = 0.9
#: Share of a column's filled body cells that must look like line codes.
CODED = 0.6
#: What a line code looks like.
CODE = "^[0-9]{2,3}[a-z]?$"
#: The characters that a printed number may consist of; what has others is not read as one.
NUMBER = r"^[\s\xA0]*[-+(]?[0-9][0-9.,\s\xA0]*[)]?[\s\xA0]*%?[\s\xA0]*$"
# Folded header words of code and note columns.
CODE_WORDS, NOTE_WORDS = ("ma so", "ma", "code"), ("thuyet minh", "note", "notes")


def cells(slots: DataFrame) -> DataFrame:
    """One row a cell of slots(): its place, spans, trimmed text, and whether that is a figure: a number that is no period, in no column of line codes."""
    return figures(slots.groupBy(*TABLE, "cell").agg(F.min("grid_row").alias("row"), F.min("grid_column").alias("column"), (F.max("grid_row") - F.min("grid_row") + 1).alias("down"), (F.max("grid_column") - F.min("grid_column") + 1).alias("across"), F.first("text").alias("text")))


def figures(placed: DataFrame) -> DataFrame:
    """cells() of placed cells, such as documents.spans() reads."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    placed = placed.withColumn("text", text).withColumn("named", (F.col("row") < 8) & S.fold(F.col("text")).isin(*CODE_WORDS))
    column = W.partitionBy(*TABLE, "column")
    share = F.count_if(F.col("text").rlike(CODE)).over(column) >= CODED * F.count_if(F.col("text") != "").over(column)
    codes = share | F.max("named").over(column)
    printed = F.col("text").rlike(NUMBER) & (S.parse_number(F.col("text"))[0] == "PARSED") & P.period_label(F.col("text")).isNull()
    return placed.withColumn("figure", ~codes & printed).drop("named")


def body(cells: DataFrame) -> DataFrame:
    """(table, row, width) of the body rows: those with text left of their first figure, where nearly all such rows of a table agree on its column.

    Rows that differ from the common width are left out; where fewer than
    DOMINANT agree, the table has no body. A tie goes to the smaller width.
    """
    starts = cells.groupBy(*TABLE, "row").agg(F.min(F.when(F.col("figure"), F.col("column"))).alias("width"), F.min(F.when(~F.col("figure") & (F.col("text") != ""), F.col("column"))).alias("label"))
    rows = starts.filter("width > 0 AND label < width").select(*TABLE, "row", "width")
    counts = rows.groupBy(*TABLE, "width").agg(F.count("*").alias("n"))
    every = W.partitionBy(*TABLE)
    common = counts.withColumn("share", F.col("n") / F.sum("n").over(every)).withColumn("place", F.row_number().over(every.orderBy(F.desc("n"), "width")))
    return rows.join(common.filter((F.col("place") == 1) & (F.col("share") >= DOMINANT)).select(*TABLE, "width").hint("merge"), [*TABLE, "width"])


def bands(cells: DataFrame, body: DataFrame) -> DataFrame:
    """The cells of each table's header band: rows from the top, without a gap, that have text over the columns of figures."""
    first = body.groupBy(*TABLE).agg(F.min("row").alias("first"), F.min("width").alias("width")).hint("merge")
    figures = cells.filter("figure").join(body.select(*TABLE, "row").hint("merge"), [*TABLE, "row"], "left_semi").groupBy(*TABLE).agg(F.collect_set("column").alias("data"))  # columns of one table
    named = cells.join(first.join(figures, TABLE).hint("merge"), TABLE).filter("row < first AND text <> ''")
    label = (F.col("across") > 1) | (S.parse_number(F.col("text"))[0] == "NOT_NUMERIC") | P.period_label(F.col("text")).isNotNull()
    over = F.exists("data", lambda c: (c >= F.col("column")) & (c < F.col("column") + F.col("across")))
    ranked = named.filter(over & label).withColumn("seen", F.dense_rank().over(W.partitionBy(*TABLE).orderBy("row")))
    return ranked.filter("seen = row + 1").select(*TABLE, "cell", "row", "column", "down", "across", "text", "data")


def nested(heads: list[dict], columns: list[int]) -> dict[int, list[str]]:
    """Path of header texts over each column: the deepest header that covers it and what contains that, nearest first upwards.

    Headers go on a stack by row; a header's parent is the lowest one above it
    that spans all its columns. Two such in one row, or two deepest headers over
    one column, leave the path empty.
    """
    done: list[tuple[int, int, int, list[str] | None]] = []
    for h in sorted(heads, key=lambda h: (h["row"], h["column"])):
        left, right = h["column"], h["column"] + h["across"]
        above = [d for d in done if d[0] < h["row"] and d[1] <= left and right <= d[2]]
        nearest = [d for d in above if d[0] == max(a[0] for a in above)]
        if len(nearest) > 1 or (nearest and nearest[0][3] is None):
            path = None
        else:
            path = [*(nearest[0][3] if nearest else []), h["text"]]
        done.append((h["row"], left, right, path))
    out = {}
    for c in columns:
        over = [d for d in done if d[1] <= c < d[2]]
        depth = max((len(d[3] or ()) for d in over), default=0)
        deepest = [d for d in over if d[3] is not None and len(d[3]) == depth]
        out[c] = deepest[0][3] if len(deepest) == 1 else []
    return out


def _paths(heads: pd.Series, columns: pd.Series) -> pd.Series:
    return pd.Series([[{"column": c, "path": p} for c, p in nested(list(h), sorted(map(int, cs))).items()] for h, cs in zip(heads, columns)])


def column_paths(cells: DataFrame) -> DataFrame:
    """(table, column, path) of the columns that hold figures."""
    band = bands(cells, body(cells))
    heads = band.groupBy(*TABLE).agg(F.collect_list(F.struct("row", "column", "across", "text")).alias("heads"), F.first("data").alias("data"))  # the head of one table
    paths = F.pandas_udf(_paths, "array<struct<column: int, path: array<string>>>")
    return heads.select(*TABLE, F.explode(paths("heads", "data")).alias("p")).select(*TABLE, "p.*")


def layouts(cells: DataFrame, year: Column, carry: bool = True) -> DataFrame:
    """(table, width, code, note, current, prior, labels, basis): the roles of a table's columns; columns are null where there is none.

    `year` is the report's, over the columns of cells. Header texts vote for
    CURRENT and PRIOR; more than one CURRENT is AMBIGUOUS_CURRENT_COLUMN, none is
    NO_CURRENT_COLUMN, unless no header names a period: with carry, such a table
    takes over the columns of the one before it in the report, counted from the
    right (INHERITED). The code column is named so or holds codes in most filled
    body cells; labels are the other columns left of the first value.
    """
    rows = body(cells).groupBy(*TABLE).agg(F.min("row").alias("first")).hint("merge")
    sized = cells.groupBy(*TABLE).agg(F.max(F.col("column") + F.col("across")).alias("width"))
    spread = cells.join(rows, TABLE).withColumn("_year", year).withColumn("at", F.explode(F.sequence("column", F.col("column") + F.col("across") - 1)))
    head, filled = F.col("row") < F.col("first"), (F.col("row") >= F.col("first")) & (F.col("text") != "")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(head, F.struct("row", "text")))), lambda x: x["text"]), " ")
    votes = spread.groupBy(*TABLE, "at", "_year").agg(said.alias("said"), F.count_if(filled).alias("n"), F.count_if(filled & F.col("text").rlike(CODE)).alias("coded"))  # cells of one column
    votes = votes.withColumn("said", S.fold(F.col("said")))
    period = P.column_period(F.col("said"), F.col("_year"))
    whole = lambda words: F.col("said").rlike(r"(^|[^a-z])(" + "|".join(words) + r")($|[^a-z])")
    roles = votes.select(*TABLE, "at", period.alias("period"), (whole(CODE_WORDS)).alias("named"), (F.col("coded") >= CODED * F.col("n")).alias("coded"), whole(NOTE_WORDS).alias("note"), "n")
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("at"))))
    none = F.col("period").isNull()
    by_table = roles.groupBy(*TABLE).agg(
        pick(F.col("period") == "CURRENT").alias("currents"), pick(F.col("period") == "PRIOR").alias("priors"), pick(F.col("named") & none).alias("named"),
        pick(F.col("coded") & none & (F.col("n") > 0) & ~F.col("note")).alias("coded"), pick(F.col("note") & none).alias("notes"), F.array_sort(F.collect_list("at")).alias("all"),
    )
    one = lambda a: F.when(F.size(a) == 1, F.col(a)[0])
    told = by_table.join(sized.hint("merge"), TABLE).withColumn("code", F.coalesce(F.try_element_at("named", F.lit(1)), F.try_element_at("coded", F.lit(1))))
    own = told.withColumn("own", F.when(F.size("currents") == 1, F.struct((F.col("width") - F.col("currents")[0]).alias("current"), (F.col("width") - one("priors")).alias("prior"))))
    before = F.last("own", ignorenulls=True).over(W.partitionBy("report_id").orderBy("page_index", "table_index").rowsBetween(W.unboundedPreceding, -1))  # the tables of one report
    silent = (F.size("currents") == 0) & (F.size("priors") == 0)
    taken = own.withColumn("from", F.when(F.col("own").isNotNull(), F.col("own")).when(F.lit(carry) & silent, before))
    current = F.col("width") - F.col("from.current")
    basis = F.when(F.size("currents") > 1, "AMBIGUOUS_CURRENT_COLUMN").when(F.col("own").isNotNull(), "HEADER").when(F.col("from").isNotNull() & (current >= 1), "INHERITED").otherwise("NO_CURRENT_COLUMN")
    found = taken.withColumn("basis", basis).withColumn("current", F.when(F.col("basis").isin("HEADER", "INHERITED"), current)).withColumn("prior", F.when(F.col("current").isNotNull(), F.col("width") - F.col("from.prior")))
    note = F.try_element_at("notes", F.lit(1))
    first_value = F.least("current", "prior")
    labels = F.filter("all", lambda c: (c < first_value) & ~F.coalesce(c == F.col("code"), F.lit(False)) & ~F.array_contains("notes", c))
    return found.select(*TABLE, "width", F.when(F.col("code") < first_value, F.col("code")).alias("code"), F.when(note < first_value, note).alias("note"), "current", "prior", labels.alias("labels"), "basis")


def lines(cells: DataFrame, found: DataFrame) -> DataFrame:
    """(table, row, label, code, note, current, prior) of the body rows: texts by the roles of layouts(); tables without a current column have none.

    A cell that is merged over value columns is no single period's figure.
    """
    rows = body(cells).groupBy(*TABLE).agg(F.min("row").alias("first")).hint("merge")
    placed = cells.join(rows, TABLE).filter(F.col("row") >= F.col("first")).join(found.filter("current IS NOT NULL").hint("merge"), TABLE)
    at = lambda role: F.max(F.when((F.col("column") == F.col(role)) & (F.col("across") == 1), F.col("text")))
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.array_contains("labels", F.col("column")) & (F.col("text") != ""), F.struct("column", "text")))), lambda x: x["text"]), " ")
    out = placed.groupBy(*TABLE, "row").agg(label.alias("label"), at("code").alias("code"), at("note").alias("note"), at("current").alias("current"), at("prior").alias("prior"))
    return out.filter("label <> '' OR code IS NOT NULL")


def _packed(sizes: list[list[int]], head: int, most: int) -> list[list[tuple[int, int, int, int, int]]]:
    """Chunks of a table as lists of (row, first column, column after, first token, token after); sizes are tokens of each row's cells.

    Rows are packed in order while they fit beside the head. A row that doesn't
    fit alone is halved by columns, and again; a single cell that doesn't fit is
    cut into fragments.
    """
    room = max(1, most - head)

    def split(row: int, a: int, b: int) -> list[list[tuple[int, int, int, int, int]]]:
        load = sum(sizes[row][a:b])
        if load <= room:
            return [[(row, a, b, 0, load)]]
        if b - a > 1:
            half = (a + b) // 2
            return split(row, a, half) + split(row, half, b)
        return [[(row, a, b, at, min(at + room, load))] for at in range(0, load, room)]

    out: list[list[tuple[int, int, int, int, int]]] = []
    used = room + 1
    for row, widths in enumerate(sizes):
        load = sum(widths)
        if load > room:
            out += split(row, 0, len(widths))
            used = room + 1
        elif used + load > room:
            out.append([(row, 0, len(widths), 0, load)])
            used = load
        else:
            out[-1].append((row, 0, len(widths), 0, load))
            used += load
    return out


def _chunks(most: int):
    def run(rows: pd.Series, head: pd.Series) -> pd.Series:
        out = []
        for table, h in zip(rows, head):
            table = sorted(table, key=lambda r: r["row"])
            sizes = [[int(n) for n in r["sizes"]] for r in table]
            packed = _packed(sizes, int(h), most)
            out.append([{"chunk": i, "row": int(table[r]["row"]), "first": a, "last": b, "from": x, "until": y} for i, parts in enumerate(packed) for r, a, b, x, y in parts])
        return pd.Series(out)

    return run


def table_chunks(cells: DataFrame, most: int) -> DataFrame:
    """(table, chunk, row, first, last, from, until): which cells [first, last) of a row, and of a lone cell which tokens [from, until), a chunk holds.

    Tokens are words of the cells' texts. Every chunk repeats the table's head,
    whose tokens count; with them it holds at most `most` tokens (a head of
    `most` or more leaves one token a chunk). Every token of the body is in one
    chunk. A table without a body is all body.
    """
    rows = body(cells).groupBy(*TABLE).agg(F.min("row").alias("first")).hint("merge")
    tokens = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))
    sized = cells.join(rows, TABLE, "left").withColumn("n", tokens)
    head = F.sum(F.when(F.col("row") < F.coalesce("first", F.lit(0)), F.col("n")).otherwise(0))
    by_row = sized.filter(F.col("row") >= F.coalesce("first", F.lit(0))).groupBy(*TABLE, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "n"))), lambda x: x["n"]).alias("sizes"))
    tables = by_row.groupBy(*TABLE).agg(F.collect_list(F.struct("row", "sizes")).alias("rows")).join(sized.groupBy(*TABLE).agg(head.alias("head")).hint("merge"), TABLE)  # the sizes of one table
    out = tables.select(*TABLE, F.explode(F.pandas_udf(_chunks(most), "array<struct<chunk: int, row: int, first: int, last: int, from: int, until: int>>")("rows", "head")).alias("c"))
    return out.select(*TABLE, "c.*")
