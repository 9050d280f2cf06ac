"""Header bands, nesting, roles of columns and budgeted chunks on tables that are easy to misread."""

import random

import pytest
from pyspark.sql import functions as F

from factspark.operators import documents as D
from factspark.operators import layout as Y


def cells(spark, *tables):
    rows = [("r", f"===== PAGE {i + 1} =====\n<table>{t}</table>\n") for i, t in enumerate(tables)]
    text = "".join(t for _, t in rows)
    return Y.cells(D.slots(D.pages(spark.createDataFrame([("r", text)], "report_id string, raw_text string"))))


def row(*texts):
    return "<tr>" + "".join(f"<td>{t}</td>" for t in texts) + "</tr>"


def paths(spark, table):
    return {r.column: r.path for r in Y.column_paths(cells(spark, table)).collect()}


def test_nested_paths(spark):
    head = "<tr><td rowspan=3>Item</td><td colspan=4>All</td></tr><tr><td colspan=2>Left</td><td colspan=2>Right</td></tr><tr><td>2024</td><td>2023</td><td>a</td><td>b</td></tr>"
    assert paths(spark, head + row("x", "1", "2", "3", "4")) == {1: ["All", "Left", "2024"], 2: ["All", "Left", "2023"], 3: ["All", "Right", "a"], 4: ["All", "Right", "b"]}


def test_a_header_that_is_in_no_span_stands_alone():
    heads = [{"row": 0, "column": 1, "across": 2, "text": "A"}, {"row": 1, "column": 2, "across": 2, "text": "B"}, {"row": 2, "column": 2, "across": 1, "text": "C"}]
    assert Y.nested(heads, [1, 2, 3, 4]) == {1: ["A"], 2: ["B", "C"], 3: ["B"], 4: []}
    twice = [{"row": 0, "column": 0, "across": 3, "text": "A"}, {"row": 0, "column": 0, "across": 3, "text": "B"}, {"row": 1, "column": 0, "across": 1, "text": "C"}]
    assert Y.nested(twice, [0, 1]) == {0: [], 1: []}


def test_the_band_ends_at_a_gap_and_odd_rows_have_no_say(spark):
    many = "".join(row(f"l{i}", str(i + 10000), "5") for i in range(19))
    got = paths(spark, row("", "Old", "New") + row("", "", "") + row("", "Lost", "Lost") + many + row("a", "b", "7"))
    assert got == {1: ["Old"], 2: ["New"]}
    # 2 of 12 rows begin elsewhere: no body, no paths
    assert paths(spark, row("", "Old", "New") + "".join(row("l", "1000", "5000") for _ in range(10)) + row("a", "b", "7000") * 2) == {}


def roles(spark, year, *tables):
    return {r.page_index: r.asDict() for r in Y.layouts(cells(spark, *tables), F.lit(year)).collect()}


def test_roles_of_columns(spark):
    a = row("Chỉ tiêu", "Mã số", "Thuyết minh", "Năm nay", "Năm trước") + row("x", "100", "V.1", "1.000", "2.000") + row("y", "110", "", "3.000", "-")
    b = row("", "", "", "") + row("z", "120", "4.000", "5.000")
    c = row("t", "2024", "2024") + row("z", "1.000", "2.000")
    d = row("t", "2019", "2018") + row("z", "1.000", "2.000")
    got = roles(spark, 2024, a, b, c, d)
    pick = lambda r: (r["code"], r["note"], r["current"], r["prior"], r["labels"], r["basis"])
    assert pick(got[0]) == (1, 2, 3, 4, [0], "HEADER")
    assert pick(got[1]) == (1, None, 2, 3, [0], "INHERITED")
    assert got[2]["basis"] == "AMBIGUOUS_CURRENT_COLUMN" and got[2]["current"] is None
    found = Y.lines(cells(spark, a, b, c, d), Y.layouts(cells(spark, a, b, c, d), F.lit(2024))).collect()
    assert {(r.label, r.code, r.note, r.current, r.prior) for r in found if r.page_index < 2} == {("x", "100", "V.1", "1.000", "2.000"), ("y", "110", "", "3.000", "-"), ("z", "120", None, "4.000", "5.000")}
    assert roles(spark, 2024, b)[0]["basis"] == "NO_CURRENT_COLUMN"


def test_nothing_to_read(spark):
    none = cells(spark, row("only", "text") + row("and", "more"))
    assert Y.body(none).count() == Y.column_paths(none).count() == Y.layouts(none, F.lit(2024)).count() == 0
    assert Y.table_chunks(none, 3).agg(F.max("chunk")).first()[0] == 1
    empty = none.limit(0)
    assert Y.table_chunks(empty, 3).count() == Y.column_paths(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_chunks_hold_every_token_once_within_the_budget(seed):
    rng = random.Random(seed)
    sizes = [[rng.choice([0, 1, 2, 30]) for _ in range(rng.randint(1, 6))] for _ in range(20)]
    head, most = rng.choice([0, 3, 9]), 12
    packed = Y._packed(sizes, head, most)
    held = set()
    for parts in packed:
        assert head + sum(y - x for _, _, _, x, y in parts) <= most
        for r, a, b, x, y in parts:
            if (x, y) == (0, sum(sizes[r][a:b])):
                new = {(r, c, k) for c in range(a, b) for k in range(sizes[r][c])}
            else:
                assert b - a == 1
                new = {(r, a, k) for k in range(x, y)}
            assert not new & held
            held |= new
    assert held == {(r, c, k) for r, s in enumerate(sizes) for c, n in enumerate(s) for k in range(n)}
    for before, after in zip(packed, packed[1:]):  # rows go on in a chunk while they fit
        whole = [p for p in (before[-1], after[0]) if p[1] == 0 and p[2] == len(sizes[p[0]]) and (p[3], p[4]) == (0, sum(sizes[p[0]]))]
        if len(whole) == 2 and before[-1][0] != after[0][0]:
            assert head + sum(y - x for _, _, _, x, y in before) + sum(sizes[after[0][0]]) > most


def test_lines_send_no_side_to_the_driver(spark):
    """However small Spark believes the parsed tables to be."""
    c = cells(spark, row("Item", "Năm nay", "Năm trước") + "".join(row(f"line {c}", f"1.234.56{i}", "5.000.000") for i, c in enumerate("abc")))
    got = Y.lines(c, Y.layouts(c, F.lit(2024)))
    assert got.count() == 3
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_slots_go_on_in_parts(monkeypatch):
    """Several pages and tables in parts of any size give the same slots, spans and statuses."""
    import pyarrow as pa

    text = f"<table>{row('a', 'b')}<tr><td rowspan=2>c</td><td>d</td></tr><tr><td>e</td></tr></table><table><tr><td>open"
    pages = pa.record_batch({"report_id": ["r", "s"], "page_index": pa.array([0, 4], pa.int32()), "content": [text, text]})
    whole = [tuple(r.values()) for b in D._parsed(iter([pages])) for r in b.to_pylist()]
    monkeypatch.setattr(D, "SLOTS_A_BATCH", 3)
    parts = list(D._parsed(iter([pages])))
    assert [tuple(r.values()) for b in parts for r in b.to_pylist()] == whole and max(b.num_rows for b in parts) == 3
    assert whole[:7] == [("r", 0, 0, "PARSED", *s) for s in [(0, 0, 0, "a", False, True), (0, 1, 1, "b", False, True), (1, 0, 2, "c", False, True), (1, 1, 3, "d", False, True), (2, 0, 2, "c", False, False), (2, 1, 4, "e", False, True)]] + [("r", 0, 1, "RECOVERED", 0, 0, 0, "open", False, True)]


def parser_alone(text):
    p = D._Cells()
    p.feed(text)
    p.close()
    return ("RECOVERED" if p.issues else "PARSED"), p.cells


def test_plain_tables_are_read_as_by_the_parser():
    r = random.Random(3)
    pieces = ["<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "<td colspan=2>", '<td rowspan="2" class="a">', "<td xrowspan=2>", "<td rowspan>", "<td colspan=x>", "x", " ", "1.000", "a > b", "&amp;", "<br>", "<TD>", "<table>", "</table>", "<td title=\"c rowspan=3\">", "< b", "\n", "<!-- -->"]
    read = 0
    for n in range(6000):
        some = pieces[: r.choice([8, 14, 24])]
        text = "<table>" + "".join(r.choice(some) for _ in range(r.randint(0, 12))) + "</table>"
        if D.table_ranges(text) == [(0, len(text), True)]:
            read += D.plain_cells(text) is not None
            assert D._cells_of(text, True) == parser_alone(text), text
    assert read > 1000
    assert D.plain_cells("<table><tr><td>a</td><td colspan=2>b</td></tr></table>") == [[0, "a", 1, 1, False], [0, "b", 1, 2, False]]


def test_cells_read_at_once_are_those_of_the_slots(spark):
    tables = [row("a", "", "", "") + "<tr><td rowspan=2 colspan=2>b</td><td>2024</td></tr>" + row("7", "(5)"), "<tr><td rowspan=2>x</td></tr>" + row("y") + "<tr><td colspan=x>z</td><td>1.000 %</td></tr>", row("1 000", " 5", "-", "5 %", "+3,5", "(2.000)", "12a", "")]
    text = "".join(f"===== PAGE {i + 1} =====\n<table>{t}</table>\n" for i, t in enumerate(tables))
    paged = D.pages(spark.createDataFrame([("r", text)], "report_id string, raw_text string"))
    a, b = Y.cells(D.slots(paged)), Y.figures(D.spans(paged))
    assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    from factspark.functions import scalar as S

    printed = ["1 000", " 5 ", "(1.000,5) %", "- 5", "-5", "+7%", "5 %", "(5", "1,2,3", "", "%", "a5", "1 000"]
    odd = spark.createDataFrame([(t,) for t in printed], "t string").filter((S.parse_number(F.col("t"))[0] == "PARSED") & ~F.col("t").rlike(Y.NUMBER))
    assert odd.count() == 0


def test_long_tables_are_read_without_holding_their_cells(monkeypatch):
    """Tables of more than a piece, plain or not, give the slots and spans of shorter ones, in memory that grows by their text only."""
    import tracemalloc

    r = random.Random(4)
    pieces = ["<tr>", "</tr>", "<td>", "</td>", "<th>", "<td colspan=2>", "<td rowspan=3 colspan=2>", "x", " ", "&am", "p;", "<br>", "<td colspan=x>", "<!-- -->"]
    for _ in range(2000):
        some = pieces[: r.choice([9, 14])]
        text = "<table>" + "".join(r.choice(some) for _ in range(r.randint(0, 20))) + "</table>"
        found = []
        for size in (1 << 18, 1, 7):
            monkeypatch.setattr(D, "PIECE", size, raising=False)
            found.append((list(D._slots_of(text, True)), list(D._spans_of(text, True))))
        assert found[0] == found[1] == found[2], text
    monkeypatch.setattr(D, "PIECE", 1 << 12, raising=False)
    head = "<tr><th rowspan=2>Name</th><th colspan=2>Customer</th></tr><tr><th>Key</th><th>Balance</th></tr>"
    for odd in ("", "&amp;"):
        text = f"<table>{head}" + row(f"a{odd}", "1", "2") * 5000 + "</table>"
        tracemalloc.start()
        n = sum(1 for _ in D._slots_of(text, True))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 15006 and most < 2 * len(text), most
