"""Declared units with their places, and the windows of tables, on pages that are easy to misread."""

import pytest

from factspark.operators import hints as H


@pytest.mark.parametrize("text, want", [
    ("Đơn vị tính: triệu đồng", [("triệu đồng", "MILLION")]), ("DON VI: Tỷ VND; đvt nghìn đồng", [("Tỷ VND", "BILLION"), ("nghìn đồng", "THOUSAND")]), ("Đơn vị: VND/cổ phiếu", []), ("đơn vị tiền tệ: VND", [("VND", "RAW")]),
    ("triệu đồng", []), ("đơn vị", []), ("", []), (None, []), ("ĐVT: USD", []), ("x" * 5000 + " đvt: ngàn đồng", [("ngàn đồng", "THOUSAND")]),
])
def test_declarations(text, want):
    found = H.declarations(text or "")
    assert [(d["raw"], d["scale"]) for d in found] == want and all(text[d["first"] : d["last"]] == d["raw"] for d in found)


def test_windows_against_pairs(spark):
    tables = [("p", 0, 100, 150), ("p", 1, 160, 200), ("p", 2, 5000, 5100), ("q", 0, 10, 20), ("r", 0, 0, 50)]
    spans = [("p", 0, 5), ("p", 95, 100), ("p", 96, 101), ("p", 150, 160), ("p", 149, 155), ("p", 3799, 3810), ("p", 3800, 3810), ("p", 5200, 5210), ("q", 0, 10), ("s", 1, 2), (None, 1, 2)]
    t = spark.createDataFrame(tables, "page string, table_index int, first int, last int")
    s = spark.createDataFrame(spans, "page string, first int, last int")
    got = {tuple(r) for r in H.in_windows(t, s, ["page"]).select("page", "table_index", "first", "last").collect()}
    want = set()
    for page, i, first, _ in tables:
        begin = max([0, first - 1200, *(b for p, _, a, b in tables if p == page and a < first)])
        want |= {(page, i, a, b) for p, a, b in spans if p == page and begin <= a and b <= first}
    assert got == want and len(want) == 5
    assert H.in_windows(t.limit(0), s, ["page"]).count() == H.in_windows(t, s.limit(0), ["page"]).count() == 0


def test_tables_of_odd_texts(spark):
    texts = spark.createDataFrame([(1, "a<table>b</table>c<TABLE x='>'>"), (2, None), (3, "")], "id int, text string")
    assert sorted((r.id, r.table_index, r["first"], r["last"]) for r in H.table_spans(texts, "text").collect()) == [(1, 0, 1, 17), (1, 1, 18, 31)]


def test_a_character_is_made_plain_once(monkeypatch):
    import unicodedata

    asked = []
    monkeypatch.setattr(H.unicodedata, "normalize", lambda form, c, real=unicodedata.normalize: asked.append(c) or real(form, c))
    odd = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x20000)]))
    slow = lambda c, b: "d" if b == "đ" else b if len(b) == 1 else c
    assert H.plain(odd) == "".join(slow(c, unicodedata.normalize("NFD", c)[0].lower()) for c in odd)
    asked.clear()
    assert H.plain("ĐƠN vị " * 100) == "don vi " * 100 and asked == []
