"""Mentions by both ways, rewriting and the resolution of questions, on rows that are easy to mistreat."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factspark.functions import lexicon as X
from factspark.operators import understanding as U

LEXICON = [("company", "1", "abc corp"), ("company", "2", "abc corp"), ("company", "3", "abc"), ("metric", "R", "net revenue"), ("metric", "S", "revenue"), ("metric", "D", "d/e"), ("metric", "X", " x"), ("metric", "N", None), ("metric", "E", "")]
TEXTS = [(1, "abc corp net revenue"), (2, "abcd corp abc  corp"), (3, None), (4, ""), (5, "the d/e of abc,abc corp"), (6, "net revenue revenue " * 2000), (7, "abc corp net revenue")]


def tables(spark):
    return spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame(LEXICON, "kind string, concept string, phrase string")


def brute_force(text, phrases):
    spans = [(m.start(), m.start() + len(p), p) for p in phrases for m in re.finditer(rf"(?<![0-9a-z])(?={re.escape(p)}(?![0-9a-z]))", text or "")]
    taken = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        if all(s[1] <= t[0] or t[1] <= s[0] for t in taken):
            taken.append(s)
    return taken


@pytest.mark.parametrize("rows", [100, 0])
def test_mentions_by_automaton_and_by_join(spark, rows):
    texts, lexicon = tables(spark)
    got = {tuple(r) for r in U.mentions(texts, lexicon, "id", "text", rows=rows).collect()}
    good = [x for x in LEXICON if x[2] and x[2][0].isalnum()]
    want = {(i, a, b, p, k, c) for i, t in TEXTS for a, b, p in brute_force(t, {x[2] for x in good}) for k, c, q in good if q == p}
    assert got == want and len(got) > 4000


@pytest.mark.parametrize("rows", [1000, 0])
def test_mentions_against_brute_force(spark, rows):
    rng = random.Random(1)
    phrases = {" ".join(rng.choice(["a", "b", "ab", "ba"]) for _ in range(rng.randint(1, 4))) for _ in range(20)}
    texts = [(i, " ".join(rng.choice(["a", "b", "ab", "ba", "c"]) for _ in range(30))) for i in range(40)]
    lexicon = spark.createDataFrame([("k", "c", p) for p in phrases], "kind string, concept string, phrase string")
    got = {(r.id, r["first"], r["last"], r.phrase) for r in U.mentions(spark.createDataFrame(texts, "id long, text string"), lexicon, "id", "text", rows=rows).collect()}
    assert got == {(i, *s) for i, t in texts for s in brute_force(t, phrases)}


def test_resolution_tells_ambiguous_from_multiple(spark):
    texts, lexicon = tables(spark)
    got = {r.id: (r.concepts, r.status) for r in U.resolution(U.mentions(texts, lexicon, "id", "text"), "company", "id").collect()}
    assert got == {1: (["1", "2"], "AMBIGUOUS"), 2: (["3"], "RESOLVED"), 5: (["3", "1", "2"], "AMBIGUOUS"), 7: (["1", "2"], "AMBIGUOUS")}
    none = spark.createDataFrame([], "kind string, concept string, phrase string")
    assert U.mentions(texts, none, "id", "text").count() == 0 and U.mentions(texts.limit(0), lexicon, "id", "text").count() == 0


def test_questions(spark):
    rows = [
        (1, "ROE của FPT từ 2019 sang 2021?"), (2, "So với 2020, doanh thu thuần của FPT, XYZ tăng bao nhiêu % từ 2020 sang 2021, hợp nhất, tỷ đồng"), (3, "doanh thu tăng bao nhiêu %"), (4, None), (5, " "),
        (6, "Lợi nhuận ròng và lãi gộp công ty mẹ, top 3, nghìn hay triệu"), (7, "lãi vay bình quân 2018-2020"), (8, "So sánh tỷ lệ nợ/vốn chủ"),
    ]
    asked = spark.createDataFrame(rows, "question_id long, question string")
    companies = spark.createDataFrame([("fpt", "FPT"), ("fpt", "Công ty FPT")], "concept string, phrase string")
    got = {r.question_id: r for r in U.understand(asked, companies).collect()}
    assert (got[1].ratios, got[1].required_metrics, got[1].companies, got[1].operation) == (["ROE"], ["LNST", "EQUITY"], ["fpt"], "UNKNOWN")
    assert (got[2].operation, got[2].scope, got[2].requested_scale, got[2].unknown_tickers, got[2].years) == ("growth", "HOP_NHAT", None, ["XYZ"], [2020, 2021])
    assert (got[3].metrics, got[3].requested_scale, got[3].scope_status) == (["NET_REVENUE"], "PERCENT", "UNRESOLVED")
    assert got[4].metrics == [] and got[4].operation == "UNKNOWN" and got[4].company_status == "UNRESOLVED" and got[5].operation == "UNKNOWN"
    assert (got[6].metrics, got[6].scope, got[6].ranking, got[6].requested_scale) == (["LNST", "GROSS_PROFIT"], "RIENG", True, None)
    assert (got[7].metrics, got[7].operation, got[7].years) == (["INTEREST_EXPENSE"], "aggregate", [2018, 2019, 2020])
    assert (got[8].ratios, got[8].operation) == (["DEBT_TO_EQUITY"], "UNKNOWN")


@pytest.mark.parametrize("text, want", [
    ("lai truoc thue", "loi nhuan truoc thue"), ("bien loi nhuan rong", "bien loi nhuan rong"), ("von chu so huu", "von chu so huu"), ("ty le no/von chu", "no tren von chu so huu"), ("no phai tra / tong von chu", "no tren von chu so huu"),
    ("quy mo tong gia tri tai san", "tong tai san"), ("he so loi nhuan tren tong tai san", "ty suat loi nhuan tren tong tai san"), ("xlai gop", "xlai gop"), ("", ""),
])
def test_canonical_phrasing(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.canonical_phrasing(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("rows, starts", [(100, 100), (0, 100), (0, 0)])
def test_mentions_with_any_and_with_known_first_words(spark, rows, starts):
    texts, lexicon = tables(spark)
    lexicon = lexicon.filter("phrase <> 'd/e'").union(spark.createDataFrame([("metric", "G", "revenue net revenue"), ("company", "4", "corp abc corp")], lexicon.schema))
    got = {tuple(r) for r in U.mentions(texts, lexicon, "id", "text", rows=rows, starts=starts).collect()}
    known = [tuple(r) for r in lexicon.collect() if r.phrase and r.phrase[0].isalnum()]
    assert got == {(i, a, b, p, k, c) for i, t in TEXTS for a, b, p in brute_force(t, {x[2] for x in known}) for k, c, q in known if q == p} and len(got) > 2000


def test_spans_leave_a_worker_in_parts():
    import pyarrow as pa

    texts = pa.record_batch([pa.array([1, 2, 3]), pa.array(["a b " * 30_000, None, "a b"])], names=["id", "text"])
    parts = list(U._rows_of(lambda: lambda text: U._spans_of_words([1, 2], {"a": [1, 2]}, text))(iter([texts])))
    assert max(p.num_rows for p in parts) == U.SPANS_A_BATCH and sum(p.num_rows for p in parts) == 60_002
    assert parts[-1].to_pylist()[-1] == {"id": 3, "first": 0, "last": 3, "phrase": "a b"}


def test_terms_of_questions_take_no_join(spark):
    asked = spark.createDataFrame([(1, "ROE năm 1999 đến năm 2001, 2003-2005-2006")], "question_id long, question string")
    told = U.understand(asked, spark.createDataFrame([("fpt", "FPT")], "concept string, phrase string"))
    assert "Join" not in told.select("question_id", "metrics", "operation", "ranking")._jdf.queryExecution().optimizedPlan().toString()
    assert told.first().years == [1999, 2000, 2001, 2003, 2004, 2005, 2006]


def test_named_tells_what_mentions_tell(spark):
    texts, lexicon = tables(spark)
    want = {r.id: r.spans for r in U.spans_of(U.mentions(texts, lexicon, "id", "text"), "id").collect()}
    got = {r.id: r.spans for r in texts.select("id", U.named(F.col("text"), LEXICON).alias("spans")).collect()}
    assert got == {i: want.get(i, []) for i, _ in TEXTS}
