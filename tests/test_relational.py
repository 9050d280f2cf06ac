"""Changes, descriptions and searches on nulls, zeros, ties and empty tables."""

from pyspark.sql import functions as F

from factspark.operators import relational as R
from factspark.operators import retrieval as T


def test_pct_change(spark):
    rows = [("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 0.0), ("a", 4, 5.0), ("a", 5, None), ("a", 6, 1.0), (None, 1, 4.0), (None, 2, 2.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {(r.k, r.t): r.pct_change for r in R.pct_change(df, "k", "v", "t").collect()}
    assert got == {("a", 1): None, ("a", 2): 0.5, ("a", 3): -1.0, ("a", 4): None, ("a", 5): None, ("a", 6): None, (None, 1): None, (None, 2): -0.5}


def test_describe_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (2.0, 7.0), (None, None)], "a double, b double")
    got = {r.c: r.asDict() for r in R.describe(df).collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["q25"], got["a"]["q50"], got["a"]["max"]) == (3, 1.6667, 1.5, 2.0, 2.0)
    assert got["b"]["n"] == 1 and got["b"]["std"] is None and got["b"]["q75"] == 7.0
    assert R.describe(df.limit(0)).count() == 0


def test_search_filters_before_the_ranking(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a a b", "y"), (3, "A", "x"), (4, None, "x"), (5, "", "y"), (6, "a b", "x")], "doc_id long, text string, lang string")
    T.write_index(docs, f"{tmp_path}/i", keep=("lang",))
    asked = spark.createDataFrame([(1, "a b"), (2, "a"), (2, "b"), (3, "none"), (4, None), (5, "?")], "query_id int, text string")
    got = {}
    for r in T.search_index(f"{tmp_path}/i", asked, 2, where=F.col("lang") == "x").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    assert sorted(got[1]) == [(1, 1), (2, 6)] and len(got[2]) == 2 and set(got) == {1, 2}
    assert 2 in {r.doc_id for r in T.search_index(f"{tmp_path}/i", asked, 9).filter("query_id = 2").collect()}


def test_rows_of_customers_are_made_in_many_tasks(spark, monkeypatch):
    from factspark import catalog_statements as C
    from factspark.catalog import Tables

    monkeypatch.setattr(C, "CUSTOMERS_A_TASK", 50, raising=False)
    rows = C.per_customer(Tables(spark, "/root/testdata/sf0.001"), [("a", 1), ("b", 2)], "k string, n int", "k")
    sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 300 and max(sizes) < 200


def test_identities_join_no_report_with_every_check(spark):
    from factspark.operators import statements as M

    lines = spark.createDataFrame([("r", "B02", "20", "current", 6.0, 1), ("r", "B02", "10", "current", 10.0, 1), ("r", "B02", "11", "current", -4.0, 1), ("s", "B09", "1", "current", 1.0, 1)], "report_id string, statement string, code string, col string, value double, unit int")
    got = M.check_identities(lines)
    told = got.groupBy("report_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "MISSING").alias("none"))
    names = {(i, c) for i, c, *_ in M.identity_terms()}
    assert {r.report_id: (r.n, r.none) for r in told.collect()} == {"r": (len(names), len(names) - 1), "s": (len(names), len(names))}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_vector_search_over_blocks(spark, monkeypatch):
    """Copies at the border, nulls, other lengths and infinities, over several blocks of rows and of queries; no nested loop."""
    import math

    monkeypatch.setattr(T, "VECTORS_A_BLOCK", 7, raising=False)
    monkeypatch.setattr(T, "QUERIES_A_BLOCK", 2, raising=False)
    big = 2**60
    rows = [(big + i, [float(i % 5), 0.1 * (i % 3)]) for i in range(40)] + [(1, None), (2, [1.0]), (3, [None, 1.0]), (4, [math.inf, 1.0]), (5, [math.nan, 0.0])]
    asked = [(big + 1, [1.0, 0.3]), (big + 2, [-1.0, 0.7]), (3, [0.0, 0.0]), (4, None), (5, [2.0])]
    v, q = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame(asked, "query_id long, q array<float>")
    got = T.vector_search(v, q, 4)
    scored = v.crossJoin(q).select("query_id", "vec_id", T.dot(F.col("embedding"), F.col("q")).alias("score"))
    want = R.top_n(scored, ["query_id"], 4, F.desc("score"), F.col("vec_id"))
    told = lambda df: sorted((r.query_id, r.rank, r.vec_id, str(r.score)) for r in df.collect())
    assert told(got) == told(want) and got.count() == 20
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_relevance_of_a_document_to_every_query(spark):
    lists = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 6, 1)], "query_id long, doc_id long, rank int")
    out = T.hybrid(lists, lists, spark.createDataFrame([(5, 0.1), (6, 0.9)], "doc_id long, logit double"), 2)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in out.collect()) == [(1, 1, 6), (1, 2, 5), (2, 1, 6)]


def test_lines_of_a_flag_are_not_sorted_in_one_task(spark):
    from factspark import catalog

    got = catalog.queries()["jn_header_contain"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_fold_agrees_with_python_and_leaves_it_only_other_scripts(spark):
    from factspark.functions import scalar as S

    odd = [chr(c) for c in range(1, 0x2100)] + ["가", "漢", "ﬁ", "😀", "𝐀", "Đơn vị\t\x1c TÍNH", "ạ́ B", " x ", "", None]
    df = spark.createDataFrame([(i, t if t is None else f"a{t}B") for i, t in enumerate(odd)], "i int, t string")
    assert df.select(S.fold(F.col("t")).alias("a"), S._folded(F.col("t")).alias("b")).filter("NOT a <=> b").count() == 0
    # what Python is given: nothing of Latin texts
    given = spark.createDataFrame([("Đơn vị tính: triệu đồng",), ("plain text",), ("漢 ß",)], "t string").select(S.left_to_python(F.col("t")).alias("t"))
    assert [r.t for r in given.collect()] == [None, None, "漢 ß"]


def test_ranks_are_dealt_out_once_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(T, "RANKS_A_TASK", 50, raising=False)
    ranked = spark.range(600).selectExpr("id % 200 AS query_id", "id AS doc_id", "CAST(id DIV 200 + 1 AS int) AS rank")
    got = T.checked_ranks(ranked)
    assert {r.status for r in got.collect()} == {"OK"} and got.count() == 200
    odd = spark.createDataFrame([("a", 1, 1), ("a", None, 2), ("b", 1, 1), ("b", 2, None), ("c", 2, 1), ("c", 1, 2), ("d", 1, 2), ("d", 2, 2), ("e", 1, 1), ("e", 1, 2), (None, 5, 1)], "query_id string, doc_id int, rank int")
    assert {r.query_id: r.status for r in T.checked_ranks(odd).collect()} == {"a": "DUPLICATE", "b": "RANK_INVALID", "c": "OK", "d": "RANK_INVALID", "e": "DUPLICATE", None: "OK"}
    assert got.rdd.getNumPartitions() == 13 and T.checked_ranks(ranked)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_postings_are_shuffled_once(spark, tmp_path):
    """Tokens are counted within a document's row; rows that share an id and a length count as one document."""
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "a"), (4, "a c"), (4, "c a"), (5, " ")], "doc_id int, text string")
    T.write_index(docs, f"{tmp_path}/i")
    got = spark.read.parquet(f"{tmp_path}/i/postings")
    assert sorted((r.doc_id, r.token, r.tf, r.length) for r in got.collect()) == [(1, "a", 1, 3), (1, "b", 2, 3), (3, "a", 1, 1), (4, "a", 1, 2), (4, "a", 1, 2), (4, "c", 1, 2), (4, "c", 1, 2)]
    found = T.search_index(f"{tmp_path}/i", spark.createDataFrame([(1, "c a")], "query_id int, text string"), 5)
    assert [r.doc_id for r in found.collect()] == [4]
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()  # no posting is shuffled to meet the words
    assert T.search_index(f"{tmp_path}/i", spark.createDataFrame([(1, " ")], "query_id int, text string"), 5).count() == 0
    most, T.WORDS = T.WORDS, 1
    assert [r.doc_id for r in T.search_index(f"{tmp_path}/i", spark.createDataFrame([(1, "c a")], "query_id int, text string"), 5).collect()] == [4]
    T.WORDS = most
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("index", "")
    T.write_index(docs.coalesce(1), f"{tmp_path}/j")
    stages = {s for j in tracker.getJobIdsForGroup("index") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) <= 5, stages
