"""Stored tables: what is pruned, what a restart does, what is refused, and odd rows."""

import json

import pytest

from factspark.sources import stores as S


def scanned(df):
    """(rows, files read, partitions read) of the scan of a query that has run."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    while plan.children().size() or plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan.children().apply(0)
    at = lambda name: plan.metrics().apply(name).value()
    return at("numOutputRows"), at("numFiles")


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(f"k{i}", i) for i in range(2000)] + [(None, 1), ("k7", 8), ("", 9)], "k string, v long")


def test_a_lookup_opens_the_keys_files_only(spark, tmp_path, rows):
    path = f"{tmp_path}/t"
    S.write_lookup(rows, "k", path, buckets=32)
    got = S.look_up(spark, path, ["k7", "k1999", "none", None, "", "k7"])
    assert sorted(tuple(r) for r in got.collect()) == [("", 9), ("k1999", 1999), ("k7", 7), ("k7", 8)]
    every = len(spark.read.parquet(path).inputFiles())
    read, files = scanned(S.look_up(spark, path, ["k7"]))
    assert files <= 4 < 32 <= every and read < 2000 / 16
    text = S.look_up(spark, path, ["k7"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [_bucket" in text.replace("isnotnull(_bucket#", "_bucket#") or "PartitionFilters" in text and "PushedFilters: [In(k" in text or "EqualTo(k,k7)" in text
    assert S.look_up(spark, path, []).count() == 0 and S.look_up(spark, path, [None]).columns == ["k", "v"]
    with pytest.raises(S.Conflict):
        S.write_lookup(rows, "k", path)


def test_lookups_of_a_table_of_keys(spark, tmp_path, rows):
    path = f"{tmp_path}/t"
    S.write_lookup(rows, "k", path, buckets=8)
    keys = spark.createDataFrame([("k3", 1), ("k7", 2), ("none", 3), (None, 4)], "asked string, n int")
    assert sorted(tuple(r) for r in S.look_up_all(keys, path, "asked").select("asked", "n", "v").collect()) == [("k3", 1, 3), ("k7", 2, 7), ("k7", 2, 8)]
    assert S.look_up_all(keys, path, "asked", "left").count() == 5
    S.write_lookup(rows.limit(0), "k", f"{tmp_path}/empty")
    assert S.Files(spark, f"{tmp_path}/empty").exists("_lookup.json")


@pytest.mark.parametrize("stop", [0, 2, 4])
def test_a_restart_writes_no_row_twice(spark, tmp_path, rows, stop):
    path = f"{tmp_path}/b"
    with pytest.raises(RuntimeError):
        S.write_batches(rows, "v", path, 5, "x", stop_before=stop)
    files = S.Files(spark, path)
    assert len([n for n in files.names("_commits")]) == stop
    # a failure between the move and the marker
    files.move(f"_staging/{stop}", f"batch={stop}")
    assert S.write_batches(rows, "v", path, 5, "x") == {"written": list(range(stop, 5)), "skipped": list(range(stop))}
    got = S.read_batches(spark, path).drop("batch")
    assert got.exceptAll(rows).count() == 0 and rows.exceptAll(got).count() == 0
    assert S.write_batches(rows, "v", path, 5, "x")["written"] == []


def test_resuming_refuses_another_plan_and_changed_files(spark, tmp_path, rows):
    path = f"{tmp_path}/b"
    S.write_batches(rows, "v", path, 2, "x")
    for batches, identity, df in ((3, "x", rows), (2, "y", rows), (2, "x", rows.withColumnRenamed("k", "z"))):
        with pytest.raises(S.Conflict):
            S.write_batches(df, "v", path, batches, identity)
    rows.limit(1).write.mode("append").parquet(f"{path}/batch=0")
    with pytest.raises(S.Conflict):
        S.read_batches(spark, path)
    with pytest.raises(S.Conflict):
        S.read_batches(spark, f"{tmp_path}/none")


def test_publishing_swaps_and_refuses(spark, tmp_path, rows):
    root = f"{tmp_path}/p"
    assert S.current(spark, root) is None
    with pytest.raises(S.Conflict):
        S.read_published(spark, root, "t")
    a = S.publish({"t": rows, "u": rows.limit(0)}, root)
    with pytest.raises(S.Conflict):
        S.publish({"t": rows.limit(3)}, root)  # expects that nothing is there
    b = S.publish({"t": rows.limit(3)}, root, expected=a)
    assert S.current(spark, root) == b != a and S.read_published(spark, root, "t").count() == 3 and S.read_published(spark, root, "t", a).count() == rows.count()
    assert S.publish({"t": rows.repartition(3), "u": rows.limit(0)}, root, expected=b) == a  # the same content is the same version
    S.Files(spark, root).create("_lock", "")
    with pytest.raises(S.Conflict):
        S.publish({"t": rows}, root, expected=a)
    S.Files(spark, root).delete("_lock")
    rows.limit(1).write.mode("append").parquet(f"{root}/versions/{a}/t")
    with pytest.raises(S.Conflict):
        S.read_published(spark, root, "t")


def test_a_run_answers_each_question_once(spark, tmp_path, rows):
    path, fail = f"{tmp_path}/r", lambda left: 1 / 0
    asked = rows.filter("v < 20").select("v")
    with pytest.raises(ZeroDivisionError):
        S.run_questions(asked, "v", fail, path, {"m": 1})
    assert S.run_questions(asked.filter("v < 5"), "v", lambda left: left, path, {"m": 1}) == 5
    assert S.run_questions(asked, "v", lambda left: left, path, {"m": 1}) == 15
    assert S.run_questions(asked, "v", lambda left: left, path, {"m": 1}) == 0
    report = S.read_report(spark, path)
    assert report.count() == report.select("v").distinct().count() == 20
    with pytest.raises(S.Conflict):
        S.run_questions(asked, "v", lambda left: left, path, {"m": 2})
    S.Files(spark, path).create("_lock", json.dumps({}))
    with pytest.raises(S.Conflict):
        S.run_questions(asked, "v", lambda left: left, path, {"m": 1})
