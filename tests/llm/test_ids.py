"""Ids above 2**53 beside a null one, through every query's own function."""

import importlib

import pytest

from factspark.llm import queries

BIG = [2**53 + 1, 2**53 + 3, 2**53 + 5, None]
PASSAGE = "a passage of words that two texts hold and that is repeated " * 8


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts = [PASSAGE + "first", PASSAGE + "second", "q r", "n"]
    docs = [(i, t, "en", "web", len(t)) for i, t in zip(BIG, texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, n % 2) for n, i in enumerate(BIG[:3])], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "q r s")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("op2_ann", "op12_filter_audit")])
def test_ids_come_back(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(BIG)
    for r in got:
        if name == "op4_suffix_dedup":
            assert (r.n_removed > 400) == (r.doc_id in BIG[:2])
        if name == "op6_exact_dedup":
            assert r.keep_id == r.doc_id and r.kept and r.group_size == 1
        if name == "op10_simhash":
            assert r.component_id in BIG
        if name == "op11_jaccard_join":
            assert r.component_id == r.doc_id
    assert importlib.import_module("factspark.llm.common").whole_text(spark.read.parquet(f"{sf_dir}/documents.parquet")).dtypes[0] == ("doc_id", "string")
