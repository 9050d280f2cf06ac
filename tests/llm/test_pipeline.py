"""The pipeline's stages, on rows that are easy to lose."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline as p
from factspark.llm import langid, simhash
from factspark.llm.tokens import BYTE_BPE, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, file long, place long, key long"


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture
def table(spark, tmp_path):
    def make(rows):
        path = f"{tmp_path}/documents.parquet"
        spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "r", 1, 2, 3) for i, t in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_keeps_one_row_of_each_text(spark, table):
    rows = [(5, "A"), (5, "B"), (9, "A"), (None, "A"), (None, "B"), (None, "C"), (None, "C"), (3, "D"), (3, "D"), (1, None), (2, ""), (7, "é" * 9000)]
    got = p.exact(spark, table(rows), "")
    assert kept(got) == Counter([(9, "A"), (5, "B"), (None, "C"), (3, "D"), (2, ""), (7, "é" * 9000)]) and got.columns == SCHEMA.replace(",", "").split()[::2]


def test_near_loses_no_unique_text(spark, table):
    rng = random.Random(1)
    a, b, c = (words(rng, 120) for _ in range(3))
    rows = [(4, a), (4, b), (None, c), (None, a + " more"), (2, b + " more words"), (6, None), (6, ""), (8, " "), (9, c), (9, c)]
    assert kept(p.near(spark, table(rows), "")) == Counter([(4, a), (2, b + " more words"), (9, c), (6, None), (6, ""), (8, " ")])


def test_suffix_stage_keeps_one_copy_of_a_passage(spark, table):
    rng = random.Random(2)
    shared = words(rng, 90, "abcdefghijklm")
    own = [words(rng, 150, "abcdefghijklm") for _ in range(4)]
    rows = [(1, f"{own[0]} {shared} {own[1]}"), (1, f"{own[2]} {shared}"), (None, own[3]), (2, None), (3, ""), (4, shared[:100])]
    got = {(r.doc_id, r.text): r for r in p.suffix_array(spark, table(rows), "").collect()}
    untouched = {(None, own[3]), (2, None), (3, ""), (4, shared[:100])}
    # a cut takes the spaces around the passage where both texts have them
    first = untouched | {(1, rows[0][1]), (1, own[2])}
    second = untouched | {(1, f"{own[0]}{own[1]}"), (1, f"{own[0]} {own[1]}"), (1, rows[1][1])}
    assert len(shared) > p.REPEAT_BYTES and len(got) == 6 and (set(got) == first or set(got) < second)
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in got.values())


def test_suffix_stage_loses_no_passage(spark, table):
    rng = random.Random(8)
    a, b, c = (words(rng, 120, "abcdefghijklm") for _ in range(3))
    got = [r.text for r in p.suffix_array(spark, table([(1, f"{a} {b}"), (2, f"{b} {c}"), (3, f"{c} {a}")]), "").collect()]
    assert all(sum(t.count(x) for t in got) == 1 for x in (a, b, c)) and all(t.strip() for t in got)


def test_a_row_that_is_there_twice_survives_the_stages(spark, table):
    rng = random.Random(3)
    long, other = words(rng, 300), words(rng, 200)
    docs = table([(3, long), (3, long), (4, other), (None, None), (5, "")])
    for stage in (p.exact, p.near, p.suffix_array):
        docs = stage(spark, docs, "")
    assert kept(docs) == Counter({(3, long): 1, (4, other): 1, (5, ""): 1})
    pieces = p.pack(spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == {3, 4, 5}


def test_language_stage_keeps_clean_rows(spark, table):
    rng = random.Random(4)
    rows = [(i, words(rng, 80)) for i in range(30)] + [(1, words(rng, 50)), (None, words(rng, 50)), (40, None), (41, ""), (42, "12 34")]
    got = kept(p.language_id(spark, table(rows), ""))
    assert got == Counter((i, t) for i, t in rows if i not in (40, 41, 42))


def test_stages_of_an_empty_table(spark, table):
    docs = table([])
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0
    assert p.pack(spark, docs, "").count() == 0


def test_run_on_a_small_table(spark, table, tmp_path):
    rng = random.Random(5)
    base = [words(rng, 200) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10, base[0]), (11, base[1] + " tail"), (None, None)]
    table(rows)
    got = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {10, 1, 2, 3, 4, 5}
    library = encoder(BYTE_BPE).library
    texts = dict(rows)
    for doc_id in (10, 1, 2, 3, 4, 5):
        ids = library.encode(texts[doc_id], add_special_tokens=False).ids + [1]
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == doc_id)
        assert pieces == [(0, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)), len(ids))]


def test_shingle_sets_are_the_texts_shingles():
    rng = random.Random(6)
    for n in (0, 1, 3, 4, 5, 6, 50):
        text = words(rng, n, "ab")
        assert len(simhash.shingle_set(text, 5)) == len(set(simhash.shingles_of(simhash.words_of(text), 5)))
    assert langid.classify(None, ())[0] == "und"
