"""What the queries must return, against independent code, and rows that are easy to mistreat."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from factspark.llm import ann, langid, packing, repair, sharding, toxicity
from factspark.llm.tokens import BYTE_BPE, encoder

SCHEMA = "doc_id long, text string, lang string, row string, file long, score double"


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(i, words(rng, rng.randint(1, 120)), "en", "r", 1, 0.1) for i in range(60)]
    return [*out, out[4], (4, "another text of id 4", "en", None, None, None), (None, out[5][1], None, None, None, None), (None, None, None, None, None, None), (70, "", "de", "", 0, 0.0), (71, "é日 " * 700, "fr", "", 0, 0.0)]


def test_sharding_law(spark, rows):
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=5).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) <= sum(loads.values()) / 5 + max(Counter((r.text_crc32, r.size) for r in got).items(), key=lambda x: x[0][1] * x[1])[0][1] * 2


@pytest.mark.parametrize("seed", range(4))
def test_minimax_against_dynamic_program(seed):
    rng = random.Random(seed)
    sizes, shards = [rng.randint(1, 50) for _ in range(25)], rng.randint(2, 7)

    @lru_cache(None)
    def best(at, left):
        if at == len(sizes):
            return 0
        if left == 0:
            return 1 << 60
        return min(max(sum(sizes[at:end]), best(end, left - 1)) for end in range(at + 1, len(sizes) + 1))

    assert sharding.minimax_cuts(sizes, shards)[1] == best(0, shards)


def test_pieces_are_the_documents_ids(spark, rows):
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), length=128).collect()
    want = Counter()
    for r in rows:
        ids = encoder(BYTE_BPE).library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 128):
            part = ids[at : at + 128]
            want[r[0], at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    total, sequences = sum(r.length for r in got), {r.sequence_id for r in got}
    assert len(sequences) <= -(-total // 128) + 1


def test_column_generation_bound():
    rng = np.random.default_rng(4)
    demand = Counter(rng.integers(20, 110, 4000).tolist())
    patterns = packing.solve(demand, 128)
    assert sum(n for _, n in patterns) <= 1.02 * max(sum(s * n for s, n in demand.items()) / 128, sum(n for s, n in demand.items() if s > 64)) + 1


def test_token_files_by_brute_force(spark, rows):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in repair.read_ids(repair.write_ids(spark.createDataFrame(rows, SCHEMA))).collect())
    library, at = encoder("word_bpe_49k.json").library, 0
    found = defaultdict(list)
    for start, doc_id, n, crc in got:
        assert start == at
        at += n
        found[doc_id].append((n, crc))
    want = defaultdict(list)
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0]].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    order = [d for _, d, _, _ in got if d is not None]
    assert order == sorted(order)


def test_language_and_toxicity_of_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    told = langid.predict(docs, langid.fit_dictionaries(docs, langid._held_out)).collect()
    assert Counter(r.row.doc_id for r in told) == Counter(r[0] for r in rows)
    assert all(r.lang_pred == "und" for r in told if not r.row.text) and all(0 <= r.score <= 1 for r in told)
    scored = toxicity.score_documents(docs, toxicity.train([], [])).collect()
    assert Counter(r.doc_id for r in scored) == Counter(r[0] for r in rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in scored)


def test_ann_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 1500)] + 0.15 * rng.normal(size=(1500, 24))
    monkeypatch.setattr(ann, "BLOCK", 100)
    data = [(i, v.tolist(), 1, "b") for i, v in enumerate(x)] + [(7, x[7].tolist(), 1, "b"), (None, x[3].tolist(), 1, "b")]
    got = defaultdict(set)
    for r in ann.search(spark.createDataFrame(data, "vec_id long, embedding array<double>, block int, curve string"), query_modulus=50).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 1500, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(1500), d))[:10].tolist()) & got[q])
    assert len(got) == 30 and hits >= 0.9 * 300


def test_ann_with_few_candidates(spark):
    data = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None)]
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == [(0, 1, 2), (0, 2, 1)]
