"""The training-data operators against brute force, round trips and edge cases, on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factspark.llm import ann, bpe, exact_dedup, langid, packing, repair, sharding, simhash, suffix_dedup, toxicity
from factspark.llm.tokens import BYTE_BPE, WORD_BPE, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, th long"


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, rng.randint(1, 300)) for _ in range(40)]
    texts = [*base, *base[:6], base[7] + " tail", "", None, " \t\n", "é́ß日本 ​x", "x" * 3000, base[8][:500] + base[9], "<|endoftext|> a <|endoftext|>b"]
    out = [(i, t, "en" if i % 2 else None, "s", None, 0.5, "r", 1) for i, t in enumerate(texts)]
    return [*out, out[3], (None, base[1], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_cuckoo_index_grows_and_deletes():
    index = exact_dedup.CuckooIndex(8)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, [i, 1])
    assert index.resizes and all(index.get(k)[1] == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.get(k) is None for k in keys] == [i % 2 == 0 for i in range(3000)]


def test_exact_dedup(docs, empty, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = Counter((r[0], max(i for i in groups[r[1] or ""] if i is not None), len(groups[r[1] or ""])) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()) == want
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_minimax_is_smallest(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 40) for _ in range(30)]
    cuts, capacity = sharding.minimax_cuts(sizes, 6)
    parts = [sum(sizes[a:b]) for a, b in zip(cuts, [*cuts[1:], len(sizes)])]
    assert max(parts) == capacity and len(cuts) <= 6
    assert len(sharding.greedy_cuts(sizes, capacity - 1)) > 6 or max(sizes) == capacity


def test_sharding(docs, empty, rows):
    got = sharding.shard_documents(docs, shards=4).collect()
    assert len(got) == len(rows)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shards[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())
    assert sharding.shard_documents(empty, shards=4).count() == 0


def test_bpe_matches_library():
    library, rng = encoder("byte_bpe_50k.json").library, random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "'s", "12", "<|endoftext|>", ".", "ß", "日", "\t", "the ", "​", "\x1c", "\x85"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        want = library.encode(text, add_special_tokens=False).ids
        ids = bpe.encode_text(text, leaf=rng.choice([7, 20, 64]))
        assert ids.tolist() == want and bpe.decode_ids(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_documents(docs, empty, rows):
    library = encoder("byte_bpe_50k.json").library
    want = Counter((r[0], len(ids := library.encode(r[1] or "", add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.encode_documents(docs, leaf=100).collect()) == want
    assert bpe.encode_documents(empty).count() == 0


@pytest.mark.parametrize("width", [12, 60])
def test_suffix_dedup_brute_force(docs, empty, rows, width):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    want = Counter()
    for r, d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        want[r[0], len(d), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    for cell in (2048, 2):
        suffix_dedup.CELL, old = cell, suffix_dedup.CELL
        got = Counter((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, width).collect())
        suffix_dedup.CELL = old
        assert got == want
    assert suffix_dedup.remove_repeats(empty, width).count() == 0


def test_suffix_sort_orders():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    start, group = rng.integers(0, 2900, 400), rng.integers(0, 7, 400)
    order = suffix_dedup.suffix_sort(data, suffix_dedup.PrefixHashes(data), start, group, 50)
    keys = [(group[i], data[start[i] : start[i] + 50].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_packing(docs, empty, rows):
    got = packing.pack_documents(docs, length=64).collect()
    tokens = Counter()
    for r in rows:
        tokens[r[0]] += len(encoder("byte_bpe_50k.json").encode(r[1] or "")) // 4 + 1
    found, sequences = Counter(), defaultdict(list)
    for r in got:
        found[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert found == tokens and sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty).count() == 0


def test_packing_of_short_texts_is_tight(spark):
    texts = [None, "", " a", " a b c d e f g h", " a b c d e f g h i j k l m n o p"]
    docs = spark.createDataFrame([(i, texts[i % 5]) for i in range(600)], "doc_id long, text string")
    got = packing.pack_documents(docs, length=256).collect()
    used = {r.sequence_id for r in got}
    assert len(got) == 600 and len(used) == -(-sum(r.length for r in got) // 256)
    assert max(r.offset + r.length for r in got) <= 256


def test_inverse_of_the_first_basis():
    rng = np.random.default_rng(1)
    demand = Counter(rng.integers(1, 200, 3000).tolist())
    sizes = np.array(sorted(demand))
    columns, x, order = packing.first_basis(sizes, np.array([demand[int(s)] for s in sizes], float), 256)
    assert np.allclose(packing.inverted(columns, order) @ columns, np.eye(len(sizes)))
    assert np.allclose(columns @ x, [demand[int(s)] for s in sizes])


def test_column_generation_is_near_bound():
    rng = np.random.default_rng(0)
    demand = Counter(rng.integers(1, 60, 5000).tolist())
    patterns = packing.solve(demand, 64)
    used = Counter()
    for p, n in patterns:
        assert sum(s * c for s, c in p.items()) <= 64
        for s, c in p.items():
            used[s] += c * n
    assert used == demand


@pytest.mark.parametrize("ids", [[], [5], [7] * 1001, list(range(50)) * 40])
def test_repair_round_trip(ids):
    data = np.array(ids, "<u4")
    shard = repair.Shard(repair.write_shard([1, None], [len(ids), 0], data, 49408))
    assert (shard.all_ids() == data).all() and shard.doc_ids == [1, None]
    for a in range(0, len(ids), 37):
        assert (shard.ids(a, 55) == data[a : a + 55]).all()


def test_repair_reads_a_range_at_once(monkeypatch):
    """Any range of ids is unpacked by one call however many blocks of the index it covers, and no block beside it."""
    ids = np.random.default_rng(8).integers(0, 300, 30_000).astype("<u4")
    ids[9000:12000] = 7
    shard = repair.Shard(repair.write_shard([1, 2], [29_000, 1000], ids, 49408))
    calls, unpacked = [], repair.unpacked
    monkeypatch.setattr(repair, "unpacked", lambda data, bits, first, n: calls.append(n) or unpacked(data, bits, first, n))
    for start, n in [(0, 30_000), (0, 1), (29_999, 1), (29_999, 9), (30_000, 5), (8990, 3020), (10_000, 0), (1023, 2), (5000, 20_000)]:
        calls.clear()
        assert (shard.ids(start, n) == ids[start : start + n]).all() and len(shard.ids(start, n)) == len(ids[start : start + n])
        assert len(calls) <= 2 and all(c <= n + 2 * repair.INDEX_STEP for c in calls)


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 40000, 700)
    parts = [rng.zipf(1.3, 60000) % 3000, *[passage, rng.integers(0, 3000, 5)] * 60, np.full(999, 7)]
    ids = np.concatenate(parts).astype("<u4")
    rules, symbols = repair.compress(ids, 49408)
    assert (repair.expand(symbols, rules, 49408) == ids).all()
    seen, at = Counter(), 0
    pairs = list(zip(symbols[:-1].tolist(), symbols[1:].tolist()))
    while at < len(pairs):
        seen[pairs[at]] += 1
        at += 2 if at + 1 < len(pairs) and pairs[at] == pairs[at + 1] else 1
    assert max(seen.values()) < repair.LEAST
    assert repair.expansion_lengths(rules, 49408).max() > 600
    shard = repair.Shard(repair.write_shard([1], [len(ids)], ids, 49408))
    for a in range(0, len(ids), 4999):
        assert (shard.ids(a, 1500) == ids[a : a + 1500]).all()


def test_token_files(docs, empty, rows):
    at, want = 0, Counter()
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in repair.read_ids(repair.write_ids(docs)).collect())
    for r in rows:
        ids = encoder(WORD_BPE).encode(r[1] or "") + (2).to_bytes(4, "little")
        want[r[0], len(ids) // 4, zlib.crc32(ids)] += 1
    assert got == want
    starts = sorted((r.start, r.n_tokens) for r in repair.read_ids(repair.write_ids(docs)).collect())
    for start, n in starts:
        assert start == at
        at += n
    assert repair.read_ids(repair.write_ids(empty)).count() == 0


def test_simhash_brute_force(docs, empty, rows):
    got = simhash.simhash_components(docs, budget=8).collect()
    fps = [simhash.fingerprint(r[1] or "") for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            root[i] = min(root[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 8)
    first = {k: min(r[0] for r, x in zip(rows, root) if x == k and r[0] is not None) for k in set(root)}
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((r[0], f"{f:016x}", first[x]) for r, f, x in zip(rows, fps, root))
    assert simhash.simhash_components(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = words(rng, 200, "abcdefghijklmnop").split()
    near = list(base)
    near[50] = "changed"
    other = words(rng, 200, "abcdefghijklmnop")
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, other), (4, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {(2, 1)}


def near_brute_force(data, size=5, similarity=0.8):
    """{(doc_id, component_id)} by comparing all pairs."""
    sets = [(i, set(simhash.shingles_of(simhash.words_of(t), size))) for i, t in data if i is not None and t and t.split()]
    root = {i: i for i, _ in sets}
    changed = True
    links = [(i, j) for i, s in sets for j, t in sets if i < j and len(s & t) >= similarity * len(s | t) - 1e-9]
    while changed:
        changed = False
        for i, j in links:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    linked = {i for pair in links for i in pair}
    return {(i, root[i]) for i in linked if i != root[i]}


def near_found(spark, data):
    docs = spark.createDataFrame(data, "doc_id long, text string")
    return {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect() if r.doc_id != r.component_id and r.doc_id is not None}


def test_near_duplicates_by_kind_of_edit(spark):
    rng, data = random.Random(6), []
    for n in (7, 60, 200, 800):
        for _ in range(6):
            base = words(rng, n, "abcdefghijklmnop").split()
            extra = words(rng, n, "abcdefghijklmnop").split()
            swap = [*base]
            swap[n // 2] = "changed"
            for copy in (base, base + extra[: n * 18 // 100], base[: n - n * 15 // 100], extra[: n // 10] + base, base[n // 3 :] + base[: n // 3], swap, base + extra[: n * 3 // 10]):
                data.append((len(data), " ".join(copy)))
    data += [(None, data[0][1]), (5000, None), (5001, ""), (5002, " "), (5003, "one"), (5004, "ONE"), (5005, data[1][1]), (5005, "a second row of one id")]
    want = near_brute_force(data)
    assert len(want) > 80 and near_found(spark, data) == want


def test_near_duplicates_in_a_crowd(spark):
    rng, data = random.Random(7), []
    shared = words(rng, 40, "abcdefghijklmnop")
    for _ in range(4):  # families of one template, apart from each other
        base = (shared + " " + words(rng, 60, "abcdefghijklmnop")).split()
        data.append((len(data), " ".join(rng.sample(base, len(base)))))
        for _ in range(12):
            copy = [*base]
            for i in rng.sample(range(40, 100), rng.randint(0, 3)):
                copy[i] = "x%d" % rng.randrange(3)
            data.append((len(data), " ".join(copy)))
    # the smallest id of a fingerprint has the words of the others in another order
    b = words(rng, 100, "abcdefghijklmnop").split()
    c = [*b]
    c[50], c[51] = c[51], c[50]
    data += [(1000, " ".join(reversed(b))), (1001, " ".join(b)), (1002, " ".join(c))]
    # a chain: each link holds, its ends are apart
    chain = words(rng, 120, "abcdefghijklmnop").split()
    data += [(2000 + k, " ".join(chain[8 * k : 8 * k + 80])) for k in range(5)]
    rng.shuffle(data)
    want = near_brute_force(data)
    assert (1002, 1001) in want and near_found(spark, data) == want


def test_language(spark, empty):
    rng = random.Random(2)
    known_words = {"a": words(rng, 60, "abcdefg").split(), "t": words(rng, 60, "tuvwxyz").split()}
    data = [(i, " ".join(rng.choices(known_words["at"[i % 2]], k=80)), "at"[i % 2]) for i in range(80)] + [(900, None, "a"), (901, "12 !", "t"), (902, "", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    known = langid.fit_dictionaries(docs, langid._held_out)
    got = {r.row.doc_id: r for r in langid.predict(docs, known).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in data[:80]) >= 76
    assert all(got[i].lang_pred == "und" and not got[i].accepted and got[i].score == 0 for i in (900, 901, 902))
    assert langid.fit_dictionaries(empty, langid._held_out) == {} and langid.predict(empty, {}).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(4)
    texts = [words(rng, 40) + (" vile scum" if i % 5 == 0 else "") for i in range(600)]
    labels = [int(i % 5 == 0) for i in range(600)]
    model = toxicity.train(texts[:400], labels[:400])
    right = [(model.score(*toxicity.word_ids(t)) >= 0.5) == bool(y) for t, y in zip(texts[400:], labels[400:])]
    assert sum(right) >= 0.95 * len(right)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, texts[0])], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(docs, model).collect())
    assert toxicity.score_documents(empty, toxicity.train([], [])).count() == 0


def test_ann(spark, empty):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(float)
    x[5] = x[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(vectors).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len({*np.lexsort((np.arange(600), d))[:10].tolist()} & {*got[q]})
    assert sorted(got) == list(range(0, 600, 100)) and hits >= 54 and got[0][0] == 5
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_hilbert_is_a_walk():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    keys = ann.hilbert_keys(cells, 3)
    path = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_encoder_matches_library(name):
    rng, e = random.Random(8), encoder(name)
    tokens = [t for t in (e.library.decode([i]) for i in range(0, 49000, 7)) if t]
    odd = "aeiou étñüßœ'’s'tñÀÖİſK. ,-\n\t\xa0\xad¿¡²³¼0123…日"
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 5))) for _ in range(5000)]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for text in [*texts, "x" * 10_000, "'S'T don't I'VE", " " * 5000 + "a"]:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids, ascii(text)
