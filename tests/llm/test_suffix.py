"""Suffix dedup at its own width, past its chunks, and with one gram in most texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from factspark.llm import suffix_dedup


def words(rng, n, alphabet="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


def brute_force(rows, width):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = Counter()
    for (doc_id, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out[doc_id, len(d), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(spark, rows, width):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return Counter((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, width).collect())


def test_width_400(spark):
    rng = random.Random(1)
    passage, rows = words(rng, 160), []
    for i in range(24):
        own = words(rng, 60)
        cut = rng.randint(0, 300)
        rows.append((i, f"{own} {passage[cut : cut + rng.choice([399, 400, 401, 450, 600])]} {words(rng, 30)}"))
    rows += [(None, rows[0][1]), (3, "x" * 900), (30, "ab" * 350), (31, passage[:400]), (32, None), (33, "é" * 199 + passage[:402]), (34, "é" * 250)]
    want = brute_force(rows, 400)
    assert sum(1 for k in want if k[2]) > 15 and found(spark, rows, 400) == want


@pytest.mark.parametrize("cell", [3, 20])
def test_one_gram_in_most_texts(spark, cell):
    rng = random.Random(2)
    hot = words(rng, 12)  # shorter than a window, so that what is around it decides
    around = [(words(rng, 8), words(rng, 8)) for _ in range(5)]
    rows = []
    for i in range(60):
        a, b = rng.choice(around)[0], rng.choice(around)[1]
        rows.append((i, f"{words(rng, 5)} {a[rng.randint(0, 9) :]}{hot}{b[: len(b) - rng.randint(0, 9)]} {words(rng, 5)}"))
    suffix_dedup.CELL, old = cell, suffix_dedup.CELL
    try:
        got = found(spark, rows, len(hot.encode()) + 12)
    finally:
        suffix_dedup.CELL = old
    want = brute_force(rows, len(hot.encode()) + 12)
    assert sum(1 for k in want if k[2]) > 30 and got == want


def test_long_texts_in_chunks(monkeypatch):
    rng = random.Random(3)
    data = words(rng, 900).encode() + b"z" * 700

    def windows():
        out = {}
        for place, first, last, grams in suffix_dedup.spans_of(data, 90, 30):
            for p, a, b, g in zip(place.tolist(), first.tolist(), last.tolist(), grams.tolist()):
                out |= {i: (p - i, g) for i in range(a, b + 1)}
        return out

    whole = windows()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    assert whole == windows() and sorted(whole) == list(range(len(data) - 89))


@pytest.mark.parametrize("cell", [2, 2048])
def test_first_copies_stay(spark, tmp_path, monkeypatch, cell):
    rng = random.Random(4)
    monkeypatch.setattr(suffix_dedup, "CELL", cell)
    passages, width = [words(rng, 14) for _ in range(4)], 40
    rows = [(i, " ".join([words(rng, 4), *rng.sample(passages, 3), words(rng, 4)])) for i in range(30)] + [(None, None), (7, ""), (7, passages[0])]
    path = f"{tmp_path}/one"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = Counter((r.row.doc_id, r.kept_text) for r in suffix_dedup.remove_repeats(spark.read.parquet(path), width, keep_first=True).collect())
    seen, want = set(), Counter()
    for doc_id, t in rows:
        d = (t or "").encode()
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if d[i : i + width] in seen:
                gone[i : i + width] = True
            seen.add(d[i : i + width])
        want[doc_id, bytes(b for b, g in zip(d, gone) if not g).decode()] += 1
    assert got == want
