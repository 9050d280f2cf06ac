"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of two hashed embeddings, so two words share all of
it only if both hashes collide. Filters of several widths run over the whole
text, each keeps its largest value, and a logistic layer scores them. Thresholds
are calibrated for each language, which is told from the text alone by its
commonest short words; a score is shifted so that its threshold lies at 0.5.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, small_batches, table

#: Bounded sample of labelled rows that the classifier is fitted on.
SAMPLE_ROWS = 5000
BUCKETS = 1 << 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 7
#: A hashed word is learned only if so many fitted texts hold it; rarer ones would only be memorised.
MIN_TEXTS = 4
BATCH = 32
WORD = re.compile(r"\w+")
#: Words scored at a time, so that very long texts need bounded memory.
CHUNK = 1 << 17
#: Frequent function words by which a text's language group is told.
FUNCTION_WORDS = {
    "de": ("der", "die", "das", "und", "nicht", "mit", "sich", "den", "von", "zu"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "this"),
    "es": ("el", "los", "las", "de", "que", "y", "en", "una", "por", "para"),
    "fr": ("le", "les", "des", "et", "une", "dans", "est", "pour", "qui", "elle"),
}


@functools.lru_cache(maxsize=400_000)
def _word(word: str) -> tuple[int, int]:
    data = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) % BUCKETS, BUCKETS + zlib.adler32(data[::-1], zlib.crc32(data, 0x9E3779B9) & 0xFFFF) % BUCKETS


def word_ids(text: str | None) -> tuple[np.ndarray, str]:
    """((words, 2) hashed ids, language group) of a whole text."""
    words = WORD.findall((text or "").lower())
    ids = np.array(list(map(_word, words)), np.int32).reshape(-1, 2)
    seen = set(words)
    hits = {lang: sum(w in seen for w in known) for lang, known in FUNCTION_WORDS.items()}
    best = max(hits, key=lambda k: (hits[k], k))
    return ids, best if hits[best] else "other"


class Model:
    """Parameters and their Adagrad sums."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        # words never seen in training keep a zero vector and can't win a maximum by chance
        self.embedding = np.zeros((2 * BUCKETS, DIM), np.float32)
        self.filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32)
        self.out_bias = np.float32(-1.0)
        self.shift: dict[str, float] = {}

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest value of each filter, where it starts) over a whole text, in chunks that overlap by the widest filter."""
        n = len(ids)
        top = np.full(len(self.bias), -np.inf, np.float32)
        where = np.zeros(len(self.bias), np.int64)
        over = max(WIDTHS) - 1
        for start in range(0, max(n, 1), CHUNK):
            part = ids[start : start + CHUNK + over]
            v = np.zeros((max(1, len(part)) + over, DIM), np.float32)  # zeros beyond the end, and for no words
            v[: len(part)] = self.embedding[part[:, 0]] + self.embedding[part[:, 1]]
            m = max(1, min(len(part), CHUNK))
            for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                y = v[:m] @ f[0]
                for j in range(1, w):
                    y = y + v[j : m + j] @ f[j]
                at = slice(k * FILTERS, (k + 1) * FILTERS)
                i = y.argmax(axis=0)
                best = y[i, np.arange(FILTERS)]
                where[at] = np.where(best > top[at], i + start, where[at])
                top[at] = np.maximum(top[at], best)
        return top, where

    def logit(self, ids: np.ndarray) -> float:
        top, _ = self.pooled(ids)
        return float(np.maximum(top + self.bias, 0) @ self.out + self.out_bias)

    def score(self, ids: np.ndarray, lang: str) -> float:
        z = self.logit(ids) - self.shift.get(lang, self.shift.get("", 0.0))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str | None], labels: list[int], seed: int = 5) -> Model:
    """Fit on (text, label) rows and calibrate a threshold for each language group on every fourth row, which training skips."""
    model, rng = Model(seed), np.random.default_rng(seed)
    if not texts or len(set(labels)) < 2:
        model.shift[""] = 0.0
        return model
    data = [word_ids(t) for t in texts]
    y = np.array(labels, np.float32)
    fit = [i for i in range(len(data)) if i % 4] if len(data) >= 200 else list(range(len(data)))
    held_by = np.zeros(2 * BUCKETS, np.int32)
    for i in fit:
        held_by[np.unique(data[i][0])] += 1
    learned = held_by >= MIN_TEXTS
    weight = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0) ** 0.5
    sums = {"e": np.zeros((2 * BUCKETS, 1), np.float32), "f": [np.zeros_like(f) for f in model.filters], "o": np.zeros_like(model.out), "b": np.zeros_like(model.bias), "ob": np.float32(0)}

    def step(total, grad, rate):
        total += grad * grad
        return rate * grad / (np.sqrt(total) + 1e-6)

    for epoch in range(EPOCHS):
        rate = 0.1 if epoch < EPOCHS // 2 else 0.04
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            g_out, g_bias, g_ob = np.zeros_like(model.out), np.zeros_like(model.bias), np.float32(0)
            g_f = [np.zeros_like(f) for f in model.filters]
            rows, grads = [], []
            for i in batch:
                ids, _ = data[i]
                top, where = model.pooled(ids)
                h = np.maximum(top + model.bias, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.out_bias, -30, 30)))
                g = np.float32(weight[i] * (p - y[i]) / len(batch))
                g_out += g * h
                g_ob += g
                g_h = np.where(top + model.bias > 0, g * model.out, 0) + (g * model.out * 0.05 if not h.any() else 0)
                g_bias += g_h
                for k, (w, f) in enumerate(zip(WIDTHS, model.filters)):
                    at, gh = where[k * FILTERS : (k + 1) * FILTERS], g_h[k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        ok = at + j < len(ids)
                        pairs = ids[np.minimum(at + j, max(len(ids) - 1, 0))] if len(ids) else np.zeros((0, 2), np.int32)
                        if not len(pairs):
                            continue
                        v = model.embedding[pairs[:, 0]] + model.embedding[pairs[:, 1]]
                        g_f[k][j] += (v * (gh * ok)[:, None]).T
                        for side in (0, 1):
                            rows.append(pairs[:, side])
                            grads.append(f[j].T * (gh * ok)[:, None])
            model.out -= step(sums["o"], g_out, rate)
            model.bias -= step(sums["b"], g_bias, rate)
            sums["ob"] += g_ob * g_ob
            model.out_bias -= rate * g_ob / (np.sqrt(sums["ob"]) + 1e-6)
            for f, total, g in zip(model.filters, sums["f"], g_f):
                f -= step(total, g, rate)
            if rows:
                rows, grads = np.concatenate(rows), np.concatenate(grads)
                rows, grads = rows[learned[rows]], grads[learned[rows]]
                at, inverse = np.unique(rows, return_inverse=True)
                g_e = np.zeros((len(at), DIM), np.float32)
                np.add.at(g_e, inverse, grads)
                sums["e"][at] += (g_e * g_e).mean(axis=1, keepdims=True)
                model.embedding[at] -= rate * g_e / (np.sqrt(sums["e"][at]) + 1e-6)
    held = [i for i in range(len(data)) if i % 4 == 0]
    z = np.array([model.logit(data[i][0]) for i in held])
    groups = np.array([data[i][1] for i in held])
    model.shift[""] = _threshold(z, y[held])
    for lang in set(groups):
        at = groups == lang
        if (y[held][at] == 1).sum() >= 8 and (y[held][at] == 0).sum() >= 8:
            model.shift[str(lang)] = _threshold(z[at], y[held][at])
    return model


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit with the fewest errors, in the middle of the gap."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    wrong = np.r_[0, np.cumsum(y == 1)] + ((y == 0).sum() - np.r_[0, np.cumsum(y == 0)])
    best = np.flatnonzero(wrong == wrong.min())
    i = int(best[len(best) // 2])
    if i in (0, len(z)):
        return float(z[0] - 1 if i == 0 else z[-1] + 1)
    return float((z[i - 1] + z[i]) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out, label_col: str = "toxic") -> Model:
    """Train on at most about SAMPLE_ROWS labelled rows that are not held out, taken by a hash of their id."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30))
    chosen = known.filter(draw < int((1 << 30) * min(1, SAMPLE_ROWS / max(n, 1)))).groupBy("doc_id").agg(F.max("label").alias("label"))
    # about SAMPLE_ROWS ids, so their broadcast is bounded
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] for r in found], [r["label"] for r in found])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 from 0.5 on) for every row.

    Null and empty texts are scored as no words. An empty table gives an empty
    result; without labels of both kinds every score is that of an untrained model.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # 17 MB whatever the table: the embeddings have a fixed size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for f in frames:
            s = np.array([m.score(*word_ids(t)) for t in f["text"]])
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    # ids are text in Python, see whole_text()
    scored = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double, predicted int")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def _held_out(doc_id):
    return F.pmod(id_crc(doc_id), F.lit(5)) == 0


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), _held_out)
    return score_documents(docs, model).select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
