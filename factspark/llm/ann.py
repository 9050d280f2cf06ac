"""Approximate nearest neighbours over shifted space-filling curves.

Vectors are projected onto a few random directions, differently for each curve,
shifted and put in Hilbert order. Each curve is range-partitioned into blocks of
keys; a query visits the blocks whose keys lie in a window around its own, finds
its nearest rows in each, and the windows of all curves are merged and reranked
by exact distance. How wide the window must be is fitted on a bounded sample, as
a share of the order, so that recall there reaches the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table

CURVES = 4
DIMS, ORDER = 6, 10
SAMPLE = 4096
SAMPLE_QUERIES = 256
TARGET = 0.95
#: Rows of a block; a range of keys that holds more (equal vectors) is dealt to several.
BLOCK = 2048
SHARES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of unsigned integer coordinates below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = q = 1 << (bits - 1)
    while q > 1:  # undo the turns of every level, from the outermost in
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _orthonormal(columns: np.ndarray) -> np.ndarray:
    out = columns.copy()
    for i in range(out.shape[1]):
        for j in range(i):
            out[:, i] -= (out[:, i] * out[:, j]).sum() * out[:, j]
        out[:, i] /= np.sqrt((out[:, i] ** 2).sum())
    return out


class Curves:
    """Projections, shifts and scales of all curves, fitted on a sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.directions = [_orthonormal(rng.normal(size=(dim, min(dim, DIMS)))) for _ in range(curves)]
        spread = [sample @ d for d in self.directions]
        self.low = [s.min(axis=0) for s in spread]
        self.scale = [np.maximum(s.max(axis=0) - s.min(axis=0), 1e-12) for s in spread]
        self.shift = [rng.uniform(0, 0.5, d.shape[1]) for d in self.directions]

    def keys(self, curve: int, vectors: np.ndarray) -> np.ndarray:
        unit = (vectors @ self.directions[curve] - self.low[curve]) / self.scale[curve]
        cells = np.clip((unit + self.shift[curve]) / 1.5, 0, 1) * ((1 << ORDER) - 1)
        return hilbert_keys(cells.astype(np.int64), ORDER)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, distance) of the k nearest other rows of each query; ties to smaller ids."""
    out = ([], [], [])
    norms = (rows**2).sum(axis=1)
    for i in range(0, len(queries), 256):
        q, ids = queries[i : i + 256], query_ids[i : i + 256]
        rough = (q**2).sum(axis=1)[:, None] + norms - 2 * (q @ rows.T)
        rough[row_ids[None, :] == ids[:, None]] = np.inf
        n = min(k, len(rows))
        kth = np.partition(rough, n - 1, axis=1)[:, n - 1]
        scale = (q**2).sum(axis=1) + norms.max(initial=0)
        for j in range(len(q)):
            # the rough sums may err; whatever could be among the nearest is measured exactly
            near = np.flatnonzero(rough[j] <= (kth[j] if np.isfinite(kth[j]) else np.finfo(float).max) + 1e-9 * scale[j])
            exact = np.sqrt(((rows[near] - q[j]) ** 2).sum(axis=1))
            best = np.lexsort((row_ids[near], exact))[:k]
            out[0].append(np.full(len(best), ids[j]))
            out[1].append(row_ids[near][best])
            out[2].append(exact[best])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def fit_share(sample: np.ndarray, curves: Curves, k: int, target: float = TARGET) -> float:
    """The smallest share of each order that a window must hold for the sample's recall to reach the target."""
    n = len(sample)
    if n <= 2 * k:
        return 2.0
    queries = np.arange(0, n, max(1, n // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    q = sample[queries]
    d = (q**2).sum(axis=1)[:, None] + (sample**2).sum(axis=1) - 2 * q @ sample.T
    d[np.arange(len(queries)), queries] = np.inf
    true = np.argpartition(d, k, axis=1)[:, :k]
    gaps = np.full(true.shape, n, np.int64)
    for c in range(len(curves.directions)):
        rank = np.empty(n, np.int64)
        rank[np.argsort(curves.keys(c, sample), kind="stable")] = np.arange(n)
        gaps = np.minimum(gaps, np.abs(rank[true] - rank[queries][:, None]))
    for share in SHARES:
        if (gaps <= share * n / 2).mean() >= target:
            return share
    return 2.0  # half of it to either side reaches every row


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with v an array of doubles; vectors null, zero or with null or non-finite components are left out."""
    v = F.col("v")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def search(vectors: DataFrame, k: int = 10, query_modulus: int = 100, curves: int = CURVES, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by query_modulus.

    score is the Euclidean distance of the original vectors in double precision;
    ties go to smaller ids, and a query is no candidate of its own. Rows without
    an id and invalid vectors take no part, nor do vectors of another length than
    most of the sample. Rows that repeat an id count once, by their first vector
    in order. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = valid_vectors(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = saved(rows, "vectors")
    total = rows.count()
    draw = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 30))
    taken = rows.filter(draw < int((1 << 30) * min(1, SAMPLE / max(total, 1)))).orderBy("vec_id").collect()  # about SAMPLE rows
    if not taken:
        taken = rows.limit(1).collect()
    if not taken:
        return spark.createDataFrame([], schema)
    dim = int(np.bincount([len(r["v"]) for r in taken]).argmax())
    sample = np.array([r["v"] for r in taken if len(r["v"]) == dim])
    fitted = Curves(sample, curves)
    share = fit_share(sample, fitted, k, target)
    blocks = max(1, min(len(sample) // 4, -(-total // BLOCK)))
    bounds = [np.quantile(fitted.keys(c, sample), np.arange(1, blocks) / blocks, method="nearest") for c in range(curves)]
    reach = max(1, int(np.ceil(share * blocks / 2)))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            v = np.array(f["v"].tolist())
            for c in range(curves):
                at = np.searchsorted(bounds[c], fitted.keys(c, v), "right")
                yield pd.DataFrame({"curve": c, "block": at, "vec_id": f["vec_id"], "v": f["v"]})

    placed = saved(rows.filter(F.size("v") == dim).mapInPandas(place, "curve int, block int, vec_id long, v array<double>"), "placed")
    counts = {(r["curve"], r["block"]): r["count"] for r in placed.groupBy("curve", "block").count().collect()}  # at most curves * SAMPLE / 4 rows
    parts = {key: -(-n // (2 * BLOCK)) for key, n in counts.items()}
    sizes = F.broadcast(spark.createDataFrame([(c, b, p) for (c, b), p in parts.items()], "curve int, block int, parts int"))
    cand = placed.join(sizes, ["curve", "block"]).select("curve", "block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", "v")
    asking = placed.filter(F.pmod("vec_id", F.lit(query_modulus)) == 0)
    visits = F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(blocks - 1))))
    asking = asking.select("curve", visits.alias("block"), "vec_id", "v").join(sizes, ["curve", "block"])
    asking = asking.select("curve", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "vec_id", "v")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        if not asks.any() or asks.all():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        v, ids = np.array(group["v"].tolist()), group["vec_id"].to_numpy(np.int64)
        q, found, score = nearest(v[asks], ids[asks], v[~asks], ids[~asks], k)
        keep = np.isfinite(score) & (q != found)
        return pd.DataFrame({"query_id": q[keep].astype(np.int64), "vec_id": found[keep].astype(np.int64), "score": score[keep]})

    found = cand.unionByName(asking).groupBy("curve", "block", "part").applyInPandas(meet, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))
