"""Packing by cutting-stock column generation.

A document's ids are cut into full sequences and one remainder. Remainders are
counted by their length in tokens; a linear program over patterns of lengths says
how often each pattern is used, with columns priced by a knapsack dynamic program.
Rounded down, the patterns take documents by their rank in a length; what is left
over is placed by first fit decreasing. Only the histogram reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, small_batches, table, tidy, whole_text
from .tokens import BYTE_BPE, encoder

LENGTH = 2048
END_ID = 1
#: Sub-buckets of a length within which ranks are counted; one length may hold a third of all rows.
SUB_BUCKETS = 64
MAX_COLUMNS = 5000
#: Share by which the program may stay above its lower bound when it stops.
GAP = 0.001

PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(text: str, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(start, length, crc32, tokens of the document) of each piece: full sequences, then what remains."""
    ids = encoder(BYTE_BPE).encode(text) + END_ID.to_bytes(4, "little")
    n = len(ids) // 4
    return [(at, min(length, n - at), zlib.crc32(ids[4 * at : 4 * (at + length)]), n) for at in range(0, n, length)]


def _pieces(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(doc_id, *p) for doc_id, text in zip(f["doc_id"], f["text"]) for p in pieces_of(text, length)]
            yield pd.DataFrame(found, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        tidy()

    return run


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: (largest total value, copies of each size)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = np.searchsorted(sizes, room, "right")
        best[room] = best[room - 1]
        if n:
            total = best[room - sizes[:n]] + values[:n]
            i = int(total.argmax())
            if total[i] > best[room]:
                best[room], choice[room] = total[i], i
    copies, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            copies[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), copies


def solve(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern {size: copies}, times)] that together hold exactly the demand.

    Revised simplex over patterns; it starts from fractional first fit
    decreasing, prices columns by the knapsack and stops
    when no pattern could lower the total by more than GAP.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    columns, x, order = first_basis(sizes, need, capacity)
    inverse = inverted(columns, order)
    # duals are smoothed towards those with the best bound so far; at first a size is worth its share of a sequence
    centre, bound, weight = sizes / capacity, float(need @ sizes) / capacity, 0.9
    for _ in range(MAX_COLUMNS):
        dual, total = inverse.sum(axis=0), float(x.sum())
        if total <= bound * (1 + GAP):
            break
        mixed = np.maximum(weight * centre + (1 - weight) * dual, 0)
        value, copies = price(mixed, sizes, capacity)
        if value > 0 and (reached := float(need @ mixed) / value) > bound:  # mixed / value is feasible for the dual
            bound, centre = reached, mixed / value
        if dual @ copies <= 1 + 1e-9:  # no column for the true duals: smooth less
            if weight == 0:
                break
            weight = max(0.0, weight - 0.1) if weight > 0.05 else 0.0
            continue
        weight = 0.9
        held = np.flatnonzero(copies)
        direction = inverse[:, held] @ copies[held].astype(float)
        ok = direction > 1e-9
        ratio = np.where(ok, x / np.where(ok, direction, 1), np.inf)
        out = int(ratio.argmin())
        x -= ratio[out] * direction
        x[out] = ratio[out]
        columns[:, out] = copies
        pivot = inverse[out] / direction[out]
        moved = np.flatnonzero(direction)
        inverse[moved] -= np.outer(direction[moved], pivot)
        inverse[out] = pivot
    times = np.maximum(np.floor(x + 1e-6), 0).astype(np.int64)
    left = need.astype(np.int64) - columns.astype(np.int64) @ times
    while (left < 0).any():  # rounding errors of the floats; a pattern less each time
        short = int(np.flatnonzero(left < 0)[0])
        at = int(np.flatnonzero((columns[short] > 0) & (times > 0))[0])
        times[at] -= 1
        left += columns[:, at].astype(np.int64)
    out = [({int(s): int(c) for s, c in zip(sizes, columns[:, i]) if c}, int(t)) for i, t in enumerate(times) if t]
    return out + first_fit(dict(zip(sizes.tolist(), left.tolist())), capacity)


def inverted(matrix: np.ndarray, order: list[int]) -> np.ndarray:
    """Forward substitution, in plain numpy: LAPACK's threads can hang in a process that a JVM shares.

    Taken in the order, row i of the matrix has entries in column i and in
    columns before it only.
    """
    out = np.zeros_like(matrix)
    for i in order:
        out[i, i] = 1
        for k in np.flatnonzero(matrix[i]):
            if k != i:
                out[i] -= matrix[i, k] * out[k]
        out[i] /= matrix[i, i]
    return out


def first_basis(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(patterns as columns, times, order of the columns): fractional first fit decreasing.

    Each pattern is used until it exhausts a size, which no later one holds; so
    the columns are triangular and make a basis. Sizes exhausted by the way get
    a pattern of their own that is used zero times.
    """
    left, columns, x, order = need.copy(), np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes)), []
    while (left > 0).any():
        pattern, room = np.zeros(len(sizes)), capacity
        for i in np.flatnonzero(left > 0)[::-1]:
            n = min(room // int(sizes[i]), int(np.ceil(left[i])))
            pattern[i], room = n, room - n * int(sizes[i])
            if not room:
                break
        ratio = np.where(pattern > 0, left / np.where(pattern > 0, pattern, 1), np.inf)
        at = int(ratio.argmin())
        columns[:, at], x[at] = pattern, ratio[at]
        order.append(at)
        left = np.maximum(left - ratio[at] * pattern, 0)
        left[at] = 0
        left[left < 1e-9] = 0
    for i in np.flatnonzero(columns.sum(axis=0) == 0).tolist():
        columns[i, i] = capacity // sizes[i]
        order.append(i)
    return columns, x, order


def first_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """First fit decreasing over a histogram; equal sequences are made at once."""
    left, out = {s: n for s, n in left.items() if n}, []
    while left:
        pattern, room = {}, capacity
        for size in sorted(left, reverse=True):
            if n := min(left[size], room // size):
                pattern[size] = n
                room -= n * size
        times = min(left[s] // n for s, n in pattern.items())
        out.append((pattern, times))
        for s, n in pattern.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return out


def placements(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, rank after the last, first sequence, copies a sequence) of each pattern and size."""
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        for size, copies in pattern.items():
            start = used.get(size, 0)
            used[size] = start + copies * times
            rows.append((size, start, used[size], sequence, copies))
        sequence += times
    return rows


def pack_documents(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    Every id of every document, its end id included, lies in one piece; sequences
    hold at most `length` tokens and are numbered without gaps from 0. Null and
    empty texts are one end id. Rows that repeat an id are packed each on their
    own. padded_length is `length`, or what the sequence holds if that is a
    power of two. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cut = whole_text(docs, id_col, text_col).mapInPandas(_pieces(length), PIECES)
    pieces = saved(cut.withColumn("doc_id", F.col("doc_id").cast("long")), "pieces")
    sub = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SUB_BUCKETS)).cast("int")
    ranked = pieces.withColumn("size", F.col("length").cast("int")).withColumn("sub", sub)
    counts = ranked.groupBy("size", "sub").count().collect()  # at most length * SUB_BUCKETS rows
    demand: dict[int, int] = {}
    offsets = []
    for r in sorted(counts, key=lambda r: (r["size"], r["sub"])):
        offsets.append((r["size"], r["sub"], demand.get(r["size"], 0)))
        demand[r["size"]] = demand.get(r["size"], 0) + r["count"]
    placed = placements(solve(demand, length))
    # both tables are bounded by the number of lengths, not by the rows
    before = F.broadcast(spark.createDataFrame(offsets, "size int, sub int, before long"))
    where = F.broadcast(spark.createDataFrame(placed, "size int, low long, high long, sequence long, copies long"))
    local = F.row_number().over(W.partitionBy("size", "sub").orderBy("length", "doc_id", "start", "ids_crc32")) - 1
    out = ranked.withColumn("local", local).join(before, ["size", "sub"]).withColumn("rank", F.col("before") + F.col("local"))
    out = out.join(where, (out["size"] == where["size"]) & (out["rank"] >= where["low"]) & (out["rank"] < where["high"])).drop(where["size"])
    out = out.withColumn("sequence_id", F.expr("sequence + (rank - low) div copies"))
    order = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank")
    total = F.sum("length").over(W.partitionBy("sequence_id"))
    out = out.withColumn("offset", F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")).withColumn("total", total)
    padded = F.when(F.col("total").bitwiseAND(F.col("total") - 1) == 0, F.col("total")).otherwise(F.lit(length))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", padded.cast("long").alias("padded_length"))


def op7_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
