"""SimHash near-dedup: a binary-trie self-join over fingerprints.

Equal fingerprints meet in a pre-aggregated groupBy, so only distinct ones go
on. Fingerprints within `budget` bits agree in at least one of budget + 1
blocks; each is sent once per block, rotated so that the block comes first, to
the task that has all fingerprints with that block. There the sorted
fingerprints are an implicit binary trie: node pairs are traversed together, bit
by bit, and a pair is pruned once its differing bits exceed the budget. A task
returns a spanning forest of its links; the forests are joined to components by
alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import discard, numbered, saved, small_batches, table, whole_text
from .graph import components
from .shingles import mixed, shingle_set, shingles_of, words_of  # noqa: F401

BITS = 64
#: Shingles counted at a time, so that very long texts need bounded memory.
CHUNK = 65_536


def fingerprint(text: str, size: int = 3) -> int:
    """64-bit SimHash over XXH64 (seed 42) of the shingles; 0 without words."""
    return majority(shingles_of(words_of(text), size), 42)


def majority(features: list[bytes], seed: int) -> int:
    """Bits set in over half of the features' XXH64."""
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, len(features), CHUNK):
        h = np.frombuffer(b"".join([digest(s, seed) for s in features[i : i + CHUNK]]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(features)).tobytes(), "big")


def _fingerprints(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = np.array([fingerprint(t, size) for t in f["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": f["doc_id"], "fp": found.view(np.int64)})

    return run


def block_widths(budget: int) -> list[int]:
    blocks = budget + 1
    return [BITS * (i + 1) // blocks - BITS * i // blocks for i in range(blocks)]


def trie_links(keys: np.ndarray, first: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted distinct uint64 keys that agree in the first bits and differ in at most `budget` others.

    All tries, one for each value of the first bits, are traversed at once; a
    node is a range of keys, a row here a pair of nodes of one depth.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    head = keys >> np.uint64(BITS - first) if first else np.zeros(len(keys), np.uint64)
    lo = np.flatnonzero(np.r_[True, head[1:] != head[:-1]]) if len(keys) else np.zeros(0, np.int64)
    hi = np.r_[lo[1:], len(keys)].astype(np.int64) if len(keys) else lo
    keep = hi - lo > 1
    a, b, c, d, e = lo[keep], hi[keep], lo[keep], hi[keep], np.zeros(int(keep.sum()), np.int64)
    for bit in range(BITS - first - 1, -1, -1):
        if not len(a):
            break
        one = np.uint64(1 << bit)
        above = np.uint64((0xFFFFFFFFFFFFFFFF << (bit + 1)) & 0xFFFFFFFFFFFFFFFF)

        def middle(start, end):
            return np.clip(np.searchsorted(keys, (keys[start] & above) | one), start, end)

        m, n = middle(a, b), middle(c, d)
        same = a == c
        parts = [(a, m, c, n, e), (m, b, n, d, e), (a, m, n, d, e + 1)]
        other = ~same
        parts.append((m[other], b[other], c[other], n[other], e[other] + 1))
        a, b, c, d, e = map(np.concatenate, zip(*parts))
        keep = (e <= budget) & (b > a) & (d > c) & ~((a == c) & (b - a == 1))
        a, b, c, d, e = a[keep], b[keep], c[keep], d[keep], e[keep]
        leaf = (b - a == 1) & (d - c == 1)
        if leaf.any():
            x, y = a[leaf], c[leaf]
            near = np.bitwise_count(keys[x] ^ keys[y]) <= budget
            found.append((x[near], y[near]))
            a, b, c, d, e = a[~leaf], b[~leaf], c[~leaf], d[~leaf], e[~leaf]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found)))


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index linked to each of n."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _links(budget: int):
    widths = block_widths(budget)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [f for f in frames if len(f)]
        if not rows:
            return
        part = pd.concat(rows)
        for block, group in part.groupby("block"):
            turn = np.uint64(sum(widths[:block]))
            fps = np.unique(group["fp"].to_numpy(np.int64).view(np.uint64))
            keys = (fps << turn) | (fps >> (np.uint64(BITS) - turn)) if turn else fps
            order = np.argsort(keys)
            keys, fps = keys[order], fps[order]
            root = forest(len(keys), *trie_links(keys, widths[block], budget))
            at = np.flatnonzero(root != np.arange(len(root)))
            yield pd.DataFrame({"a": fps[at].view(np.int64), "b": fps[root[at]].view(np.int64)})

    return run


def link_edges(fps: DataFrame, budget: int) -> DataFrame:
    """Spanning edges (a, b) between distinct fingerprints of column fp that differ in at most `budget` bits."""
    parts, at = [], 0
    for block, width in enumerate(block_widths(budget)):
        value = F.shiftrightunsigned("fp", BITS - at - width).bitwiseAND((1 << width) - 1)
        parts.append(F.struct(F.lit(block).alias("block"), value.alias("value")))
        at += width
    sent = fps.select("fp", F.explode(F.array(*parts)).alias("p")).select("fp", "p.block", "p.value")
    return sent.repartition("block", "value").mapInPandas(_links(budget), "a long, b long")


def simhash_components(docs: DataFrame, size: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most `budget` bits are linked;
    component_id is the smallest doc_id that links reach. Null and empty texts
    have fingerprint zero and are linked like others. Null ids never become a
    component's id unless it has no other. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = whole_text(docs, id_col, text_col)
    marked = saved(rows.mapInPandas(_fingerprints(size), "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long")), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(link_edges(distinct, budget))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of shingle hashes, mixed anew so that it doesn't hang on their order."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        again = mixed(hashes[i : i + CHUNK] + np.uint64(0x9E3779B97F4A7C15))
        ones += np.unpackbits(again.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _set_fingerprints(grams: pd.Series) -> pd.Series:
    return pd.Series(np.array([set_fingerprint(np.asarray(g, np.int64).view(np.uint64)) for g in grams], np.uint64).view(np.int64))


def near_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, place, doc_id, root) of the rows of docs that have words; linked rows have one root.

    Two texts are linked if and only if their sets of `size`-word shingles have a
    Jaccard similarity of at least `similarity` (in hundredths); shingles and
    sets are told by 64-bit hashes, equal sets are one node. First the binary
    tries of the sets' SimHashes are joined with themselves, and pairs within
    `budget` bits are verified: this finds most groups at little cost. Links
    beyond the budget are found by the prefix join of n-grams, which leaves out
    what is in one group already.
    """
    percent = round(100 * similarity)
    texts = jaccard.addressed(docs, id_col, text_col)
    marks = saved(jaccard.ngram_marks(texts, size, percent).filter("n > 0"), "marks")
    some = jaccard.may_link(marks, percent)
    held = saved(jaccard.ngram_sets(texts, some, size), "held")
    sets = saved(jaccard.rare_first(held, percent), "sets")
    fps = saved(held.join(sets.select("key"), "key", "left_semi").select("key", F.pandas_udf(_set_fingerprints, "long")("grams").alias("fp")), "fingerprints")
    pairs = _trie_pairs(fps, budget)
    roots = saved(jaccard.joined(sets, percent, components(jaccard.verified(pairs, sets, percent))), "roots")
    discard(some, held, sets, fps, pairs)
    return marks.select("file", "place", "doc_id", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("file", "place", "doc_id", F.coalesce("root", "key").alias("root"))


def _trie_pairs(fps: DataFrame, budget: int) -> DataFrame:
    """Spanning pairs (a, b) of keys whose fingerprints are equal or linked in the trie."""
    first = saved(fps.groupBy("fp").agg(F.min("key").alias("first")), "first")
    equal = fps.join(first, "fp").filter("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    near = link_edges(first.select("fp"), budget).select(F.col("a").alias("x"), F.col("b").alias("y"))
    left, right = first.select(F.col("fp").alias("x"), F.col("first").alias("a")), first.select(F.col("fp").alias("y"), F.col("first").alias("b"))
    return saved(equal.unionByName(near.join(left, "x").join(right, "y").select("a", "b")).distinct(), "pairs")


def _surplus(docs: DataFrame, size: int, similarity: float, budget: int, id_col: str, text_col: str) -> DataFrame:
    """The rows (file, place, doc_id) that have a near-duplicate that stays, with the group's first row and its number of rows."""
    rows = saved(near_groups(docs, size, similarity, budget, id_col, text_col), "near")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "place")).alias("first")
    groups = rows.groupBy("root").agg(first, F.count("*").alias("n")).filter("n > 1")
    return rows.join(groups, "root").filter("file <> first.file or place <> first.place")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, links) of rows that keep_one() drops: the id of the row that stays, and the other rows of the group.

    near_groups() says what a link is. Rows without words have no links. A null
    id stays only where its group has no other. Nothing is returned for rows
    without links, nor for an empty table.
    """
    return _surplus(docs, size, similarity, budget, id_col, text_col).select("doc_id", F.col("first.doc_id").alias("component_id"), (F.col("n") - 1).alias("links"))


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one row of each group of near-duplicates: the one of smallest id, null ids last.

    Rows are told by their address, so that repeated and null ids lose no other
    text; of rows that are equal in all columns one stays. Rows without words
    all stay. An empty table gives an empty result.
    """
    gone = _surplus(docs, size, similarity, budget, id_col, text_col).select("file", "place")
    return numbered(docs).join(gone, ["file", "place"], "left_anti").select("row.*")


def op10_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))
