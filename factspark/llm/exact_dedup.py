"""Exact dedup over a cuckoo-filter index of live digests.

Every task pre-aggregates its own rows by digest, so a text that holds a third
of all rows leaves each task once. The partial groups meet by digest, where an
index per partition merges them: the cuckoo filter says whether a digest may be
live, a hit is verified against the content bucket that stores whole digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, saved, small_batches, table

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Live digests with a payload each.

    A bucket holds SLOTS 16-bit fingerprints; the two buckets of a digest differ
    by a hash of the fingerprint alone, so entries can move and be deleted
    without their digest. When an insertion overflows, the filter is rebuilt at
    twice the size from the stored digests.
    """

    def __init__(self, capacity: int = 1024) -> None:
        self.n_buckets = 1
        while self.n_buckets * SLOTS < capacity:
            self.n_buckets *= 2
        self.buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        self.content: dict[int, list[list]] = {}
        self.size = 0
        self.resizes = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & (self.n_buckets - 1)
        return fp, first, self._other(first, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & (self.n_buckets - 1)

    def may_contain(self, digest: bytes) -> bool:
        fp, a, b = self._places(digest)
        return fp in self.buckets[a] or fp in self.buckets[b]

    def get(self, digest: bytes) -> list | None:
        """The entry of a live digest: a filter hit counts only if the whole digest is stored."""
        if not self.may_contain(digest):
            return None
        for entry in self.content.get(int.from_bytes(digest[10:18], "big"), ()):
            if entry[0] == digest:
                return entry
        return None

    def insert(self, digest: bytes, payload: list) -> None:
        """Add a digest that is not live."""
        self.content.setdefault(int.from_bytes(digest[10:18], "big"), []).append([digest, *payload])
        self.size += 1
        if not self._place(digest):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        """Retire a live digest; false if it is not live."""
        entry = self.get(digest)
        if entry is None:
            return False
        key = int.from_bytes(digest[10:18], "big")
        self.content[key].remove(entry)
        if not self.content[key]:
            del self.content[key]
        fp, a, b = self._places(digest)
        self.buckets[a if fp in self.buckets[a] else b].remove(fp)
        self.size -= 1
        return True

    def entries(self) -> Iterator[list]:
        for bucket in self.content.values():
            yield from bucket

    def _place(self, digest: bytes) -> bool:
        fp, a, b = self._places(digest)
        for at in (a, b):
            if len(self.buckets[at]) < SLOTS:
                self.buckets[at].append(fp)
                return True
        at = a
        for kick in range(MAX_KICKS):
            self.buckets[at].append(fp)
            fp = self.buckets[at].pop(kick % SLOTS)
            at = self._other(at, fp)
            if len(self.buckets[at]) < SLOTS:
                self.buckets[at].append(fp)
                return True
        return False

    def _grow(self) -> None:
        while True:
            self.n_buckets *= 2
            self.resizes += 1
            self.buckets = [[] for _ in range(self.n_buckets)]
            if all(self._place(entry[0]) for entry in self.entries()):
                return


COLUMNS = ["digest", "known", "keep_id", "file", "place", "group_size"]
#: known is 0 for a null id, keep_id 0 then: a column without nulls keeps its longs in pandas.
GROUPS = "digest binary, known int, keep_id long, file long, place long, group_size long"


def _merged(frames: Iterator[pd.DataFrame]) -> CuckooIndex:
    """The live digests of a partition. A later row of a digest replaces the live one if it is the row that stays: that one is deleted, this one inserted."""
    index = CuckooIndex()
    for frame in frames:
        for digest, known, keep, file, place, n in zip(*(frame[c] for c in COLUMNS)):
            digest, rank = bytes(digest), (known, keep, -file, -place)
            entry = index.get(digest)
            if entry is None:
                index.insert(digest, [rank, int(n)])
            elif rank > entry[1]:
                n += entry[2]
                index.delete(digest)
                index.insert(digest, [rank, int(n)])
            else:
                entry[2] += int(n)
    return index


def _rows(index: CuckooIndex, chunk: int = 20_000) -> Iterator[pd.DataFrame]:
    out: list[list] = []
    for entry in index.entries():
        out.append(entry)
        if len(out) == chunk:
            yield _frame(out)
            out = []
    if out:
        yield _frame(out)


def _frame(entries: list[list]) -> pd.DataFrame:
    return pd.DataFrame([(digest, known, keep, -file, -place, n) for digest, (known, keep, file, place), n in entries], columns=COLUMNS)


def _partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups of one batch; the pre-aggregation before the shuffle."""
    for frame in frames:
        if len(frame):
            n = frame.groupby("digest", sort=False)["group_size"].sum()
            best = frame.sort_values(["known", "keep_id", "file", "place"], ascending=[False, False, True, True]).drop_duplicates("digest")
            yield best.assign(group_size=best["digest"].map(n))[COLUMNS]


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _rows(_merged(frames))


def _groups(rows: DataFrame) -> DataFrame:
    """GROUPS, one row a digest: the row that stays and how many there are, from rows (digest, doc_id, file, place)."""
    small_batches(rows.sparkSession)
    own = rows.select("digest", F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("keep_id"), "file", "place", F.lit(1).cast("long").alias("group_size"))
    groups = own.mapInPandas(_partial, GROUPS).repartition("digest").mapInPandas(_index, GROUPS)
    return groups.withColumn("keep_id", F.when(F.col("known") == 1, F.col("keep_id"))).drop("known")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), 256)).alias("digest")
    return saved(numbered(docs).select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "file", "place", digest), "digests")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, stays.

    Equal texts form a group (null counts as empty) and the row with the largest
    id stays. Null ids lose to any id. kept compares ids, so that rows that
    repeat an id and a text share one fate; stays holds for exactly one row of a
    group. An empty table gives an empty result. Other columns are ignored.
    """
    rows = _digests(docs, id_col, text_col)
    groups = _groups(rows).withColumnsRenamed({"file": "_file", "place": "_place"})
    stays = (F.col("file") == F.col("_file")) & (F.col("place") == F.col("_place"))
    joined = rows.join(groups, "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), stays.alias("stays"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one row of each group of equal texts: exact_dedup()'s that stays.

    Rows are told by their address, so that null and repeated ids lose no other
    text, and of a row that is there twice one stays. An empty table gives an
    empty result.
    """
    stays = _groups(_digests(docs, id_col, text_col)).select("file", "place")
    return numbered(docs).join(stays, ["file", "place"], "left_semi").select("row.*")


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("stays")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
