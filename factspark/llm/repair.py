"""Token-id files compressed by Re-Pair grammars.

A shard is a run of documents in ascending id order. Its id stream is compressed
by replacing frequent pairs by nonterminals, again and again; the shard stores
the rules, how many ids each rule expands to, the remaining symbols and a
position index, so that any range of ids is decoded without the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, table, whole_text
from .tokens import WORD_BPE, encoder

END_ID = 2
#: Times that a pair must occur to be replaced.
LEAST = 8
#: Factor by which the number of times that a pair must occur is lowered, down to LEAST.
SHARE = 0.5
#: Ids after which a shard is closed.
SHARD_IDS = 1 << 20
INDEX_STEP = 1024
#: Ids that a reader of all documents decodes at a time.
READ_IDS = 1 << 16
#: Longest expansion of a rule that a reader keeps ready.
TABLE_IDS = 256
MAGIC = b"RPG2"


def _first_of_runs(at: np.ndarray) -> np.ndarray:
    """Mask of every second place of each run of neighbouring places, its first included: pairs of a run a a a don't overlap."""
    keep = np.ones(len(at), bool)
    twin = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
    if len(twin):
        start = np.maximum.accumulate(np.where(np.r_[True, twin[1:] != twin[:-1] + 1], np.arange(len(twin)), 0))
        keep[twin[(np.arange(len(twin)) - start) % 2 == 0]] = False
    return keep


def _frequent(keys: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (first * n + second) of pairs that occur `least` times, taken from the most frequent on, and the keys left for later.

    No id is the first of one chosen pair and the second of another.
    """
    keys = np.sort(keys)
    edge = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1] if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.r_[edge, len(keys)])
    enough = np.flatnonzero(times >= least)
    found = keys[edge[enough[np.argsort(-times[enough], kind="stable")]]]
    firsts, seconds, chosen = set(), set(), np.ones(len(found), bool)
    for i, (a, b) in enumerate(zip((found // n).tolist(), (found % n).tolist())):
        if b in firsts or a in seconds or (a == b and (a in firsts or a in seconds)):
            chosen[i] = False
            continue
        firsts.add(a)
        seconds.add(b)
    return np.sort(found[chosen]), found[~chosen]


def compress(ids: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule i stands for symbol terminals + i and has two symbols.

    Pairs are counted exactly and replaced, frequent ones first: the number of
    times that a pair must occur falls with each round until it is LEAST, and
    rounds go on until no pair occurs so often. An id of a pair occurs at least
    as often as the pair, so by the counts of ids rarer ones are left out before
    pairs are sorted and counted; the others are ranked, so that a key is short.
    """
    seq, rules, base = ids.astype(np.int64), [], terminals
    counts, fresh = np.bincount(seq, minlength=terminals), None
    least = max(LEAST, int(counts.max() * SHARE))
    while len(seq) >= 2 * LEAST:
        often = np.flatnonzero(counts >= least)
        n = len(often) + 1
        rank = np.zeros(base, np.uint32 if n * n <= 1 << 32 else np.uint64)
        rank[often] = np.arange(1, n)
        rank = rank.take(seq)
        some = rank != 0
        both = some[:-1] & some[1:]
        if fresh is not None:
            new = fresh.take(seq)
            both &= new[:-1] | new[1:]
        twins = np.flatnonzero(both & (rank[1:] == rank[:-1]))
        both[twins[~_first_of_runs(twins)]] = False
        keys = rank[:-1] * rank.dtype.type(n)
        keys += rank[1:]
        pairs, later = _frequent(keys[both], n, least)
        if not len(pairs) and least == LEAST:
            break
        if least == LEAST:  # all pairs without a marked id are rarer from here on
            fresh = np.zeros(base + len(pairs), bool)
            fresh[base:] = True
            fresh[often[later // n - 1]] = True
        least = max(LEAST, int(least * SHARE))
        if not len(pairs):
            continue
        a, b = often[pairs // n - 1], often[pairs % n - 1]
        side = np.zeros(base, np.uint8)  # 1: first of a chosen pair, 2: second, 3: both
        side[a] = 1
        side[b] |= 2
        side = side.take(seq)
        both &= (side[:-1] & (side[1:] >> 1)).view(bool)
        at = np.flatnonzero(both)
        keys = keys.take(at)
        which = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
        hit = np.flatnonzero(pairs.take(which) == keys)
        hit = hit[_first_of_runs(at.take(hit))]
        at, which = at.take(hit), which.take(hit)
        seq[at] = base + which
        used = np.bincount(which, minlength=len(pairs))
        np.subtract.at(counts, a, used)
        np.subtract.at(counts, b, used)
        counts = np.r_[counts, used]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        base += len(pairs)
        rules.append(np.stack([a, b], axis=1).astype(np.uint32))
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), seq.astype(np.uint32)


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of values of so many bits each."""
    wide = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits], bitorder="little")


def unpacked(data: np.ndarray, bits: int, first: int, n: int) -> np.ndarray:
    """n values from the first on, which is a multiple of 8."""
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = np.unpackbits(data[first // 8 * bits : -(-(first + n) * bits // 8)], bitorder="little", count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each rule expands to; a rule uses earlier ones only."""
    out = np.zeros(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - terminals] if a >= terminals else 1) + (out[b - terminals] if b >= terminals else 1)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids of a run of symbols, rule by rule."""
    seq = symbols.astype(np.int64)
    while (deep := seq >= terminals).any():
        seq = _opened(seq, deep, rules, terminals)
    return seq.astype(np.uint32)


def _opened(seq: np.ndarray, deep: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """seq with its nonterminals at `deep` replaced by their two symbols."""
    width = 1 + deep
    at = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.int64)
    out[at[~deep]] = seq[~deep]
    pair = rules[seq[deep] - terminals]
    out[at[deep]], out[at[deep] + 1] = pair[:, 0], pair[:, 1]
    return out


class Expansions:
    """What symbols of up to TABLE_IDS ids expand to, laid out once, ids themselves first; longer ones are opened until they are so short."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> None:
        self.rules, self.terminals = rules, terminals
        self.lengths = np.r_[np.ones(terminals, np.int64), lengths]
        self.longest = int(self.lengths.max(initial=1))
        laid = np.where(self.lengths <= TABLE_IDS, self.lengths, 0)
        self.at = np.cumsum(laid) - laid
        self.flat = np.empty(int(laid.sum()), np.uint32)
        self.flat[:terminals] = np.arange(terminals)
        at, each = self.at.tolist(), self.lengths.tolist()
        for i, pair in enumerate(rules.tolist(), terminals):
            if each[i] > TABLE_IDS:
                continue
            to = at[i]
            for symbol in pair:
                n = each[symbol]
                self.flat[to : to + n] = self.flat[at[symbol] : at[symbol] + n]
                to += n

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        seq = symbols.astype(np.int64)
        n = self.lengths.take(seq)
        while self.longest > TABLE_IDS and (long := n > TABLE_IDS).any():
            seq = _opened(seq, long, self.rules, self.terminals)
            n = self.lengths.take(seq)
        place = np.repeat(self.at.take(seq) - np.cumsum(n) + n, n)
        place += np.arange(len(place))
        return self.flat.take(place)


def write_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, terminals: int) -> bytes:
    """The bytes of a shard file."""
    rules, symbols = compress(ids, terminals)
    lengths = expansion_lengths(rules, terminals)
    each = np.ones(len(symbols), np.int64)
    deep = symbols >= terminals
    each[deep] = lengths[symbols[deep] - terminals]
    index = (np.cumsum(each) - each)[::INDEX_STEP]
    bits = (terminals + len(rules)).bit_length()
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<IIIIIB", terminals, len(rules), len(symbols), len(doc_ids), len(index), bits)
    body = [packed(rules.ravel(), bits), lengths.astype("<u4"), packed(symbols, bits), index.astype("<u8"), np.array([d or 0 for d in doc_ids], "<i8"), null, np.array(counts, "<u4")]
    return head + b"".join(x.tobytes() for x in body)


class Shard:
    """A shard file read back."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        self.terminals, rules, self.n_symbols, docs, index, self.bits = struct.unpack_from("<IIIIIB", data, 4)
        at = 4 + struct.calcsize("<IIIIIB")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = unpacked(take("u1", -(-2 * rules * self.bits // 8)), self.bits, 0, 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        self.packed = take("u1", -(-self.n_symbols * self.bits // 8))
        self.index, ids = take("<u8", index), take("<i8", docs)
        self.doc_ids = [None if null else int(i) for i, null in zip(ids, take("u1", docs))]
        self.counts = take("<u4", docs)
        self.expansions = Expansions(self.rules, self.lengths, self.terminals)

    def symbols(self, first: int, last: int) -> np.ndarray:
        return unpacked(self.packed, self.bits, first, min(last, self.n_symbols) - first)

    def all_ids(self) -> np.ndarray:
        return self.expansions.ids(self.symbols(0, self.n_symbols))

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a position on: the index and the expansion lengths tell which symbols cover them, and only these are expanded."""
        stop = min(start + n, int(self.counts.sum(dtype=np.int64)))
        if stop <= start:
            return np.zeros(0, np.uint32)
        block, last = np.searchsorted(self.index, [start, stop - 1], "right").tolist()
        part = self.symbols((block - 1) * INDEX_STEP, last * INDEX_STEP)
        ends = int(self.index[block - 1]) + np.cumsum(self.expansions.lengths.take(part))
        a, b = np.searchsorted(ends, [start, stop - 1], "right").tolist()
        before = int(ends[a - 1]) if a else int(self.index[block - 1])
        return self.expansions.ids(part[a : b + 1])[start - before : stop - before]


def _shards(name: str, end_id: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, terminals = TaskContext.get().partitionId(), encoder(name).library.get_vocab_size(with_added_tokens=True)
        end = end_id.to_bytes(4, "little")
        docs, counts, data, start, block = [], [], [], 0, 0

        def close():
            ids = np.frombuffer(b"".join(data), "<u4")
            return pd.DataFrame({"part": [part], "block": [block], "first": [start], "n_ids": [len(ids)], "data": [write_shard(docs, counts, ids, terminals)]})

        size = 0
        for f in frames:
            for doc_id, text in zip(f["doc_id"], f["text"]):
                ids = encoder(name).encode(text) + end
                docs.append(None if pd.isna(doc_id) else int(doc_id))
                counts.append(len(ids) // 4)
                data.append(ids)
                size += len(ids) // 4
                if size >= SHARD_IDS:
                    yield close()
                    start, block, size = start + size, block + 1, 0
                    docs, counts, data = [], [], []
        if docs:
            yield close()

    return run


def write_ids(docs: DataFrame, name: str = WORD_BPE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of shard files (part, block, first, n_ids, data), written to the shared folder.

    Parts and their blocks are in ascending order of document id; `first` counts
    the ids of the part before the block. Null ids come first, null texts are
    empty, rows that repeat an id are all written.
    """
    small_batches(docs.sparkSession)
    rows = whole_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("doc_id", F.col("doc_id").cast("string"))
    return saved(ordered.mapInPandas(_shards(name, end_id), "part int, block int, first long, n_ids long, data binary"), "token-ids")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for part, first, data in zip(f["part"], f["first"], f["data"]):
            shard = Shard(bytes(data))
            counts = shard.counts.astype(np.int64)
            at = np.cumsum(counts) - counts
            crc, first_doc = [], 0
            for stop in [*np.flatnonzero(np.diff(at // READ_IDS)) + 1, len(at)]:  # a run of documents at a time
                begin = int(at[first_doc]) if first_doc < len(at) else 0
                ids = shard.ids(begin, int(counts[first_doc:stop].sum())).astype("<u4").tobytes()
                crc += [zlib.crc32(ids[4 * (a - begin) : 4 * (a - begin + n)]) for a, n in zip(at[first_doc:stop].tolist(), counts[first_doc:stop].tolist())]
                first_doc = stop
            yield pd.DataFrame({"part": part, "doc_id": pd.array(shard.doc_ids, dtype="Int64"), "start": first + at, "n_tokens": counts, "ids_crc32": crc})


def read_ids(shards: DataFrame) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = shards.sparkSession
    small_batches(spark)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row a partition
    base, starts = 0, []
    for r in sorted(totals, key=lambda r: r["part"]):
        starts.append((r["part"], base))
        base += r["n"]
    bases = F.broadcast(spark.createDataFrame(starts, "part int, base long"))  # one row a partition
    rows = shards.select("part", "first", "data").mapInPandas(_read, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_ids(spark, sf_dir):
    return read_ids(write_ids(table(spark, sf_dir, "documents")))
