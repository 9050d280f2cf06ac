"""Suffix-array dedup by hash-compared suffix sort.

Every byte covered by a string of `width` bytes that also starts elsewhere goes.

1. Each window of `width` bytes names its minimizer gram; equal windows name
   equal grams at the same place. The windows that one gram answers for start
   next to each other and form a span. Grams that occur once can't lie in a
   repeated window and drop out.
2. Spans equal as a whole (128-bit digests) are repeated as a whole.
3. Of the grams that other spans share, one copy of each different span goes to
   a task with the bytes. Its windows, grouped by gram and by their place
   relative to it, are sorted as suffixes by mergesort; two suffixes are compared
   through prefix polynomial hashes and binary search for their common
   extension, and neighbours that agree over `width` bytes are verified byte by
   byte. The windows of a gram with more spans than a task should hold are first
   dealt out by their place relative to it: those of a part share a longer
   string, their core, and only parts with one core can hold equal windows. So a
   gram is split, by place and core, until each part is small enough to sort.
4. The intervals found are cut from each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, numbered, saved, small_batches, table, tidy

WIDTH = 400
#: Bytes of a gram; smaller ones for smaller widths.
GRAM = 128
#: Different spans of a gram that one task sorts; grams with more are refined.
CELL = 2048
#: Windows that a task sorts at a time; cells are not cut.
CELL_WINDOWS = 100_000
#: Parts into which a refined part is split.
PARTS = 4
#: Tasks over which the parts with one core are joined to it.
SALTS = 8
#: Window starts handled at a time in a very long text.
CHUNK = 1 << 22
#: Multiplier of the polynomial and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: A random-looking value for each byte, by rule.
BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64, kept and grown as needed."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = _powers[key] = np.multiply.accumulate(step)
    return have[:n]


class PrefixHashes:
    """Polynomial hashes of any stretch of a byte buffer, by one subtraction and one product."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]


def minimizers(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, gram hash) of each span of a text.

    The minimizer of a window is its gram of the smallest mixed hash, the last
    of equal ones; so it depends on the bytes of the window alone.
    """
    n, w = len(data) - gram + 1, width - gram + 1
    windows = len(data) - width + 1
    hashes = _mix(PrefixHashes(data).of(np.arange(n), gram))
    key = (hashes >> np.uint64(24) << np.uint64(24)) | (np.uint64(0xFFFFFF) - np.arange(n, dtype=np.uint64))
    rows = -(-n // w)
    full = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:n] = key
    full = full.reshape(rows, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows])
    place = (np.uint64(0xFFFFFF) - (least & np.uint64(0xFFFFFF))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], windows] - 1
    return place[first], first, last, hashes[place[first]]


def spans_of(data: bytes, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """minimizers() of a whole text, in overlapping chunks if it is very long."""
    for at in range(0, len(data) - width + 1, CHUNK):
        part = np.frombuffer(data[at : at + CHUNK + width - 1], np.uint8)
        place, first, last, grams = minimizers(part, width, gram)
        yield place + at, first + at, last + at, grams


def _spans(width: int, gram: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for file, row, text in zip(f["file"], f["row"], f["text"]):
                data = text.encode("utf-8", "surrogatepass")
                for place, first, last, grams in spans_of(data, width, gram):
                    digests = [hashlib.blake2b(data[a : b + width], digest_size=16, salt=(p - a).to_bytes(8, "little")).digest() for p, a, b in zip(place.tolist(), first.tolist(), last.tolist())]
                    out.append(pd.DataFrame({"file": file, "row": row, "place": place, "first": first, "last": last, "gram": grams.view(np.int64), "span": digests}))
            if out:
                yield pd.concat(out)
        tidy()

    return run


def common_extension(hashes: PrefixHashes, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at x and y share, at most `most`, by binary search over prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), most, np.int64)
    # whole agreement is common enough to try first
    low = np.where(hashes.of(x, most) == hashes.of(y, most), most, low)
    open_ = np.flatnonzero(low < most)
    lo, hi, xs, ys = low[open_], high[open_] - 1, x[open_], y[open_]
    for _ in range(int(most).bit_length()):
        mid = (lo + hi + 1) // 2
        same = hashes.of(xs, mid) == hashes.of(ys, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    low[open_] = lo
    return low


def suffix_sort(data: np.ndarray, hashes: PrefixHashes, start: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Order of the suffixes by group and then by their first `width` bytes; equal ones keep their order.

    Mergesort from runs of one up, all groups at once: an element's place in the
    merged run is its own plus its rank in the sibling run, found by binary
    search whose every step compares two suffixes through their hashes.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[begin, len(g)])
    base, count = np.repeat(begin, size), np.repeat(size, size)
    at = np.arange(len(g)) - base
    run = 1
    while run < (int(size.max()) if len(size) else 0):
        which = at // run
        sibling = base + (which ^ 1) * run
        stop = np.minimum(sibling + run, base + count)
        live = np.flatnonzero(sibling < base + count)
        lo, hi = sibling[live].copy(), stop[live].copy()
        mine, left = start[order[live]], (which[live] & 1) == 0
        for _ in range(run.bit_length() + 1):
            todo = np.flatnonzero(lo < hi)
            if not len(todo):
                break
            mid = (lo[todo] + hi[todo]) // 2
            x, y = mine[todo], start[order[mid]]
            share = common_extension(hashes, x, y, width)
            end = share == width
            step = np.where(end, 0, share)
            theirs_first = np.where(end, ~left[todo], data[y + step] < data[x + step])
            lo[todo] = np.where(theirs_first, mid + 1, lo[todo])
            hi[todo] = np.where(theirs_first, hi[todo], mid)
        target = np.arange(len(g))
        pair = base[live] + (which[live] // 2) * 2 * run
        target[live] = pair + (at[live] % run) + (lo - sibling[live])
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        run *= 2
    return order


def equal_windows(data: np.ndarray, start: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """A class number for each window start; windows of one group and class are equal byte for byte."""
    if not len(start):
        return np.zeros(0, np.int64)
    hashes = PrefixHashes(data)
    order = suffix_sort(data, hashes, start, group, width)
    s, g = start[order], group[order]
    same = np.zeros(len(s), bool)
    near = np.flatnonzero(g[1:] == g[:-1]) + 1
    same[near] = hashes.of(s[near], width) == hashes.of(s[near - 1], width)
    offsets = np.arange(width)
    claimed = np.flatnonzero(same)
    for i in range(0, len(claimed), 8192):  # collision verification: the bytes themselves
        c = claimed[i : i + 8192]
        same[c] = (data[s[c][:, None] + offsets] == data[s[c - 1][:, None] + offsets]).all(axis=1)
    classes = np.empty(len(s), np.int64)
    classes[order] = np.cumsum(~same) - 1
    if (lost := claimed[~same[claimed]]).size:  # hashes collided: these groups are classed by their bytes
        for bad in np.unique(g[lost]):
            known: dict[bytes, int] = {}
            for i in np.flatnonzero(group == bad):
                classes[i] = known.setdefault(data[start[i] : start[i] + width].tobytes(), int(classes[i]))
    return classes


def _cells(width: int, keep_first: bool):
    """Rows (file, row, a, b) of the repeated stretches of cells; the rows come sorted by cell, each with all its spans."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        windows = 0
        for f in frames:
            if not len(f):
                continue
            held.append(f)
            windows += int((f["last"] - f["first"] + 1).sum())
            if windows >= CELL_WINDOWS:
                rows = pd.concat(held, ignore_index=True)
                whole = int(np.searchsorted(rows["cell"].to_numpy(), rows["cell"].iloc[-1]))  # the last cell may go on
                yield from _in_turn(rows.iloc[:whole], width, keep_first)
                held = [rows.iloc[whole:]]
                windows = int((held[0]["last"] - held[0]["first"] + 1).sum())
        if held:
            yield from _in_turn(pd.concat(held, ignore_index=True), width, keep_first)
        tidy()

    return run


def _in_turn(rows: pd.DataFrame, width: int, keep_first: bool) -> Iterator[pd.DataFrame]:
    """Whole cells, about CELL_WINDOWS windows at a time."""
    cells, n = rows["cell"].to_numpy(), (rows["last"] - rows["first"] + 1).to_numpy()
    ends = np.r_[np.flatnonzero(cells[1:] != cells[:-1]) + 1, len(rows)] if len(rows) else np.zeros(0, np.int64)
    a, load = 0, 0
    total = np.cumsum(n)
    for i, end in enumerate(ends.tolist()):
        load = int(total[end - 1] - (total[a - 1] if a else 0))
        if load >= CELL_WINDOWS or i == len(ends) - 1:
            yield from _sorted_cells(rows.iloc[a:end], np.unique(cells[a:end], return_inverse=True)[1], width, keep_first)
            a = end


def _sorted_cells(rows: pd.DataFrame, cell: np.ndarray, width: int, keep_first: bool) -> Iterator[pd.DataFrame]:
    data = np.frombuffer(b"".join(map(bytes, rows["data"])), np.uint8)
    first, last, place = (rows[c].to_numpy() for c in ("first", "last", "place"))
    n = last - first + 1
    size = n + width - 1
    origin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(rows)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = origin[row] + step
    group = cell[row] * (width + 1) + (place[row] - first[row] - step)
    classes = equal_windows(data, start, group, width)
    at = first[row] + step
    _, inverse, counts = np.unique(classes, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if keep_first:  # of equal windows, that of smallest address stays
        order = np.lexsort((at, rows["row"].to_numpy()[row], rows["file"].to_numpy()[row], inverse))
        twice[order[np.r_[True, np.diff(inverse[order]) != 0]]] = False
    # neighbouring repeated windows of a span become one stretch
    hit = np.flatnonzero(twice)
    if len(hit):
        new = np.r_[True, (row[hit][1:] != row[hit][:-1]) | (at[hit][1:] != at[hit][:-1] + 1)]
        i = np.flatnonzero(new)
        j = np.r_[i[1:], len(hit)] - 1
        yield _found(rows, row[hit[i]], at[hit[i]], at[hit[j]] + width)


def _found(rows, row, a, b) -> pd.DataFrame:
    return pd.DataFrame({"file": rows["file"].to_numpy()[row], "row": rows["row"].to_numpy()[row], "a": a, "b": b})


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _parts(width: int, gram: int):
    """Parts of rows by the distance d of a window's start to its gram: core is what all windows of a part share."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for file, row, place, first, last, lo, hi, data in zip(*(f[c] for c in ("file", "row", "place", "first", "last", "lo", "hi", "data"))):
                step = -(-(hi - lo + 1) // PARTS)
                for low in range(lo, hi + 1, step):
                    high = min(hi, low + step - 1)
                    a, b = max(first, place - high), min(last, place - low)
                    if a <= b:
                        core = data[place - low - first : place - high + width - first]
                        own = data[a - first : b + width - first]
                        out.append((file, row, place, a, b, low, high, _digest(core), _digest(b"%d %d " % (place - a, place - b) + own), own))
            yield pd.DataFrame(out, columns=["file", "row", "place", "first", "last", "lo", "hi", "core", "own", "data"])
        tidy()

    return run


PART = "file long, row long, place int, first int, last int, lo int, hi int, core binary, own binary, data binary"


SPANS = "file long, row long, place int, first int, last int"
STRETCHES = "file long, row long, a int, b int"


def _sorted_out(cells: DataFrame, width: int, keep_first: bool) -> DataFrame:
    """Repeated stretches of cells (cell, file, row, place, first, last, data), by suffix sort."""
    return saved(cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(_cells(width, keep_first), STRETCHES), "stretches")


def _copies(spans: DataFrame, kinds: DataFrame, key: list[str], width: int, keep_first: bool) -> DataFrame:
    """Stretches of the spans that are equal as a whole to another; with keep_first, without the one of smallest address."""
    twice = kinds.filter("copies > 1").select(*key, F.col("one.file").alias("f"), F.col("one.row").alias("r"), F.col("one.place").alias("p"))
    met = spans.join(twice, key)
    if keep_first:
        met = met.filter((F.col("file") != F.col("f")) | (F.col("row") != F.col("r")) | (F.col("place") != F.col("p")))
    return met.select("file", "row", F.col("first").alias("a"), (F.col("last") + width).alias("b"))


def _refined(rows: DataFrame, width: int, gram: int, keep_first: bool) -> list[DataFrame]:
    """Repeated stretches among the spans of grams that have too many for one task; a level for each splitting."""
    found, wide = [], width - gram + 1
    while wide > 1 and not rows.isEmpty():
        wide = -(-wide // PARTS)
        parts = saved(rows.mapInPandas(_parts(width, gram), PART), "parts")
        key = ["lo", "hi", "core"]
        kinds = saved(parts.groupBy(*key, "own").agg(F.count("*").alias("copies"), F.min(F.struct("file", "row", "place", "first", "last", "data")).alias("one")), "kinds")
        found.append(_copies(parts, kinds, [*key, "own"], width, keep_first))
        # a core may be in a third of all documents
        open_ = kinds.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key, (F.col("n") > CELL).alias("hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = kinds.withColumn("salt", F.pmod(F.xxhash64("own"), F.lit(SALTS)).cast("int"))
        dealt = salted.join(open_, [*key, "salt"])
        dealt = saved(dealt.select(F.xxhash64(*key).alias("cell"), "hot", "one.file", "one.row", "one.place", "one.first", "one.last", "lo", "hi", "one.data"), "open")
        found.append(_sorted_out(dealt.filter("not hot"), width, keep_first))
        rows = dealt.filter("hot")
    return found


def _snippets(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for file, row, text, spans in zip(f["file"], f["row"], f["text"], f["spans"]):
                data = text.encode("utf-8", "surrogatepass")
                out += [(file, row, s["place"], s["first"], s["last"], s["gram"], s["hot"], data[s["first"] : s["last"] + width]) for s in spans]
            yield pd.DataFrame(out, columns=["file", "row", "place", "first", "last", "cell", "hot", "data"])
        tidy()

    return run


def merged(stretches) -> list[tuple[int, int]]:
    """Maximal runs of [a, b) stretches that touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted((int(s["a"]), int(s["b"])) for s in stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_stretches(docs: DataFrame, width: int = WIDTH, gram: int | None = None, keep_first: bool = False) -> DataFrame:
    """(file, row, a, b): stretches [a, b) of bytes whose every window of `width` starts elsewhere too; with keep_first, at a smaller address.

    docs has the address (file, row) of each text, of longs without nulls.
    """
    gram = gram or min(GRAM, max(1, width // 3))
    spans = saved(docs.filter(F.octet_length("text") >= width).mapInPandas(_spans(width, gram), f"{SPANS}, gram long, span binary"), "spans")
    # counts are written before they are joined: then Spark can split the rows of a gram that is in a third of all documents
    often = saved(spans.groupBy("gram").count().filter("count > 1").select("gram"), "often")
    every, spans = spans, saved(spans.join(often, "gram"), "spans")
    discard(every, often)
    same = saved(spans.groupBy("gram", "span").agg(F.count("*").alias("copies"), F.min(F.struct("file", "row", "place", "first", "last")).alias("one")), "same")
    whole = _copies(spans, same, ["gram", "span"], width, keep_first)
    # where all copies go, a gram whose spans are all copied is done
    open_ = same.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).filter("kinds > 1" if keep_first else "kinds > 1 and least = 1")
    dealt = same.join(saved(open_.select("gram", (F.col("kinds") > CELL).alias("hot")), "open"), "gram")
    wanted = dealt.select("one.file", "one.row", F.struct("one.place", "one.first", "one.last", "gram", "hot").alias("s")).groupBy("file", "row").agg(F.collect_list("s").alias("spans"))  # of one document
    matched = docs.join(wanted, ["file", "row"]).select("file", "row", "text", "spans")
    snippets = saved(matched.mapInPandas(_snippets(width), f"{SPANS}, cell long, hot boolean, data binary"), "snippets")
    local = _sorted_out(snippets.filter("not hot"), width, keep_first)
    hot = snippets.filter("hot").select("file", "row", "place", "first", "last", F.lit(0).alias("lo"), F.lit(width - gram).alias("hi"), "data")
    out = whole.unionByName(local)
    for level in _refined(hot, width, gram, keep_first):
        out = out.unionByName(level)
    return out


def _cut(text: str, stretches) -> tuple[int, int, int, str, bytes]:
    data = text.encode("utf-8", "surrogatepass")
    runs = merged(stretches if stretches is not None else [])
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    rest = b"".join(kept)
    return len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest


COUNTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, stretches in batches:
        found = [_cut(t, s) for t, s in zip(text, stretches)]
        # a cut may fall inside a character; what then isn't one is left out of the text
        yield pd.DataFrame([(*x[:4], x[4].decode("utf-8", "ignore")) for x in found], columns=[*COUNTS, "kept_text"])
    tidy()


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int | None = None, text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """All columns of docs in a struct `row`, with n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    Bytes covered by a string of `width` bytes that starts anywhere else too, in
    the same document or another, are removed: all copies of them, or with
    keep_first all but the one of smallest address. Null and
    empty texts, and those shorter than `width`, lose nothing (null counts as
    empty). Null and repeated ids are rows like others. An empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    every = numbered(docs)
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    found = saved(repeated_stretches(every.select("file", F.col("place").alias("row"), text.alias("text")), width, gram, keep_first), "repeats")
    lists = found.groupBy("file", F.col("row").alias("place")).agg(F.collect_set(F.struct("a", "b")).alias("stretches"))  # of one document
    joined = every.join(lists, ["file", "place"], "left")  # the text is in the row, and is shuffled once
    cut = F.pandas_udf(_kept, f"{SCHEMA}, kept_text string")
    out = joined.select("row", cut(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), "stretches").alias("cut"))
    return out.select("row", *(f"cut.{c}" for c in COUNTS), "cut.kept_text")


def op4_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return remove_repeats(docs.select("doc_id", "text")).select("row.doc_id", *COUNTS, "kept_text")
