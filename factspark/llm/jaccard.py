"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

Two sets of n-grams link when 100 * shared >= percent * union. Equal sets are
one node. The others are joined where they meet: linked sets share one of the
rarest n - need(n) + 1 n-grams of each, so each set is listed under those. A
pair that meets is dropped unless its sizes, its places in both lists and the
counts of what comes after in eight classes allow enough shared n-grams; what
is left is verified once, on the whole sets.

A list may hold a crowd of near copies. It is first compared with a few of its
members, those with the fewest rarer n-grams of their own, and only members that
are still in different components after that meet pair by pair: no link between
components is lost, and a crowd has no square of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, numbered, saved, small_batches, table, tidy
from .graph import components
from .shingles import shingle_set

#: Members of a list that all others are compared with in a turn, and the turns.
LEADERS, TURNS = 8, 2
#: Classes of n-grams whose counts bound what two suffixes share; each has CLASS_BITS of a long.
CLASSES, CLASS_BITS = 8, 16


def _sets(texts: pd.Series, size: int) -> list[np.ndarray]:
    return [shingle_set(x, size) for x in texts]


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _marks(size: int, percent: int):
    """Size, hash and part of each set; see may_link() for what the part is."""

    @F.pandas_udf("n int, key long, part array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = _sets(texts, size)
            keys = _keys(sets)
            parts = [s[: len(s) - (percent * len(s) + 99) // 100 + max(1, len(s) // 10)] if len(s) else s for s in sets]
            yield pd.DataFrame({"n": [len(s) for s in sets], "key": keys, "part": [s.view(np.int64) for s in parts]})
        tidy()

    return run


def _keyed(size: int):
    @F.pandas_udf("key long, n int, grams array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = _sets(texts, size)
            yield pd.DataFrame({"key": _keys(sets), "n": [len(s) for s in sets], "grams": [s.view(np.int64) for s in sets]})
        tidy()

    return run


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, place, doc_id, text) of each row, null text as empty."""
    small_batches(docs.sparkSession)
    return numbered(docs).select("file", "place", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("text"))


def ngram_marks(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(file, place, doc_id, n, key, part) of rows (file, place, doc_id, text): the size and the hash of each row's set of n-grams, and a part of it.

    The id stays in the JVM. Empty texts have an empty set.
    """
    return rows.select("file", "place", "doc_id", _marks(size, percent)("text").alias("f")).select("file", "place", "doc_id", "f.*")


def ngram_sets(rows: DataFrame, some: DataFrame, size: int) -> DataFrame:
    """(key, n, grams) of the rows in some (file, place): whole sets, as hashes; only these texts are looked at again.

    The rows are told by bitmaps, a bit a row of a file: while these are small
    enough for Spark to broadcast, no text is shuffled.
    """
    at = [F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit")]
    bits = saved(some.select("file", *at).groupBy("file", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "bits")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = rows.select("file", "place", "text", *at).join(bits, ["file", "bucket"]).filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
    return held.select(_keyed(size)("text").alias("f")).select("f.*")


def _need(n: Column, percent: int) -> Column:
    """n-grams that a set of n must share with any set it links with."""
    return F.floor((percent * n.cast("long") + 99) / 100).cast("int")


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """n-grams that linked sets of n and m share at least."""
    return F.floor((percent * (n + m).cast("long") + 99 + percent) / (100 + percent)).cast("int")


def may_link(marks: DataFrame, percent: int) -> DataFrame:
    """One row (file, place, key, n) of each different set, without those that a part of the n-grams proves to have no link.

    The part has the n - need(n) + k(n) n-grams of smallest hash, k(n) a tenth of n.
    Of a linked pair, all shared n-grams in the part that ends first are in the
    other part too, and these are at least k of its size, which is not below need(n).
    """
    k = lambda n: F.greatest(F.lit(1), F.floor(n / 10)).cast("int")
    n = F.col("n")
    part = marks.select("key", "n", F.explode("part").alias("s"))
    times = saved(part.groupBy("s").count().filter("count > 1").select("s"), "times")
    met = part.join(times, "s").groupBy("key", "n").agg(F.count("*").alias("met")).filter(F.col("met") >= k(_need(n, percent))).select("key")
    some = saved(marks.groupBy("key", "n").agg(F.min(F.struct("file", "place")).alias("one")).join(met, "key").select("key", "n", "one.file", "one.place"), "some")
    discard(times)
    return some


def rare_first(some: DataFrame, percent: int) -> DataFrame:
    """(key, n, codes) of sets (key, n, grams): the n-grams that another of them has, rarest first.

    An n-gram of one set only is shared with none; it counts in n. Sets with too few others are left out.
    """
    held = some.select("key", "n", F.explode("grams").alias("s"))
    times = saved(held.groupBy("s").count().filter("count > 1"), "times")
    listed = held.join(times, "s").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("count", "s"))).alias("l"))  # of one set
    return listed.filter(F.size("l") >= _need(F.col("n"), percent)).select("key", "n", F.col("l.s").alias("codes"))


ENTRY = "array<struct<code: long, rarer: int, after: int, low: long, high: long>>"


def _entries(percent: int):
    """The prefix of each set: n-gram, n-grams of the set that are rarer, that come after, and the latter's counts by class."""

    @F.pandas_udf(ENTRY)
    def run(n: pd.Series, codes: pd.Series) -> pd.Series:
        out = []
        for size, c in zip(n, codes):
            c = np.asarray(c, np.int64)
            prefix = len(c) + 1 - (percent * int(size) + 99) // 100
            kinds = (c.view(np.uint64) >> np.uint64(61)).astype(np.int64)  # not the bits that order equally rare ones
            left = np.bincount(kinds, minlength=CLASSES) - np.cumsum(np.eye(CLASSES, dtype=np.int64)[kinds[:prefix]], axis=0)
            packed = np.minimum(left, (1 << (CLASS_BITS - 1)) - 1) << (np.arange(CLASSES) % 4 * CLASS_BITS)
            low, high = packed[:, :4].sum(axis=1), packed[:, 4:].sum(axis=1)
            out.append([{"code": int(c[i]), "rarer": int(size) - len(c) + i, "after": len(c) - i - 1, "low": int(low[i]), "high": int(high[i])} for i in range(prefix)])
        return pd.Series(out)

    return run


def prefix_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(key, n, code, rarer, after, low, high): each set under every n-gram of its prefix."""
    return sets.select("key", "n", F.explode(_entries(percent)("n", "codes")).alias("e")).select("key", "n", "e.*")


def _apart(a: str, b: str) -> Column:
    """N-grams, by the counts of their classes, that one of two suffixes has and the other hasn't, at least."""
    mask = (1 << CLASS_BITS) - 1
    at = lambda side, half, i: F.shiftright(F.col(f"{side}.{half}"), i * CLASS_BITS).bitwiseAND(mask)
    return sum((F.abs(at(a, half, i) - at(b, half, i)) for half in ("low", "high") for i in range(CLASSES // 2)), F.lit(0))


def _passes(percent: int) -> Column:
    """Length, positional and suffix filter for entries a and b of one list; a linked pair passes in the list of its rarest shared n-gram."""
    n, m = F.col("a.n").cast("long"), F.col("b.n").cast("long")
    least = _overlap(F.col("a.n"), F.col("b.n"), percent)
    length = (100 * n >= percent * m) & (100 * m >= percent * n)
    place = 1 + F.least("a.after", "b.after") >= least
    suffix = 2 + F.col("a.after") + F.col("b.after") - _apart("a", "b") >= 2 * least
    return length & place & suffix


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets link."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("m"), F.col("codes").alias("s"))
    right = sets.select(F.col("key").alias("b"), "n", F.col("codes").alias("t"))
    shared = F.size(F.array_intersect("s", "t")).cast("long")
    return pairs.join(left, "a").join(right, "b").filter(100 * shared >= percent * (F.col("m") + F.col("n") - shared)).select("a", "b")


def _pairs(lists: DataFrame, others: DataFrame, percent: int, more: Column) -> DataFrame:
    met = lists.alias("a").join(others.alias("b"), (F.col("a.code") == F.col("b.code")) & more & _passes(percent))
    return met.select(F.greatest("a.key", "b.key").alias("a"), F.least("a.key", "b.key").alias("b")).distinct()


def _leaders(lists: DataFrame, turn: int) -> DataFrame:
    """LEADERS members of each list at most, one of each part of its members: first those with the fewest rarer n-grams of their own, which are most alike the rest."""
    order = F.xxhash64("key", "code") if turn else F.lit(0).cast("long")
    first = F.min(F.struct(order.alias("o"), "rarer", "key", "n", "after", "low", "high", "comp")).alias("l")
    return lists.groupBy("code", F.pmod(F.xxhash64("comp" if turn else "key"), F.lit(LEADERS)).alias("part")).agg(first).select("code", "l.*")


def joined(sets: DataFrame, percent: int, roots: DataFrame | None = None) -> DataFrame:
    """(node, root): the components of all links between sets (key, n, codes), and of the links in roots."""
    lists, tried = saved(prefix_lists(sets, percent), "lists"), None
    for turn in range(TURNS + 1):
        comp = F.col("key").alias("comp")
        if roots is not None:
            lists = lists.select("key", "n", "code", "rarer", "after", "low", "high").join(roots.withColumnRenamed("node", "key"), "key", "left")
            comp = F.coalesce("root", "key").alias("comp")
        named = saved(lists.select("key", "n", "code", "rarer", "after", "low", "high", comp), "named")
        open_ = saved(named.groupBy("code").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("code"), "open")
        lists = saved(named.join(open_, "code", "left_semi"), "lists")  # what is in one component is done
        discard(named)
        if lists.isEmpty():
            break
        apart = F.col("a.comp") != F.col("b.comp")
        if turn < TURNS:
            pairs = _pairs(lists, saved(_leaders(lists, turn), "leaders"), percent, apart)
        else:
            pairs = _pairs(lists, lists, percent, apart & (F.col("a.key") > F.col("b.key")))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        if pairs.isEmpty():
            discard(pairs)
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        edges = verified(pairs, sets, percent)
        if roots is not None:
            edges = edges.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(edges)
    return sets.limit(0).select(F.col("key").alias("node"), F.col("key").alias("root")) if roots is None else roots


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, component_size.

    component_id is the smallest doc_id that links reach, component_size the
    rows of the component. Null, empty and blank texts have an empty set and are
    linked with nothing. A null id never becomes a component's id unless it has
    no other; repeated ids are rows of their own. An empty table gives an empty
    result. Other columns are ignored.
    """
    texts = addressed(docs, id_col, text_col)
    marks = saved(ngram_marks(texts, size, percent), "marks")
    some = may_link(marks, percent)
    held = saved(ngram_sets(texts, some, size), "held")
    sets = saved(rare_first(held, percent), "sets")
    discard(held)
    roots = saved(joined(sets, percent), "roots")
    discard(some, sets)
    keys = marks.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    rooted = keys.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "first", "n", F.coalesce("root", "key").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    named = saved(rooted.join(whole, "root").select("key", "component_id", "component_size"), "named")
    out = marks.select("doc_id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(named, "key", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.lit(1).cast("long")).otherwise(F.col("component_size")).alias("component_size"))


def op11_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS s FROM docs),
grams AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.r AS a, b.r AS b, a.n, b.n AS m, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (n + m - k)),
reach(a, b) AS (SELECT r, r FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, min(other.doc_id) AS component_id, count(*) AS component_size
FROM sets JOIN reach ON reach.a = sets.r JOIN docs other ON other.r = reach.b GROUP BY sets.r, sets.doc_id, len(sets.s)"""
