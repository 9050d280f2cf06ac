"""Lexical and vector retrieval, fusion and its measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from .relational import top_n

#: Fixed values of the ranking formulas.
K1, B = 1.2, 0.75
RRF_K = 60


def tokens(text: Column) -> Column:
    """Maximal runs of letters, marks, numbers, private-use characters and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}\p{Co}_]+)"), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def recall_and_mrr(ranked: DataFrame, wanted: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Recall at k and reciprocal rank (null without a hit; a mean over queries counts it as 0) of every query that wants something."""
    hits = wanted.select(query, doc).distinct().join(ranked.select(query, doc, "rank").filter(F.col("rank") <= k), [query, doc], "left")
    return hits.groupBy(query).agg((F.count("rank") / F.count("*")).alias("recall"), (1.0 / F.min("rank")).alias("rr"))


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> None:
    """Store a BM25 index: postings partitioned by a hash of the token, documents with their lengths and `keep` columns, and totals.

    The texts are read once, here; queries read their tokens' partitions only.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), *keep, tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("ts"))
    sorted_ = t.select("doc_id", *keep, F.size("ts").alias("length"), F.sort_array("ts").alias("s"))
    starts = sorted_.select("doc_id", *keep, "length", "s", F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1))).alias("at")).filter("length > 0")
    runs = F.transform("at", lambda a, i: F.struct(F.get("s", a).alias("token"), (F.coalesce(F.get("at", i + 1), F.col("length")) - a).cast("long").alias("tf")))
    counted = starts.select("doc_id", *keep, "length", F.inline(runs))  # a document's tokens are counted within its row: postings are shuffled once
    hashed = F.pmod(F.xxhash64("token"), F.lit(INDEX_PARTS * 64))
    placed = counted.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(INDEX_PARTS)).cast("int"))
    placed.repartition("bucket", hashed).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/postings")
    t.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("mean")).write.parquet(f"{path}/totals")


#: Partitions of a stored index.
INDEX_PARTS = 16
#: Words of all queries that may be named in the scan of an index; more are joined.
WORDS = 1_000


def search_index(index: str, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents that hold all words of a text of the query.

    queries: (query_id, text), several texts a query; a document keeps the score
    of its best one. `where` filters documents by kept columns before the ranking;
    the statistics are those of all documents.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.xxhash64("text").alias("t"), F.array_distinct(tokens(F.col("text"))).alias("ws"))
    asked = asked.filter(F.size("ws") > 0).select("query_id", "t", F.size("ws").alias("need"), F.explode("ws").alias("token"))
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(INDEX_PARTS)).cast("int"))
    totals = spark.read.parquet(f"{index}/totals")
    words = asked.select("bucket", "token").distinct()
    few = words.limit(WORDS + 1).collect()
    posted = spark.read.parquet(f"{index}/postings")
    if len(few) <= WORDS:  # named in the scan, which then reads their part of the buckets, and no posting is shuffled for them
        posted = posted.filter(F.col("bucket").isin(*{r["bucket"] for r in few}) & F.col("token").isin(*{r["token"] for r in few})) if few else posted.filter("false")
    else:
        posted = posted.join(words, ["bucket", "token"], "left_semi")
    kept = [c for c in posted.columns if c != "tf"]
    posted = posted.groupBy(*kept).agg(F.sum("tf").alias("tf"))  # of rows that share an id
    df = posted.groupBy("token").agg(F.count("*").alias("df"))
    if where is not None:
        posted = posted.filter(where)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hits = asked.join(posted, ["bucket", "token"]).join(df, "token").crossJoin(F.broadcast(totals))  # totals is one row
    scored = hits.groupBy("query_id", "t", "doc_id", "need").agg(F.count("*").alias("got"), F.sum(part).alias("score")).filter("got = need")
    best = scored.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top_n(best, ["query_id"], k, F.desc("score"), F.col("doc_id"))


#: Rows and queries that meet in one task of vector_search(), and queries scored at once there.
VECTORS_A_BLOCK, QUERIES_A_BLOCK, STRIP = 8192, 4096, 128


def _plain(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the vectors of the commonest length whose components are all finite numbers."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
    flat = np.asarray(pc.fill_null(pc.cast(pc.list_flatten(vectors), pa.float64()), np.nan), dtype=np.float64)
    width = np.bincount(sizes[sizes > 0]).argmax() if (sizes > 0).any() else 0
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    rows = np.flatnonzero(sizes == width) if width else np.empty(0, dtype=np.int64)
    matrix = flat[starts[rows][:, None] + np.arange(width)] if len(rows) else np.empty((0, width))
    fine = np.isfinite(matrix).all(axis=1)
    return rows[fine], matrix[fine]


def _best_of_block(k: int, schema: pa.Schema):
    """The k best rows of a block for each of its queries. A product of matrices leaves out what is surely behind; the rest are scored term by term, as dot() does."""

    def exact(a: list | None, b: list | None) -> float | None:
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        return float(sum((float(x) * float(y) for x, y in zip(a, b)), 0.0))

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        place = np.empty(len(rows), dtype=np.int64)
        place[np.asarray(pc.sort_indices(rows["vec_id"]))] = np.arange(len(rows))  # ties go to smaller ids
        vs, qs = (t["v"].combine_chunks() if len(t) else pa.array([], t.schema.field("v").type) for t in (rows, queries))
        (vi, v), (qi, q) = _plain(vs), _plain(qs)
        if v.shape[1] != q.shape[1]:
            vi, v, qi, q = vi[:0], v[:0], qi[:0], q[:0]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        reach = np.sqrt((v * v).sum(axis=1).max(initial=0.0)) * np.sqrt((q * q).sum(axis=1)) * (4 * max(1, v.shape[1]) * np.finfo(float).eps)
        for at in range(0, len(q) if len(v) else 0, STRIP):
            part = q[at : at + STRIP]
            near = part @ v.T
            least = np.partition(near, -k, axis=1)[:, -k] if len(v) > k else np.full(len(part), -np.inf)
            who, row = np.nonzero(near >= (least - reach[at : at + STRIP])[:, None])
            score = np.zeros(len(who))
            for c in range(v.shape[1]):
                score += v[row, c] * part[who, c]
            order = np.lexsort((place[vi[row]], -score, who))
            who, row, score = who[order], row[order], score[order]
            first = np.arange(len(who)) - np.searchsorted(who, who) < k
            found.append((qi[at + who[first]], vi[row[first]], score[first]))
        out = [pa.table([queries["query_id"].take(pa.array(a)), rows["vec_id"].take(pa.array(b)), pa.array(s, pa.float64())], schema=schema) for a, b, s in found]
        # what holds no number, none that is finite, or another length: pair by pair
        odd_v, odd_q = np.setdiff1d(np.arange(len(rows)), vi), np.setdiff1d(np.arange(len(queries)), qi)
        pairs = [(a, b) for a in qi for b in odd_v] + [(a, b) for a in odd_q for b in range(len(rows))]
        if pairs:
            a, b = (pa.array(x, pa.int64()) for x in zip(*pairs))
            scores = pa.array([exact(vs[int(y)].as_py(), qs[int(x)].as_py()) for x, y in pairs], pa.float64())
            out.append(pa.table([queries["query_id"].take(a), rows["vec_id"].take(b), scores], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query (query_id, q) with all rows.

    Blocks of rows meet blocks of queries, a group each, so that a task's memory
    doesn't grow with either table; of a block only its k best rows go on.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    asked = queries.select("query_id", F.col("q").alias("v"))
    down, across = 1 + rows.count() // VECTORS_A_BLOCK, 1 + asked.count() // QUERIES_A_BLOCK
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.select("*", dealt("vec_id", down).alias("_down"), every(across).alias("_across"))
    asked = asked.select("*", every(down).alias("_down"), dealt("query_id", across).alias("_across"))
    fields = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("vec_id", rows.schema["vec_id"].dataType), StructField("score", DoubleType())])
    blocks = rows.groupBy("_down", "_across").cogroup(asked.groupBy("_down", "_across"))
    return top_n(blocks.applyInArrow(_best_of_block(k, to_arrow_schema(fields)), fields), ["query_id"], k, F.desc("score"), F.col("vec_id"))


#: Rows of ranked lists that are checked in one task, so that its memory doesn't grow with the table.
RANKS_A_TASK = 250_000


def checked_ranks(ranked: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, status): OK, DUPLICATE where a list names a document twice, RANK_INVALID where ranks aren't 1 to n.

    The lists are dealt out once, to as many tasks as their rows ask for: sized by
    bytes, which are few for ids so alike, a task would be given far more rows.
    """
    dealt = ranked.select(query, doc, "rank").repartition(1 + ranked.count() // RANKS_A_TASK, query)
    by = W.partitionBy(query)
    again = F.col(doc).isNull() | F.coalesce(F.col(doc) == F.lag(doc).over(by.orderBy(doc)), F.lit(False))
    told = dealt.withColumn("_again", again).withColumn("_right", F.coalesce(F.col("rank") == F.row_number().over(by.orderBy("rank")), F.lit(False)))
    seen = told.groupBy(query).agg(F.bool_or("_again").alias("again"), F.bool_and("_right").alias("right"))
    return seen.select(query, F.when(F.col("again"), "DUPLICATE").when(~F.col("right"), "RANK_INVALID").otherwise("OK").alias("status"))


def fused(lists: list[DataFrame], k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query, doc, rank): query, doc, score, rank; ties to smaller documents."""
    parts = [r.select(query, doc, (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("part")) for r in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top_n(both.groupBy(query, doc).agg(F.sum("part").alias("score")), [query], k, F.desc("score"), F.col(doc))


#: Candidates of a stage for each result wanted.
DEPTH = 5


def hybrid(lexical: DataFrame, semantic: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """Fused candidates of both lists at DEPTH times k, ordered anew by relevance (query_id, doc_id, logit): query_id, rank, doc_id, logit, rrf.

    Without a query_id, relevance is that of a document to every query.
    """
    deep = [r.filter(F.col("rank") <= DEPTH * k) for r in (lexical, semantic)]
    near = fused(deep, DEPTH * k).withColumnRenamed("score", "rrf").drop("rank")
    return top_n(near.join(relevance, [c for c in ("query_id", "doc_id") if c in relevance.columns]), ["query_id"], k, F.desc("logit"), F.desc("rrf"), F.col("doc_id"))
