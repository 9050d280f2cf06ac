"""Importance resampling towards a target distribution, over hashed n-grams.

Identical texts are collapsed by grouping full text, so that features are
computed once a text; their counts enter the corpus histogram times the number
of copies, and the weight of a text is joined back to its documents before each
draws its own Gumbel noise. A histogram has `buckets` rows, whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, saved, table

BUCKETS = 10_000
#: What separates words once A-Z are lower-cased: ASCII that is neither a letter nor a digit.
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BREAKS), "")


def features(words: Column, longest: int, buckets: int) -> Column:
    """The bucket of every run of 1 to `longest` words, repeats included."""
    bucket = lambda run: (F.crc32(run.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    return F.concat(F.transform(words, bucket), *(runs(n) for n in range(2, longest + 1)))


def histogram(rows: DataFrame) -> dict[int, int]:
    """Features by bucket over rows (features, copies): as many rows as there are buckets at most reach the driver."""
    counted = rows.select(F.explode("features").alias("b"), "copies").groupBy("b").agg(F.sum("copies").alias("n"))
    return {r["b"]: r["n"] for r in counted.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    all_s, all_t = sum(corpus.values()), sum(target.values())
    ratio = lambda b: (target.get(b, 0) + 1.0) * (all_s + buckets) / ((corpus.get(b, 0) + 1.0) * (all_t + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u made of the first 8 hex digits of the SHA-256 of `seed:doc_id`; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where it isn't drawn).

    Of the N documents with at least `least_words` words, floor(percent * N / 100)
    of the highest scores are drawn; ties go to the smaller id, a null id comes
    last, and rows of equal ids keep the order of their addresses. Null and
    empty texts have no feature and weight 0; an empty target leaves the
    corpus' own rarity. An empty table gives an empty result. Other columns are
    ignored. Very long texts are one row of an int a word.
    """
    rows = numbered(docs).select("file", "place", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    texts = rows.groupBy("text").agg(F.count("*").alias("copies")).withColumn("words", words(F.col("text")))
    texts = saved(texts.select(digest, "copies", F.size("words").alias("n_words"), features(F.col("words"), longest, buckets).alias("features")), "texts")
    wanted = target.select(features(words(F.coalesce(F.col(f"`{target_text}`"), F.lit(""))), longest, buckets).alias("features"), F.lit(1).alias("copies"))
    by_bucket = gains(histogram(texts), histogram(wanted), buckets)
    gain = F.split(F.lit(",".join(map(str, by_bucket))), ",").cast("array<bigint>")  # a constant of one long a bucket
    weight = F.aggregate("features", F.lit(0).cast("long"), lambda total, b: total + F.element_at(gain, b + 1))
    weights = saved(texts.select("digest", "n_words", F.size("features").cast("long").alias("n_features"), weight.alias("weight")), "weights")
    # both sides are plain exchanges: the skew join splits a text that a third of the documents share
    scored = rows.select("file", "place", "doc_id", digest).join(weights, "digest")
    scored = saved(scored.select("file", "place", "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("able")), "scored")
    return _ranked(scored, percent)


def _ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Ranks by a range-partitioned sort: a row's place in its partition plus the rows of the partitions before.

    The order ends with a row's address, so that no key is held by many rows.
    """
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("file"), F.asc("place")]
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's place in it
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    dealt = saved(dealt.select("doc_id", "n_features", "weight", "score", "able", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("local")), "ranked")
    parts = sorted((r["part"], r["n"]) for r in dealt.filter("able").groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    drawn, before, offsets = percent * sum(n for _, n in parts) // 100, 0, []
    for part, n in parts:
        offsets.append((part, before))
        before += n
    spark = scored.sparkSession
    offset = spark.createDataFrame(offsets, "part int, before long")
    rank = F.col("before") + F.col("local") + 1
    placed = dealt.join(F.broadcast(offset), "part", "left")  # one row a partition
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= drawn), rank).alias("rank"))


def op13_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
target AS (
  SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
held AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM docs) GROUP BY r, w),
asked AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM target) GROUP BY w),
vocabulary AS (SELECT w FROM held UNION SELECT w FROM asked),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))::BIGINT),
      lambda i: ('0x' || substr(hex(encode(w)), 2 * i::INT + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM vocabulary, crc),
s AS (SELECT bucket, sum(n) AS s FROM held JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM asked JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM held JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT docs.r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights ON weights.r = docs.r),
able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN able ON able.r = scored.r"""
