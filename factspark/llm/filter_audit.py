"""Audit of how filters interact: direct relational replay of all their orders.

Each document carries five flags, one bit a filter. They are crossed with the
120 broadcast orders of the filters, the first failure of an order is computed
from its five masks, the five steps are exploded and aggregated with
conditions. The partial aggregation runs before the only shuffle of replayed
rows, so that a part of any size sends its 600 rows a task at most.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table

FILTERS = "ABCDE"
#: What separates words: space and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(text: Column) -> dict[str, Column]:
    """Whether a text fails the filters that look at nothing else; words are case-sensitive."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, flags, good, toxic) of each row of docs; bit i of flags is the failure of the i-th filter.

    E compares SHA-256 digests of whole texts with the smallest id of each
    digest; a null id is neither smaller nor larger than another. Of a
    document's labels, one that is 1 is enough.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bits = sum((F.when(failed, 1 << FILTERS.index(k)).otherwise(0) for k, failed in failures(text).items()), F.lit(0))
    rows = saved(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), bits.cast("int").alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest")), "flags")
    # written, so that both sides of the joins are plain exchanges, whose hot keys the skew join splits
    first = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "first")
    marked = saved(labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "marked")
    repeated = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    joined = rows.join(first, "digest", "left").select("doc_id", "part", (F.col("bits") + repeated).alias("flags")).join(marked, "doc_id", "left")
    return joined.select("part", "flags", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(spark) -> DataFrame:
    """The 120 orders: their number, their letters and the five masks."""
    rows = [(i, "".join(p), [1 << FILTERS.index(k) for k in p]) for i, p in enumerate(permutations(FILTERS))]
    return spark.createDataFrame(rows, "nr int, filter_order string, masks array<int>")


def audit(flags: DataFrame) -> DataFrame:
    """One row for each part, filter_order and step over rows (part, flags, good, toxic); see op12's contract for the counts.

    A part has its 600 rows whatever its documents fail. An empty table has no
    part and gives an empty result.
    """
    every = orders(flags.sparkSession)
    masks = [F.col("masks")[i].alias(f"m{i}") for i in range(len(FILTERS))]
    replayed = flags.crossJoin(F.broadcast(every.select("nr", *masks)))  # 120 rows, whatever the corpus
    first = F.coalesce(*[F.when(F.col("flags").bitwiseAND(F.col(f"m{i}")) != 0, i + 1) for i in range(len(FILTERS))], F.lit(len(FILTERS) + 1))
    steps = replayed.withColumn("first", first).withColumn("step", F.explode(F.array(*map(F.lit, range(1, len(FILTERS) + 1)))))
    mask = F.coalesce(*[F.when(F.col("step") == i + 1, F.col(f"m{i}")) for i in range(len(FILTERS))])
    here, count = F.col("first") == F.col("step"), lambda c: F.sum(c.cast("long"))
    steps = steps.withColumn("mask", mask)
    counted = steps.groupBy("part", "nr", "step").agg(
        count(F.col("first") > F.col("step")).alias("kept"),
        count(here).alias("removed"),
        count((F.col("flags").bitwiseAND(F.col("mask")) != 0) & (F.col("first") < F.col("step"))).alias("redundant"),
        count(F.col("flags") == F.col("mask")).alias("unique_fails"),
        count(here & (F.col("good") == 1)).alias("good_lost"),
        count(here & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    named = counted.join(F.broadcast(every.select("nr", "filter_order")), "nr").withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    shapley = F.sum("removed").over(W.partitionBy("part", "letter"))  # 120 rows of each
    return named.select("part", "filter_order", "step", *COUNTS, shapley.alias("shapley"))


def op12_filter_audit(spark, sf_dir):
    """Nulls: a null text is empty, a null source the part ''. Empty and very long texts, repeated rows and extra columns count like any other."""
    return audit(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT d.r, d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic, f.letter, f.failed
  FROM (SELECT r, doc_id, part, unnest([
      {'letter': 'A', 'failed': len(words) < 50}, {'letter': 'B', 'failed': 100 * len(list_distinct(words)) < 65 * len(words)},
      {'letter': 'C', 'failed': 100 * length(regexp_replace(docs.text, '[^A-Z]', '', 'g')) > 5 * length(docs.text)},
      {'letter': 'D', 'failed': regexp_matches(docs.text, '[#$%&*|]')}, {'letter': 'E', 'failed': coalesce(doc_id > first, false)}]) AS f
    FROM docs JOIN firsts ON docs.text = firsts.text) d LEFT JOIN marks m ON m.doc_id = d.doc_id),
total AS (SELECT r, sum(failed::INT) AS n FROM fails GROUP BY r),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.l <> a.l AND c.l NOT IN (a.l, b.l) AND d.l NOT IN (a.l, b.l, c.l) AND e.l NOT IN (a.l, b.l, c.l, d.l)),
replay AS (
  SELECT fails.*, total.n, filter_order, instr(filter_order, letter)::INT AS step,
    coalesce(min(CASE WHEN failed THEN instr(filter_order, letter) END) OVER (PARTITION BY fails.r, filter_order), 6) AS stop
  FROM fails JOIN total ON total.r = fails.r CROSS JOIN orders),
counted AS (
  SELECT part, filter_order, step, any_value(letter) AS letter, count(*) FILTER (stop > step) AS kept, count(*) FILTER (stop = step) AS removed,
    count(*) FILTER (failed AND stop < step) AS redundant, count(*) FILTER (failed AND n = 1) AS unique_fails,
    count(*) FILTER (stop = step AND good = 1) AS good_lost, count(*) FILTER (stop = step AND toxic = 1) AS toxic_lost
  FROM replay GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM counted"""
