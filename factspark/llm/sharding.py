"""Sharding by minimax contiguous partition.

Equal texts are atomic. Texts are ordered by a prefix of their MD5, and all
texts of one prefix form one ordered atomic group, so there are at most
2**UNIT_BITS group sizes however large the corpus is; only these sizes reach the
driver. It binary-searches the smallest capacity that a greedy walk can meet
with the given number of shards and cuts there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table

UNIT_BITS = 16
ROW_BYTES = 16
#: Sub-buckets of a shard, within which slots are counted; a shard may hold a third of all rows.
SUB_BUCKETS = 1024


def greedy_cuts(sizes: Sequence[int], capacity: int) -> list[int]:
    """Starts of the shards that a greedy walk opens under the capacity."""
    cuts, load = [0], 0
    for i, size in enumerate(sizes):
        if load + size > capacity and load:
            cuts.append(i)
            load = 0
        load += size
    return cuts


def minimax_cuts(sizes: Sequence[int], shards: int) -> tuple[list[int], int]:
    """(starts of the shards, smallest feasible capacity) over ordered atomic sizes.

    Fewer groups than shards leave the last shards empty.
    """
    if not sizes:
        return [0], 0
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if len(greedy_cuts(sizes, mid)) <= shards:
            high = mid
        else:
            low = mid + 1
    cuts = greedy_cuts(sizes, low)
    # the greedy walk may need fewer shards: halve the widest ones, which lowers no bound
    while len(cuts) < min(shards, len(sizes)):
        ends = [*cuts[1:], len(sizes)]
        load, at = max((sum(sizes[a:b]), a) for a, b in zip(cuts, ends) if b - a > 1)
        end, half, run = ends[cuts.index(at)], at + 1, sizes[at]
        while half < end - 1 and run + sizes[half] <= load / 2:
            run += sizes[half]
            half += 1
        cuts = sorted({*cuts, half})
    return cuts, low


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: sizes (UTF-8 bytes plus 16; null text: 16) are as near equal as
    contiguous atomic groups allow. Null and empty texts are equal. slot counts
    from 0 without gaps in each shard, over repeated ids too. An empty table
    gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    unit = F.conv(F.substring(F.md5(text), 1, UNIT_BITS // 4), 16, 10).cast("int")
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), unit.alias("unit")), "sized")
    found = rows.groupBy("unit").agg(F.sum("size").alias("n")).collect()  # at most 2**UNIT_BITS rows
    by_unit = sorted((r["unit"], r["n"]) for r in found)
    cuts, _ = minimax_cuts([n for _, n in by_unit], shards)
    starts = [by_unit[c][0] for c in cuts[1:]] if by_unit else []
    shard = F.size(F.filter(F.array(*map(F.lit, starts)), lambda c: c <= F.col("unit"))) if starts else F.lit(0)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.lit(SUB_BUCKETS)).cast("int"))
    counts = placed.groupBy("shard", "sub").count().collect()  # at most shards * SUB_BUCKETS rows
    base, offsets = dict.fromkeys(range(shards), 0), []
    for r in sorted(counts, key=lambda r: (r["shard"], r["sub"])):
        offsets.append((r["shard"], r["sub"], base[r["shard"]]))
        base[r["shard"]] += r["count"]
    offset = docs.sparkSession.createDataFrame(offsets, "shard int, sub int, before long")
    local = F.row_number().over(W.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32")) - 1
    # the offsets are bounded by shards * SUB_BUCKETS rows of 16 bytes
    return placed.withColumn("local", local).join(F.broadcast(offset), ["shard", "sub"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("local")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op1_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))
