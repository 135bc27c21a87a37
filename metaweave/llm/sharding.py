"""Minimax contiguous partition of ordered atomic groups into shards.

Groups (equal texts) are ordered by content digest, which is a stable shuffle of the
corpus, and never split.  The smallest feasible shard capacity is found by a search that
keeps the interval (infeasible, feasible] and shrinks it ``PROBES`` + 1 fold a round: all
probes of a round are checked greedily side by side, and one greedy step of all of them is
one aggregation over the table of group ends.  Then the rows are cut there.

Prefix sums are distributed: rows are range-partitioned by (digest, doc_id, row), so a hot
text spreads over partitions; each partition is summed, and only the per-partition totals
(one row a partition) are accumulated and broadcast.

Law ``bytes``: sizes are as near equal as atomic groups allow (the largest shard is the
smallest possible for this order).

Defined cases: null text has size 1 and is grouped with empty text; null doc_ids sort
first; repeated rows are rows of their own; fewer groups than shards leave the last shards
empty; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaweave.plans.scratch import cut, release

SHARDS = 8
PROBES = 31


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + 1


def ordered(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, digest, upto, place``: running bytes and row number."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = cut(
        docs.select(
            "doc_id",
            size_of().alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.sha2(raw, 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    keys = ["digest", "doc_id", "row"]
    ranged = cut(narrow.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranged")
    release(narrow)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(  # one row a partition of the exchange above
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"),
    )
    within = W.partitionBy("part").orderBy(*keys)
    out = ranged.join(F.broadcast(starts), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        "digest",
        (F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) + F.col("bytes0")).alias("upto"),
        (F.row_number().over(within) + F.col("rows0") - 1).alias("place"),
    )
    out = cut(out, "ordered")
    release(ranged)
    return out


def greedy(ends: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """Where each capacity's greedy cuts fall: the running bytes at the end of each shard."""
    cuts: list[list[int]] = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(shards):
        limits = [a + c for a, c in zip(at, capacities)]
        row = (
            ends.where((F.col("upto") > min(at)) & (F.col("upto") <= max(limits)))
            .agg(*[F.max(F.when(F.col("upto") <= limit, F.col("upto"))).alias(f"c{i}") for i, limit in enumerate(limits)])
            .first()
        )
        at = [max(a, row[i] or 0) for i, a in enumerate(at)]
        for i, a in enumerate(at):
            cuts[i].append(a)
    return cuts


def capacity(ends: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which the groups fit into ``shards``, and its cuts."""
    top = ends.agg(F.max("upto").alias("total"), F.max("size").alias("largest")).first()
    total, largest = top["total"] or 0, top["largest"] or 0
    if not total:
        return 0, [0] * shards
    low = max(largest, -(-total // shards)) - 1  # infeasible
    high = -(-total // shards) + largest  # greedy always fits
    best: list[int] | None = None
    while high - low > 1:
        step = max(1, -(-(high - low) // (PROBES + 1)))
        probes = [c for c in range(low + step, high, step)][:PROBES]
        for c, cuts in zip(probes, greedy(ends, probes, shards)):
            if cuts[-1] >= total:
                high, best = c, cuts
                break
            low = c
    return high, best if best is not None else greedy(ends, [high], shards)[0]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, capacity``; slots are gapless from 0."""
    rows = ordered(docs)
    ends = cut(
        rows.groupBy("digest")
        .agg(F.max("upto").alias("upto"), F.sum("size").alias("size"))
        .select("upto", "size")
        .repartitionByRange("upto")
        .sortWithinPartitions("upto"),
        "ends",
    )
    most, cuts = capacity(ends, shards)
    release(ends)
    number = F.lit(0)
    for c in cuts[:-1]:
        number = number + (F.col("upto") > c).cast("int")
    found = rows.withColumn("shard", number)
    firsts = found.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    return found.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("place") - F.col("first")).cast("bigint").alias("slot"),
        F.lit(most).cast("bigint").alias("capacity"),
    )
