"""Running sums and next values over an order, without a group in one task.

Rows are range-partitioned by (keys, order), so a hot key is cut into several partitions.
Each partition finds its own sums and ends; what is carried from one partition to the next
is a row per partition and key.  Keys and order columns hold no nulls, and no two rows of a
key have the same order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaweave.plans.scratch import cut


def ranged(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows, written in ranges of (keys, order), with the number of their range ``_part``."""
    return cut(rows.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), "ranged")


def running_sums(rows: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, str]) -> DataFrame:
    """``rows`` with ``sums`` (new column -> summed column): the sum up to each row, itself included."""
    held = ranged(rows, keys, order)
    parts = held.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    until = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select("_part", *keys, *[F.coalesce(F.sum(f"_all_{n}").over(until), F.lit(0)).alias(f"_before_{n}") for n in sums])
    within = W.partitionBy("_part", *keys).orderBy(order)
    out = held.join(before, ["_part", *keys])
    return out.withColumns({n: F.sum(c).over(within) + F.col(f"_before_{n}") for n, c in sums.items()}).select(*rows.columns, *sums)


def next_values(rows: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the order of the next row of the key, null at the last."""
    held = ranged(rows, keys, order)
    first = held.groupBy("_part", *keys).agg(F.min(order).alias("_first"))
    by_key = W.partitionBy(*keys).orderBy("_part")
    after = first.select("_part", *keys, F.lead("_first").over(by_key).alias("_after"))
    within = W.partitionBy("_part", *keys).orderBy(order)
    return held.join(after, ["_part", *keys]).withColumn(name, F.coalesce(F.lead(order).over(within), "_after")).select(*rows.columns, name)
