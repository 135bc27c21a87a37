"""Community identifiers ``c0_l{level}_{number}`` and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def community_id(level, number) -> Column:
    level = F.lit(level) if isinstance(level, int) else F.col(level) if isinstance(level, str) else level
    number = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit("c0_l"), level.cast("string"), F.lit("_"), number.cast("string"))


def level_of(name) -> Column:
    """The level in an id, or null for anything else (a leaf)."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract(c, r"^c\d+_l(\d+)_", 1).try_cast("int")


def number_of(name) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract(c, r"_(\d+)$", 1).try_cast("bigint")


def is_leaf(name) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return ~c.startswith("c0_")


def dense_ids(df, key: str, name: str = "n"):
    """Whole numbers from 0: numeric order where every key is a number, else text order.

    Numbers come from per-partition counts, not from one sorted task.
    """
    odd = df.where(F.col(key).cast("string").try_cast("bigint").isNull()).limit(1).count()
    order = F.col(key).cast("string") if odd else F.col(key).cast("string").try_cast("bigint")
    ranged = df.select(F.col(key), order.alias("_o")).distinct().repartitionByRange("_o").withColumn("_p", F.spark_partition_id())
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", before.alias("_s"))
    return ranged.join(F.broadcast(starts), "_p").select(
        key, (F.row_number().over(W.partitionBy("_p").orderBy("_o")) + F.col("_s") - 1).alias(name)
    )


def six(c) -> Column:
    return F.format_string("%.6f", F.col(c) if isinstance(c, str) else c)


def one_decimal(c) -> Column:
    return F.format_string("%.1f", F.col(c) if isinstance(c, str) else c)
