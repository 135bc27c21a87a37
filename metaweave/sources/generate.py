"""Random graphs from a hash of the pair, the same in every engine and on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PRIME = 2147483647


def chance(a: str, b: str, seed: int) -> Column:
    """A number in [0, 1) from two whole numbers, by arithmetic that SQL engines share."""
    x = F.pmod(F.col(a) * 1103515245 + F.col(b) * 12345 + seed * 97 + 7, F.lit(_PRIME))
    for _ in range(3):
        x = F.pmod(x * 48271 + 11, F.lit(_PRIME))
    return x / float(_PRIME)


def pairs(spark: SparkSession, n: int) -> DataFrame:
    """``i < j`` below n, one row generator per i so that no all-pairs join is planned."""
    return spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.lit(n).cast("bigint"))).alias("j")).where(F.col("j") < n)


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 42) -> DataFrame:
    """``src, dst, weight``: each pair once with probability p."""
    return pairs(spark, n).where(chance("i", "j", seed) < p).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("weight"))


def planted_partition(spark: SparkSession, n: int, blocks: int, inside: float, between: float, seed: int = 42) -> DataFrame:
    """Blocks of consecutive numbers; pairs inside a block are likelier."""
    size = n // blocks
    same = F.floor(F.col("i") / size) == F.floor(F.col("j") / size)
    p = F.when(same, inside).otherwise(between)
    return pairs(spark, n).where(chance("i", "j", seed) < p).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("weight"))


def block_of(spark: SparkSession, n: int, blocks: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("node"), F.floor(F.col("id") / (n // blocks)).alias("comm"))


def random_sets(spark: SparkSession, n: int, sets: int, p: float, seed: int = 42) -> DataFrame:
    """``set, node``: each node in each set with probability p."""
    grid = spark.range(sets).select(F.col("id").alias("set"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("node"))
    return grid.where(chance("set", "node", seed) < p)


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
