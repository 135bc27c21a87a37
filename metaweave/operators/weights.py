"""Normalisation and statistics of edge weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.model import Aggregation
from metaweave.operators.ranks import at_places
from metaweave.operators.totals import small
from metaweave.plans.scratch import cut


def strengths(edges: DataFrame) -> DataFrame:
    """``id, strength``: the sum of weights over all edges in and out."""
    both = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
    return both.groupBy("id").agg(F.sum("weight").alias("strength"))


def degree_normalised(edges: DataFrame) -> DataFrame:
    """w / sqrt(s_u * s_v); unchanged where a strength isn't positive."""
    s = cut(strengths(edges), "strengths")
    s = small(s, s.count())  # the edges stay where they are
    out = edges.join(s.withColumnsRenamed({"id": "src", "strength": "su"}), "src").join(
        s.withColumnsRenamed({"id": "dst", "strength": "sv"}), "dst"
    )
    scaled = F.when((F.col("su") > 0) & (F.col("sv") > 0), F.col("weight") / F.sqrt(F.col("su") * F.col("sv"))).otherwise(F.col("weight"))
    return out.select("src", "dst", scaled.alias("weight"))


def _with(edges: DataFrame, *aggregates) -> DataFrame:
    """Edges beside one row of global aggregates."""
    return edges.crossJoin(F.broadcast(edges.agg(*aggregates)))


def max_normalised(edges: DataFrame) -> DataFrame:
    """Min-max to 0..1; all equal gives 1."""
    out = _with(edges, F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return out.select("src", "dst", scaled.alias("weight"))


def zscore_normalised(edges: DataFrame) -> DataFrame:
    """Population z-score; without spread all are 0."""
    out = _with(edges, F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("sd"))
    return out.select("src", "dst", F.when(F.col("sd") > 0, (F.col("weight") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("weight"))


def custom_normalised(edges: DataFrame, expression) -> DataFrame:
    """``expression(edges)`` is a Column; rows where it is null, NaN or infinite are dropped."""
    out = edges.withColumn("weight", expression(edges).cast("double"))
    return out.where(finite("weight")).select("src", "dst", "weight")


def normalise(edges: DataFrame, setting: Aggregation) -> DataFrame:
    if setting.normalisation == "custom":
        return custom_normalised(edges, setting.custom)
    return {"none": lambda e: e, "degree": degree_normalised, "max": max_normalised, "zscore": zscore_normalised}[setting.normalisation](edges)


def finite(name: str = "weight"):
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def valid_weight(name: str = "weight"):
    return finite(name) & (F.col(name) >= 0)


def statistics(edges: DataFrame, points=(0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: count, sum, mean, min, max, population variance and deviation, percentiles.

    A percentile is the value at place floor(p * n) of the sorted weights, found by refining
    histograms; nothing is sorted.
    """
    held = cut(edges.select(F.col("weight").cast("double").alias("weight")), "weights")
    basic = held.agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("weight").alias("sum"),
        F.avg("weight").alias("mean"),
        F.min("weight").alias("min"),
        F.max("weight").alias("max"),
        F.var_pop("weight").alias("variance"),
        F.stddev_pop("weight").alias("stddev"),
    )
    n = held.where("weight is not null").count()
    at = {f"p{round(p * 100)}": math.floor(p * n) for p in points}
    found = at_places(held, "weight", at.values())
    return basic.select("*", *[F.lit(found.get(place)).cast("double").alias(name) for name, place in at.items()])


def bucket(name: str = "weight"):
    """Half-open weight classes."""
    c = F.col(name)
    return (
        F.when(c < 1, "0-1").when(c < 5, "1-5").when(c < 10, "5-10").when(c < 50, "10-50").when(c < 100, "50-100").otherwise("100+")
    )


def buckets(edges: DataFrame) -> DataFrame:
    return edges.groupBy(bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def above(edges: DataFrame, least: float) -> DataFrame:
    """A filter after normalisation."""
    return edges.where(F.col("weight") >= least)
