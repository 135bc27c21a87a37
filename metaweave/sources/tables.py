"""A typed graph from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.model import Graph, MetaPath
from metaweave.operators.totals import totals
from metaweave.plans.scratch import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(letter: str, column: str):
    return F.concat(F.lit(f"{letter}:"), F.col(column).cast("string"))


def _nodes(df: DataFrame, letter: str, column: str, kind: str) -> DataFrame:
    return df.select(_key(letter, column).alias("id"), F.lit(kind).alias("type"))


def _edges(df: DataFrame, a: tuple[str, str], b: tuple[str, str], kinds: tuple[str, str], names: tuple[str, str], weight=None) -> DataFrame:
    """Both directions with types of their own; end types ride along."""
    w = F.lit(1.0) if weight is None else weight
    one = df.select(_key(*a).alias("src"), _key(*b).alias("dst"), w.alias("weight"))
    there = one.select("src", "dst", F.lit(names[0]).alias("etype"), "weight", F.lit(kinds[0]).alias("src_type"), F.lit(kinds[1]).alias("dst_type"))
    back = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(names[1]).alias("etype"), "weight", F.lit(kinds[1]).alias("src_type"), F.lit(kinds[0]).alias("dst_type"))
    return there.unionAll(back)


def supply_graph(spark: SparkSession, sf_dir: str, parallel: bool = False) -> Graph:
    """Suppliers and parts, an edge for each supplied part (``parallel``: each line, by quantity)."""
    lines = table(spark, sf_dir, "lineitem")
    nodes = _nodes(table(spark, sf_dir, "supplier"), "S", "s_suppkey", "supplier").unionAll(_nodes(table(spark, sf_dir, "part"), "P", "p_partkey", "part"))
    pairs = lines.select("l_suppkey", "l_partkey", "l_quantity") if parallel else lines.select("l_suppkey", "l_partkey").distinct()
    weight = F.col("l_quantity") if parallel else None
    return Graph(nodes, _edges(pairs, ("S", "l_suppkey"), ("P", "l_partkey"), ("supplier", "part"), ("supplies", "supplied_by"), weight))


SPS = MetaPath(("supplier", "part", "supplier"), ("supplies", "supplied_by"), "sps")
PSP = MetaPath(("part", "supplier", "part"), ("supplied_by", "supplies"), "psp")
SP = MetaPath(("supplier", "part"), ("supplies",), "sp")


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, orders, parts, suppliers, nations, regions."""
    t = lambda name: table(spark, sf_dir, name)
    nodes = _nodes(t("customer"), "C", "c_custkey", "customer")
    for df, letter, column, kind in (
        (t("orders"), "O", "o_orderkey", "order"), (t("part"), "P", "p_partkey", "part"), (t("supplier"), "S", "s_suppkey", "supplier"),
        (t("nation"), "N", "n_nationkey", "nation"), (t("region"), "R", "r_regionkey", "region"),
    ):
        nodes = nodes.unionAll(_nodes(df, letter, column, kind))
    edges = _edges(t("orders"), ("C", "o_custkey"), ("O", "o_orderkey"), ("customer", "order"), ("places", "placed_by"))
    edges = edges.unionAll(_edges(t("lineitem"), ("O", "l_orderkey"), ("P", "l_partkey"), ("order", "part"), ("contains", "contained_in"), F.col("l_quantity")))
    edges = edges.unionAll(_edges(t("lineitem").select("l_suppkey", "l_partkey").distinct(), ("S", "l_suppkey"), ("P", "l_partkey"), ("supplier", "part"), ("supplies", "supplied_by")))
    edges = edges.unionAll(_edges(t("customer"), ("C", "c_custkey"), ("N", "c_nationkey"), ("customer", "nation"), ("located_in", "home_of")))
    edges = edges.unionAll(_edges(t("supplier"), ("S", "s_suppkey"), ("N", "s_nationkey"), ("supplier", "nation"), ("located_in", "home_of")))
    edges = edges.unionAll(_edges(t("nation"), ("N", "n_nationkey"), ("R", "n_regionkey"), ("nation", "region"), ("part_of", "has_part")))
    return Graph(nodes, edges)


#: Customers of the same nation as a supplier, over three hops.
CNS = MetaPath(("customer", "nation", "supplier"), ("located_in", "home_of"), "cns")
RNC = MetaPath(("region", "nation", "customer", "order"), ("has_part", "home_of", "places"), "rnco")


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users and event types, weighted by count."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("w"))
    nodes = _nodes(e.select("user_id").distinct(), "U", "user_id", "user").unionAll(_nodes(e.select("event_type").distinct(), "T", "event_type", "event_type"))
    return Graph(nodes, _edges(e, ("U", "user_id"), ("T", "event_type"), ("user", "event_type"), ("did", "done_by"), F.col("w")))


def supplier_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``u < v, w`` on supplier numbers: parts that both supply."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("p")).distinct()
    # written: clustering, statistics and drawing read the ties several times
    found = totals(e, e.withColumnRenamed("u", "v"), "p", "u", "v", {"w": ("sum", None, None)}, "ascending")
    return cut(found.withColumn("w", F.col("w").cast("double")), "ties")
