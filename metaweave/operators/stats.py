"""Statistics of typed and of homogeneous graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.functions.ids import one_decimal
from metaweave.model import Graph, MetaPath
from metaweave.operators import metapath as M
from metaweave.operators.components import star_components


def node_types(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def edge_types(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("etype").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def degree_summary(graph: Graph) -> DataFrame:
    """``avg_degree, max_degree``: total degree over all nodes, isolated ones included."""
    d = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    n = graph.nodes.agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("total"), F.coalesce(F.max("d"), F.lit(0)).alias("max_degree")).crossJoin(n).select(
        F.coalesce(F.try_divide(F.col("total"), F.col("n")), F.lit(0.0)).alias("avg_degree"), "max_degree"
    )


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes, edges, density, avg_weight, min_weight, max_weight``.

    Density is directed edges over n(n-1)/2, so up to 2.
    """
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(
        F.count(F.lit(1)).alias("edges"), F.coalesce(F.avg("weight"), F.lit(0.0)).alias("avg_weight"),
        F.coalesce(F.min("weight"), F.lit(0.0)).alias("min_weight"), F.coalesce(F.max("weight"), F.lit(0.0)).alias("max_weight"),
    )
    most = F.col("nodes") * (F.col("nodes") - 1) / 2
    return n.crossJoin(e).withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / most).otherwise(0.0))


def degree_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def weight_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy(one_decimal("weight").alias("weight")).agg(F.count(F.lit(1)).alias("n"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: undirected; an isolated node is its own."""
    found = star_components(edges, "src", "dst")
    return nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def path_components(graph: Graph, path: MetaPath) -> DataFrame:
    """Components over the nodes and edges that a step of the path can use."""
    steps = list(zip(path.node_types, path.edge_types, path.node_types[1:]))
    fits = None
    for a, e, b in steps:
        one = (F.col("src_type") == a) & (F.col("etype") == e) & (F.col("dst_type") == b)
        fits = one if fits is None else fits | one
    nodes = graph.nodes.where(F.col("type").isin(*dict.fromkeys(path.node_types)))
    return components(nodes, M.typed_edges(graph).where(fits))


def component_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
