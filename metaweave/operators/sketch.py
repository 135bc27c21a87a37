"""Bottom-k sketches: hashes of start nodes carried along a meta-path, never materialised.

Long form is ``(node, layer, hashes)``; wide form is ``(node, layers)`` with one array a
layer.  Hashes and sketches are sets; sentinels of the reference are shorter arrays here.
Cutting to the smallest k uses a ranked window that Spark limits per task before the
shuffle, so a hub never ships more than k values a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaweave.functions import arrays as A
from metaweave.operators.estimates import met_weights


def undirected(edges: DataFrame) -> DataFrame:
    """``node, other`` from both ends, each pair once."""
    return (
        edges.select(F.col("src").alias("node"), F.col("dst").alias("other"))
        .unionAll(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
        .distinct()
    )


def owners(nodes: DataFrame, start: str, nk: int = 1, hash_of=A.mixed_hash) -> DataFrame:
    """``node, layer, hash`` for every start-type node and layer."""
    layers = F.explode(F.sequence(F.lit(0), F.lit(nk - 1)))
    return nodes.where(F.col("type") == start).select(F.col("id").alias("node"), layers.alias("layer")).withColumn("hash", hash_of("node", "layer"))


def smallest(rows: DataFrame, k: int) -> DataFrame:
    """``node, layer, hash`` cut to the k smallest distinct hashes of each node and layer."""
    rank = F.dense_rank().over(W.partitionBy("node", "layer").orderBy("hash"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r").distinct()


def propagate(nodes: DataFrame, edges: DataFrame, types: list[str], own: DataFrame, k: int) -> DataFrame:
    """Rows ``node, layer, hash``: the k+1 smallest start hashes that reach each end node.

    A step joins the neighbours of the nodes of the next type with the sketches so far; walks
    may revisit nodes.
    """
    kinds = nodes.select("id", "type")
    adj = undirected(edges)
    rows = own
    for kind in types[1:]:
        here = kinds.where(F.col("type") == kind).select(F.col("id").alias("node"))
        reached = adj.join(here, "node").join(rows.withColumnRenamed("node", "other"), "other")
        rows = smallest(reached.select("node", "layer", "hash"), k + 1)
    return rows


def packed(rows: DataFrame) -> DataFrame:
    """Long form with arrays: ``node, layer, hashes``."""
    return rows.groupBy("node", "layer").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))


def wide(long: DataFrame, nk: int) -> DataFrame:
    """``node, layers``; a missing layer is an empty array."""
    held = F.map_from_entries(F.collect_list(F.struct("layer", "hashes")))
    none = F.array().cast("array<bigint>")
    layers = F.transform(F.sequence(F.lit(0), F.lit(nk - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), none))
    return long.groupBy("node").agg(held.alias("m")).select("node", layers.alias("layers"))


def without_self(long: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """Own hashes removed from the k+1 candidates, cut to k."""
    mine = own.groupBy("node", "layer").agg(F.collect_set("hash").alias("own"))
    none = F.array().cast("array<bigint>")
    return long.join(mine, ["node", "layer"], "left").select(
        "node", "layer", A.without("hashes", F.coalesce(F.col("own"), none), k).alias("hashes")
    )


def sketch_graph(nodes: DataFrame, edges: DataFrame, types: list[str], k: int, nk: int = 1, hash_of=A.mixed_hash) -> tuple[DataFrame, DataFrame]:
    """``(sketches, owners)`` of the nodes of the start type that reach another node.

    ``sketches`` is wide, without self; ``owners`` is ``node, layer, hash``.
    """
    own = owners(nodes, types[0], nk, hash_of)
    long = without_self(packed(propagate(nodes, edges, types, own, k)), own, k)
    targets = nodes.where(F.col("type") == types[0]).select(F.col("id").alias("node"))
    found = wide(long.join(targets, "node", "left_semi"), nk)
    return found.where(F.exists("layers", lambda x: F.size(x) > 0)), own


def adjacency(sketches: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """``node, other``: exact neighbours of the nodes whose first layer isn't full."""
    small = sketches.where(~A.full("layers", k)).select("node", F.explode(F.get("layers", F.lit(0))).alias("hash"))
    who = own.where("layer = 0").select(F.col("node").alias("other"), "hash")
    return small.join(who, "hash").select("node", "other")


def degrees(sketches: DataFrame, own: DataFrame, k: int, space: int = A.MAX_HASH) -> DataFrame:
    """``node, degree``: the estimate where full, else the exact count, a self loop twice."""
    adj = adjacency(sketches, own, k).groupBy("node").agg(
        F.sum(F.when(F.col("node") == F.col("other"), 2.0).otherwise(1.0)).alias("exact")
    )
    return sketches.join(adj, "node", "left").select(
        "node",
        F.when(A.full("layers", k), A.cardinality("layers", k, space)).otherwise(F.coalesce("exact", F.lit(0.0))).alias("degree"),
    )


def total_weight(degree: DataFrame) -> DataFrame:
    return degree.agg((F.sum("degree") / 2).alias("total_weight"))


def community_sketches(own: DataFrame, assign: DataFrame, k: int, nk: int = 1) -> DataFrame:
    """``comm, layers, members``: the identity sketch of each community, always recomputed."""
    rows = own.join(assign, "node").select(F.col("comm").alias("node"), "layer", "hash")
    size = assign.groupBy("comm").agg(F.count(F.lit(1)).alias("members"))
    made = wide(packed(smallest(rows, k)), nk).withColumnRenamed("node", "comm")
    return made.join(size, "comm")


def _estimate(node_layers: Column, comm_layers: Column, members: Column, k: int, space: int) -> Column:
    union = A.merge_layers(node_layers, comm_layers, k)
    return A.intersection_size(A.cardinality(node_layers, k, space), members.cast("double"), A.cardinality(union, k, space))


def community_weights(sketches: DataFrame, own: DataFrame, assign: DataFrame, k: int, nk: int = 1, space: int = A.MAX_HASH, every: bool = False) -> DataFrame:
    """``node, comm, w``: exact for nodes whose sketch isn't full, by inclusion-exclusion for full ones.

    Full nodes get an estimate for each community that they have met (:mod:`estimates`).  ``every`` asks for
    all communities instead, nodes x communities: beyond those met the estimate says nothing of
    edges, it is the member count wherever no hash of a community is below the node's largest.
    """
    comms = community_sketches(own, assign, k, nk).withColumnRenamed("layers", "c")
    big = sketches.where(A.full("layers", k))
    if every:
        estimated = big.crossJoin(comms).select("node", "comm", _estimate(F.col("layers"), F.col("c"), F.col("members"), k, space).alias("w"))
    else:
        estimated = met_weights(big, own, assign, comms.withColumnRenamed("members", "n"), k, nk, space)
    exact = (
        adjacency(sketches, own, k)
        .join(assign.withColumnRenamed("node", "other"), "other")
        .groupBy("node", "comm")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    return estimated.unionByName(exact)


def candidates(weights: DataFrame, assign: DataFrame) -> DataFrame:
    """The communities a node may move to, its own always among them (weight 0 if not listed)."""
    mine = assign.select("node", "comm").join(weights, ["node", "comm"], "left_anti").withColumn("w", F.lit(0.0))
    return weights.unionByName(mine)


def community_cardinality(degree: DataFrame, assign: DataFrame) -> DataFrame:
    return degree.join(assign, "node").groupBy("comm").agg(F.sum("degree").alias("tot"))


def super_nodes(sketches: DataFrame, own: DataFrame, assign: DataFrame, k: int, nk: int = 1) -> tuple[DataFrame, DataFrame]:
    """Sketches united by community and owners re-pointed to it; own hashes of members leave."""
    pointed = own.join(assign, "node").select(F.col("comm").alias("node"), "layer", "hash").distinct()
    rows = sketches.join(assign, "node").select(F.col("comm").alias("node"), F.posexplode("layers").alias("layer", "h"))
    rows = rows.select("node", "layer", F.explode("h").alias("hash"))
    return wide(packed(smallest(rows, k)), nk), pointed


def super_adjacency(adj: DataFrame, assign: DataFrame) -> DataFrame:
    """``u, v, w`` among communities from exact rows: internal pairs count half, self loops whole."""
    a = assign.withColumnsRenamed({"comm": "u"})
    b = assign.withColumnsRenamed({"node": "other", "comm": "v"})
    w = F.when((F.col("u") == F.col("v")) & (F.col("node") != F.col("other")), 0.5).otherwise(1.0)
    return adj.join(a, "node").join(b, "other").groupBy("u", "v").agg(F.sum(w).alias("w"))


def reconstruct(sketches: DataFrame, own: DataFrame, k: int, nk: int = 1, threshold: float = 0.0, space: int = A.MAX_HASH, every: bool = False) -> DataFrame:
    """``src, dst, weight`` above the threshold: for full nodes the estimate to each neighbour that
    the sketch holds (``every``: to each node, nodes x nodes), exact for others."""
    single = own.select("node", F.col("node").alias("comm")).distinct()
    w = community_weights(sketches, own, single, k, nk, space, every)
    targets = sketches.select(F.col("node").alias("comm"))
    return (
        w.join(targets, "comm", "left_semi")
        .where((F.col("node") != F.col("comm")) & (F.col("w") > threshold))
        .select(F.col("node").alias("src"), F.col("comm").alias("dst"), F.col("w").alias("weight"))
    )


def leaf_adjacency(sketches: DataFrame, own: DataFrame) -> DataFrame:
    """``node, other``: owners of any hash in any layer, both directions, no self, each once."""
    rows = sketches.select("node", F.posexplode("layers").alias("layer", "h")).select("node", "layer", F.explode("h").alias("hash"))
    met = rows.join(own.withColumnRenamed("node", "other"), ["layer", "hash"]).where("node <> other").select("node", "other")
    return met.unionAll(met.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()


def level_graph(adj: DataFrame, assign: DataFrame) -> DataFrame:
    """``u, v, w`` with u <= v: leaf pairs per community pair, the larger direction, self halved."""
    a = assign.withColumnsRenamed({"comm": "a"})
    b = assign.withColumnsRenamed({"node": "other", "comm": "b"})
    return larger_direction(adj.join(a, "node").join(b, "other").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w")))


def larger_direction(counts: DataFrame) -> DataFrame:
    """``u, v, w`` with u <= v of the counts ``a, b, w``: the larger direction, self halved."""
    out = counts.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.max("w").alias("w"))
    return out.withColumn("w", F.when(F.col("u") == F.col("v"), F.col("w") / 2).otherwise(F.col("w")))


def unique_edges(adj: DataFrame) -> DataFrame:
    """Undirected edges of a sketch graph, each once."""
    return adj.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
