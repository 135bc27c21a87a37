"""Degrees that sketches give, in two ways each, beside the true ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.functions import arrays as A
from metaweave.operators import legacy
from metaweave.operators import ordered as O
from metaweave.operators import sketch as S
from metaweave.plans.scratch import cut


def community_degrees(sketches: DataFrame, own: DataFrame, assign: DataFrame, k: int, nk: int = 1, space: int = A.MAX_HASH) -> DataFrame:
    """``comm, by_sum, by_union``: the sum of the members' degrees, and the cardinality of the union
    of their sketches (the sum where that isn't full)."""
    unions = legacy.community_unions(sketches, own, assign, k, nk, space)
    by_union = F.when(A.full("layers", k), A.cardinality("layers", k, space)).otherwise(F.col("tot"))
    return unions.select("comm", F.col("tot").alias("by_sum"), by_union.alias("by_union"))


def degrees_by_edges(sketches: DataFrame, own: DataFrame, k: int, threshold: float = 0.1, space: int = A.MAX_HASH) -> DataFrame:
    """``node, by_sketch, by_edges`` for sketches of one layer: the degree, and the sum over all other
    nodes of the estimated edge weight where it is above ``threshold`` (below 1).

    The estimate ``n + 1 - |union|`` depends on the other node's one hash ``h`` only by where it lies.
    With ``a < b`` the two largest hashes of a full sketch, it is 1 where the sketch holds ``h`` or
    ``h > b``; ``n + 1 - (k - 1) space / a`` for any other ``h < a``; and ``n + 1 - (k - 1) space / h``
    between.  So sums over all nodes come from running sums of 1 and ``1 / h`` over the sorted
    hashes, looked up at three places a node; no pair of nodes is formed.
    """
    hashes = F.get("layers", F.lit(0))
    one = float(k - 1) * space
    full = sketches.where(A.full("layers", k)).select("node", hashes.alias("h")).withColumns({"a": F.get("h", F.lit(k - 2)), "b": F.get("h", F.lit(k - 1))})
    full = full.withColumn("n", F.lit(one) / F.col("b"))
    # estimates between a and b are above the threshold for hashes above this
    full = full.withColumn("t", F.least(F.col("b") - 1, F.greatest("a", F.floor(F.lit(one) / (F.col("n") + 1 - threshold)))))
    mine = own.where("layer = 0").select("node", F.col("hash").alias("own"))
    full = cut(full.join(mine, "node"), "full")
    targets = mine.join(sketches.select("node"), "node", "left_semi").groupBy(F.col("own").alias("at")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.lit(1.0) / F.col("own")).alias("i"))
    asked = full.select(F.explode(F.array("a", "b", "t")).alias("at")).distinct().select("at", F.lit(0).cast("bigint").alias("c"), F.lit(0.0).alias("i"))
    line = targets.unionByName(asked).groupBy("at").agg(F.sum("c").alias("c"), F.sum("i").alias("i"))
    upto = cut(O.running_sums(line, [], "at", {"cc": "c", "ii": "i"}), "upto")
    rows = full
    for x in "abt":
        rows = rows.join(upto.select(F.col("at").alias(x), F.col("cc").alias(f"c{x}"), F.col("ii").alias(f"i{x}")), x)
    whole = sketches.agg(F.count(F.lit(1)).alias("all"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    low = F.greatest(F.lit(0.0), F.col("n") + 1 - F.lit(one) / F.col("a"))
    low = F.when(low > threshold, low).otherwise(0.0)
    # the place of the node's own hash, which is not in its sketch: it is no edge
    between = (F.col("n") + 1) * F.lit(1.0) - F.lit(one) / F.col("own")
    itself = F.when(F.col("own") > F.col("b"), 1.0).when(F.col("own") < F.col("a"), low).otherwise(F.when((F.col("own") > F.col("t")) & (between > threshold), between).otherwise(0.0))
    held = F.size("h").cast("double")  # each hash of a sketch has an owner with a sketch where walks go both ways
    above = F.col("all") - F.col("cb")
    under = (F.col("ca") - (held - 1)) * low
    cb, ib = F.col("cb") - 1, F.col("ib") - F.lit(1.0) / F.col("b")
    middle = (cb - F.col("ct")) * (F.col("n") + 1) - F.lit(one) * (ib - F.col("it"))
    middle = F.when(F.col("t") < F.col("b") - 1, middle).otherwise(0.0)
    estimated = rows.select("node", F.col("n").alias("by_sketch"), (held + above + under + middle - itself).alias("by_edges"))
    counted = S.adjacency(sketches, own, k).where("node <> other").groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("by_edges"))
    exact = S.degrees(sketches.where(~A.full("layers", k)), own, k, space).join(counted, "node", "left")
    return estimated.unionByName(exact.select("node", F.col("degree").alias("by_sketch"), F.coalesce("by_edges", F.lit(0.0)).alias("by_edges")))
