"""Comparison of partitions and hierarchies.

Everything on pairs of nodes is computed from the contingency table in closed form; no
operator lists node pairs.  Partitions are ``node, comm``; hierarchies add ``level``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaweave.operators.product import product
from metaweave.operators.triangles import counted, dense
from metaweave.plans.scratch import cut


def contingency(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``a, b, n`` on the common nodes."""
    left = a.select(*by, "node", F.col("comm").alias("a"))
    right = b.select(*by, "node", F.col("comm").alias("b"))
    return left.join(right, [*by, "node"]).groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def _marginals(table: DataFrame, by: list[str]) -> DataFrame:
    rows = table.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    cols = table.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    total = table.groupBy(*by).agg(F.sum("n").alias("nt")) if by else table.agg(F.sum("n").alias("nt"))
    out = table.join(rows, [*by, "a"]).join(cols, [*by, "b"])
    return out.join(total, by) if by else out.crossJoin(F.broadcast(total))


def information(table: DataFrame, by: tuple[str, ...] = (), log=F.log2) -> DataFrame:
    """``mi, ha, hb, n``: mutual information and entropies; per group if ``by`` is given."""
    keys = list(by)
    full = _marginals(table, keys)
    p = F.col("n") / F.col("nt")
    mi = F.sum(p * log(F.col("n") * F.col("nt") / (F.col("na") * F.col("nb"))))
    # a marginal's term is shared out over its cells in proportion to their counts
    ha = -F.sum(p * log(F.col("na") / F.col("nt")))
    hb = -F.sum(p * log(F.col("nb") / F.col("nt")))
    grouped = full.groupBy(*keys) if keys else full.groupBy()
    return grouped.agg(F.greatest(mi, F.lit(0.0)).alias("mi"), F.greatest(ha, F.lit(0.0)).alias("ha"), F.greatest(hb, F.lit(0.0)).alias("hb"), F.sum("n").alias("n"))


def _nmi(mi: Column, ha: Column, hb: Column) -> Column:
    both_zero = (ha < 1e-12) & (hb < 1e-12)
    one_zero = (ha < 1e-12) | (hb < 1e-12)
    return F.when(both_zero, 1.0).when(one_zero, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * mi / (ha + hb))))


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``nmi`` on the common nodes: 2 MI / (Ha + Hb), base 2; null without common nodes."""
    info = information(contingency(a, b))
    return info.select(F.when(F.col("n").isNotNull(), _nmi(F.col("mi"), F.col("ha"), F.col("hb"))).alias("nmi"))


def nmi_per_level(a: DataFrame, b: DataFrame) -> DataFrame:
    info = information(contingency(a, b, ("level",)), ("level",))
    return info.select("level", _nmi(F.col("mi"), F.col("ha"), F.col("hb")).alias("nmi"))


def mean_nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    return nmi_per_level(a, b).agg(F.avg("nmi").alias("nmi"))


def level_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``la, lb, nmi`` for every pair of levels."""
    left = a.select(F.col("level").alias("la"), "node", F.col("comm").alias("a"))
    right = b.select(F.col("level").alias("lb"), "node", F.col("comm").alias("b"))
    table = left.join(right, "node").groupBy("la", "lb", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    info = information(table, ("la", "lb"))
    return info.select("la", "lb", _nmi(F.col("mi"), F.col("ha"), F.col("hb")).alias("nmi"))


def hmi_mean(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean over all level pairs of nmi / (1 + |difference of levels|)."""
    return level_pairs(a, b).agg(F.avg(F.col("nmi") / (1 + F.abs(F.col("la") - F.col("lb")))).alias("hmi"))


def hmi_weighted(a: DataFrame, b: DataFrame, least: int = 5) -> DataFrame:
    """Natural log; levels weighted 1/(level+1) over the levels both have; MI / sqrt(Ha * Hb).

    Null with fewer than ``least`` common leaves; a level with one community has MI 0.
    """
    table = contingency(a, b, ("level",))
    info = information(table, ("level",), F.log)
    kinds = table.groupBy("level").agg(F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    w = 1.0 / (F.col("level") + 1)
    mi = F.when((F.col("ka") < 2) | (F.col("kb") < 2), 0.0).otherwise(F.col("mi"))
    sums = info.join(kinds, "level").agg(
        F.sum(w * mi).alias("mi"), F.sum(w * F.col("ha")).alias("ha"), F.sum(w * F.col("hb")).alias("hb"), F.max("n").alias("n")
    )
    value = F.when((F.col("ha") > 0) & (F.col("hb") > 0), F.col("mi") / F.sqrt(F.col("ha") * F.col("hb"))).otherwise(0.0)
    return sums.select(F.when(F.col("n") >= least, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))).alias("hmi"))


def best_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """The level pair with the largest nmi, the first of equals."""
    return level_pairs(a, b).orderBy(F.desc("nmi"), "la", "lb").limit(1)


def _pairs(c: Column) -> Column:
    return c * (c - 1) / 2


def rand_index(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``rand``: the share of node pairs on which both agree; 1 for one node or none."""
    keys = list(by)
    table = contingency(a, b, by)

    def summed(df: DataFrame, name: str) -> DataFrame:
        total = F.sum(_pairs(F.col("n").cast("double"))).alias(name)
        return df.groupBy(*keys).agg(total) if keys else df.agg(total)

    cells = table.groupBy(*keys).agg(F.sum(_pairs(F.col("n").cast("double"))).alias("both"), F.sum("n").alias("n")) if keys else table.agg(
        F.sum(_pairs(F.col("n").cast("double"))).alias("both"), F.sum("n").alias("n")
    )
    rows = summed(table.groupBy(*keys, "a").agg(F.sum("n").alias("n")), "in_a")
    cols = summed(table.groupBy(*keys, "b").agg(F.sum("n").alias("n")), "in_b")
    out = cells.join(rows, keys).join(cols, keys) if keys else cells.crossJoin(rows).crossJoin(cols)
    every = _pairs(F.col("n").cast("double"))
    value = F.when(F.coalesce("n", F.lit(0)) <= 1, 1.0).otherwise(1 - (F.col("in_a") + F.col("in_b") - 2 * F.col("both")) / every)
    return out.select(*keys, value.alias("rand"))


def rescaled_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """max(0, 2 * rand - 1)."""
    return rand_index(a, b).select(F.greatest(F.lit(0.0), 2 * F.col("rand") - 1).alias("ari"))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hubert and Arabie's index, for those who expect it under that name."""
    table = contingency(a, b)
    pairs = F.sum(_pairs(F.col("n").cast("double")))
    both = table.agg(pairs.alias("both"), F.sum("n").alias("n"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs.alias("in_a"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs.alias("in_b"))
    expected = F.col("in_a") * F.col("in_b") / _pairs(F.col("n").cast("double"))
    top = (F.col("in_a") + F.col("in_b")) / 2
    return both.crossJoin(rows).crossJoin(cols).select(
        F.when((F.col("n") <= 1) | (top == expected), 1.0).otherwise((F.col("both") - expected) / (top - expected)).alias("ari")
    )


def per_level(a: DataFrame, b: DataFrame) -> DataFrame:
    """``level, rand, ari`` on the levels both have."""
    return rand_index(a, b, ("level",)).withColumn("ari", F.greatest(F.lit(0.0), 2 * F.col("rand") - 1))


def layout_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 / (1 + mean distance / 100) over common ids of ``id, x, y``."""
    both = a.select("id", F.col("x").alias("x1"), F.col("y").alias("y1")).join(b.select("id", F.col("x").alias("x2"), F.col("y").alias("y2")), "id")
    far = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)
    return both.agg((1 / (1 + F.avg(far) / 100)).alias("agds"))


def _jaccard(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left = a.select(*keys).distinct().withColumn("in_a", F.lit(1))
    right = b.select(*keys).distinct().withColumn("in_b", F.lit(1))
    both = left.join(right, keys, "full").agg(
        F.count(F.lit(1)).alias("either"), F.coalesce(F.sum(F.col("in_a") * F.col("in_b")), F.lit(0)).alias("common")
    )
    return both.select(F.when(F.col("either") == 0, 1.0).otherwise(F.col("common") / F.col("either")).alias("jaccard"))


def node_jaccard(a: DataFrame, b: DataFrame, key: str = "node") -> DataFrame:
    """Both empty 1, one empty 0."""
    return _jaccard(a, b, [key])


def edge_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """On undirected pairs."""
    pair = lambda e: e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    return _jaccard(pair(a), pair(b), ["u", "v"])


def layout_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine of the flattened coordinates of the common ids; null where a norm is zero."""
    both = a.select("id", F.col("x").alias("x1"), F.col("y").alias("y1")).join(b.select("id", F.col("x").alias("x2"), F.col("y").alias("y2")), "id")
    s = both.agg(
        F.sum(F.col("x1") * F.col("x2") + F.col("y1") * F.col("y2")).alias("dot"),
        F.sum(F.col("x1") ** 2 + F.col("y1") ** 2).alias("a"),
        F.sum(F.col("x2") ** 2 + F.col("y2") ** 2).alias("b"),
    )
    return s.select(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("dot") / F.sqrt(F.col("a") * F.col("b"))).alias("cosine"))


def visual_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard of the ids times the cosine of the common coordinates."""
    return node_jaccard(a, b, "id").crossJoin(layout_cosine(a, b)).select((F.col("jaccard") * F.col("cosine")).alias("similarity"))


def largest_community(assign: DataFrame, level: int | None = None) -> DataFrame:
    """``node`` of the largest community, ties to the smallest name."""
    here = assign if level is None else assign.where(F.col("level") == level)
    top = here.groupBy("comm").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "comm").limit(1)
    return here.join(F.broadcast(top), "comm").select("node")


def cophenetic(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson correlation of the merge levels of node pairs, over pairs merged in both.

    The merge level of a pair is the lowest level at which both share a community.  For nested
    hierarchies, pairs by (level a, level b) are counted from contingency tables of every level
    pair: those together at (i, j) but not at (i-1, j) or (i, j-1).
    """
    left = a.select(F.col("level").alias("i"), "node", F.col("comm").alias("a"))
    right = b.select(F.col("level").alias("j"), "node", F.col("comm").alias("b"))
    table = left.join(right, "node").groupBy("i", "j", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    upto = table.groupBy("i", "j").agg(F.sum(_pairs(F.col("n").cast("double"))).alias("m"))
    at = lambda di, dj, name: upto.select((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.col("m").alias(name))
    cell = (
        upto.join(at(1, 0, "up"), ["i", "j"], "left").join(at(0, 1, "left"), ["i", "j"], "left").join(at(1, 1, "both"), ["i", "j"], "left").na.fill(0.0)
    )
    c = F.col("m") - F.col("up") - F.col("left") + F.col("both")
    s = cell.select("i", "j", c.alias("c")).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("i")).alias("si"), F.sum(F.col("c") * F.col("j")).alias("sj"),
        F.sum(F.col("c") * F.col("i") * F.col("j")).alias("sij"), F.sum(F.col("c") * F.col("i") * F.col("i")).alias("sii"), F.sum(F.col("c") * F.col("j") * F.col("j")).alias("sjj"),
    )
    va = F.col("n") * F.col("sii") - F.col("si") ** 2
    vb = F.col("n") * F.col("sjj") - F.col("sj") ** 2
    return s.select(F.when((va > 0) & (vb > 0), (F.col("n") * F.col("sij") - F.col("si") * F.col("sj")) / F.sqrt(va * vb)).otherwise(0.0).alias("cophenetic"))


def category(value: Column) -> Column:
    return F.when(value >= 0.8, "High").when(value >= 0.5, "Medium").otherwise("Low")


def summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """``nmi, rand, ari, mean, category``: the mean is over those that exist."""
    out = nmi(a, b).crossJoin(rand_index(a, b)).crossJoin(rescaled_rand(a, b))
    held = F.array_compact(F.array("nmi", "rand", "ari"))
    mean = F.aggregate(held, F.lit(0.0), lambda t, x: t + x) / F.size(held)
    return out.withColumn("mean", mean).withColumn("category", category(F.col("mean")))


def against_baseline(base: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """``label, nmi, rand, ari, mean, category`` of one to nine others against a baseline."""
    if not 1 <= len(others) <= 9:
        raise ValueError("two to ten experiments are compared")
    out = None
    for label, assign in others.items():
        one = summary(base, assign).withColumn("label", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


def standard_settings(max_levels: int, max_iterations: int, min_gain: float) -> bool:
    return (max_levels, max_iterations) == (10, 100) and abs(min_gain - 1e-6) < 1e-12


def size_statistics(assign: DataFrame) -> DataFrame:
    """``clusters, mean, std, largest, smallest`` of community sizes; mean and std to 2 places."""
    sizes = assign.groupBy("comm").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.round(F.avg("n"), 2).alias("mean"),
        F.round(F.stddev_pop("n"), 2).alias("std"),
        F.max("n").alias("largest"),
        F.min("n").alias("smallest"),
    )


def agreement(value: Column) -> Column:
    return F.when(value > 0.7, "High").when(value > 0.4, "Moderate").otherwise("Low")


def run_differences(qa: float, qb: float, na: int, nb: int, sa: float, sb: float) -> dict[str, float]:
    """Differences of modularity and community counts and the ratio of run times."""
    return {"modularity": qb - qa, "communities": nb - na, "runtime": sb / sa if sa else 0.0}


def overview(assign: DataFrame) -> DataFrame:
    """One row: levels, leaves, communities, mean per level, mean branching."""
    per = assign.groupBy("level").agg(F.count_distinct("comm").alias("n"))
    above = per.select((F.col("level") - 1).alias("level"), F.col("n").alias("above"))
    branching = per.join(above, "level", "left").agg(
        F.count(F.lit(1)).alias("levels"), F.sum("n").alias("communities"), F.avg("n").alias("mean_per_level"), F.avg(F.col("n") / F.col("above")).alias("branching")
    )
    return branching.crossJoin(assign.agg(F.count_distinct("node").alias("leaves")))


def largest(assign: DataFrame, k: int = 5) -> DataFrame:
    """The k largest communities of all levels."""
    return assign.groupBy("level", "comm").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level", "comm").limit(k)


def subgraph_statistics(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Per community, over its distinct undirected inner edges: degrees, density, clustering.

    ``comm, members, edges, avg_degree, max_degree, min_degree, variance, density, clustering``;
    the smallest degree is 0 by the definition taken over.
    """
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    a = assign.select(F.col("node").alias("u"), "comm")
    b = assign.select(F.col("node").alias("v"), F.col("comm").alias("cv"))
    inner = cut(pair.join(a, "u").join(b, "v").where("comm = cv").select("comm", "u", "v").distinct(), "inner")
    ends = inner.select("comm", F.explode(F.array("u", "v")).alias("node")).groupBy("comm", "node").agg(F.count(F.lit(1)).alias("d"))
    every = assign.select("comm", "node").join(ends, ["comm", "node"], "left").na.fill(0, ["d"])
    shape = every.groupBy("comm").agg(
        F.count(F.lit(1)).alias("members"), (F.sum("d") / 2).cast("bigint").alias("edges"), F.avg("d").alias("avg_degree"),
        F.max("d").alias("max_degree"), F.lit(0).cast("bigint").alias("min_degree"), F.var_pop("d").alias("variance"),
        F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("wedges"),
    )
    # dense communities by products of matrices; of the others
    # triangles from edges directed to the end of larger degree: wedges stay near m * sqrt(m)
    rank = lambda e: e.select("comm", F.col("node"), F.col("d"))
    du = rank(ends).withColumnsRenamed({"node": "u", "d": "du"})
    dv = rank(ends).withColumnsRenamed({"node": "v", "d": "dv"})
    directed = inner.join(du, ["comm", "u"]).join(dv, ["comm", "v"])
    flip = (F.col("du") > F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") > F.col("v")))
    directed = directed.select("comm", F.when(flip, F.col("v")).otherwise(F.col("u")).alias("s"), F.when(flip, F.col("u")).otherwise(F.col("v")).alias("t"))
    directed = cut(directed, "directed")
    out = directed.groupBy("comm", "s").agg(F.count(F.lit(1)).alias("o")).groupBy("comm").agg((F.sum(F.col("o") * (F.col("o") - 1)) / 2).alias("wedges"))
    full = cut(dense(out, shape.select("comm", "members")), "dense")
    solid = counted(inner.join(F.broadcast(full.select("comm")), "comm", "left_semi"), every.select("comm", "node"), full) if not full.isEmpty() else None
    if solid is not None:
        directed = directed.join(F.broadcast(full.select("comm")), "comm", "left_anti")
    # wedges are added up by their ends where they are made; only pairs of ends meet the edges
    at = F.struct("comm", "s").alias("at")
    x, y = directed.select(at, "comm", F.col("t").alias("u")), directed.select(at, F.col("t").alias("v"))
    wedges = product(x, y, "at", ["comm", "u"], "v", [F.count(F.lit(1)).alias("n")], F.col("u") < F.col("v"))
    triangles = wedges.join(inner, ["comm", "u", "v"]).groupBy("comm").agg(F.sum("n").alias("triangles"))
    if solid is not None:
        triangles = triangles.unionByName(solid)
    n = F.col("members")
    return shape.join(triangles, "comm", "left").na.fill(0, ["triangles"]).select(
        "comm", "members", "edges", "avg_degree", "max_degree", "min_degree", "variance",
        F.when(n > 1, 2 * F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"),
        F.when(F.col("wedges") > 0, 3 * F.col("triangles") / F.col("wedges")).otherwise(0.0).alias("clustering"),
    )
