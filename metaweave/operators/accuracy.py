"""Accuracy studies: count-min against bottom-k, and statistics of estimates.

Estimates are long tables, ``key.., exact, estimate`` with a ``method`` column where several
are compared; node sets are ``set, node``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaweave.functions import arrays as A
from metaweave.operators import ordered as O
from metaweave.operators.ranks import at_places, interpolated
from metaweave.plans.scratch import cut

# ---------------------------------------------------------------- count-min


def cms_buckets(item, depth: int, width: int, seed: int = 1) -> Column:
    """``row, bucket`` of an item in each row, by one seed vector for the whole run."""
    rows = F.sequence(F.lit(0), F.lit(depth - 1))
    return F.transform(rows, lambda r: F.struct(r.alias("row"), F.pmod(F.xxhash64(F.col(item).cast("string"), r + seed), F.lit(width)).alias("bucket")))


def arithmetic_buckets(item, depth: int, width: int) -> Column:
    """The same with a hash of whole numbers that any SQL engine can compute."""
    rows = F.sequence(F.lit(0), F.lit(depth - 1))
    return F.transform(
        rows,
        lambda r: F.struct(r.alias("row"), F.pmod(F.pmod(F.col(item).cast("bigint") * (A.MULTIPLIER - 2 * r) + 7919 * (r + 1), F.lit(A.PRIME)), F.lit(width)).alias("bucket")),
    )


def cms_build(edges: DataFrame, depth: int, width: int, buckets=cms_buckets) -> DataFrame:
    """``node, row, bucket, n``: one sketch of the targets of each source."""
    at = edges.select(F.col("src").alias("node"), F.explode(buckets("dst", depth, width)).alias("b"))
    return at.groupBy("node", "b.row", "b.bucket").agg(F.count(F.lit(1)).alias("n"))


def cms_merge(sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """``set, row, bucket, n``: sums over the nodes of each set."""
    return sketches.join(sets, "node").groupBy("set", "row", "bucket").agg(F.sum("n").alias("n"))


def cms_lookup(sketches: DataFrame, asked: DataFrame, depth: int, width: int, by: str = "node", buckets=cms_buckets) -> DataFrame:
    """``by, item, estimate``: the least counter of the item's buckets; 0 where one is empty."""
    at = asked.select(by, "item", F.explode(buckets("item", depth, width)).alias("b")).select(by, "item", "b.row", "b.bucket")
    return at.join(sketches, [by, "row", "bucket"], "left").groupBy(by, "item").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def cms_edges_merged(edges: DataFrame, a: DataFrame, b: DataFrame, depth: int, width: int, buckets=cms_buckets) -> DataFrame:
    """``a, b, estimate``: the merged sketch of set a asked for every node of set b."""
    merged = cms_merge(cms_build(edges, depth, width, buckets), a)
    asked = a.select("set").distinct().crossJoin(b.select(F.col("set").alias("b"), F.col("node").alias("item")))
    found = cms_lookup(merged, asked.select("set", "item").distinct(), depth, width, "set", buckets)
    return asked.join(found, ["set", "item"]).groupBy(F.col("set").alias("a"), "b").agg(F.sum("estimate").alias("estimate"))


def cms_edges_single(edges: DataFrame, a: DataFrame, b: DataFrame, depth: int, width: int, buckets=cms_buckets) -> DataFrame:
    """``a, b, estimate``: every node of a asked for every node of b.

    Items with the same bucket in every row are asked once for all.  A node meets, row by row,
    only the items whose counters so far are not zero; the rest adds nothing.
    """
    sketches = cms_build(edges, depth, width, buckets).join(a.select("node").distinct(), "node", "left_semi")
    at = b.select(F.col("set").alias("b"), F.col("node").alias("item"))
    places = at.select("item").distinct().select("item", F.explode(buckets("item", depth, width)).alias("p")).select("item", "p.row", "p.bucket")
    vectors = places.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "bucket"))), lambda x: x["bucket"]).alias("vector"))
    asked = at.join(vectors, "item").groupBy("b", "vector").agg(F.count(F.lit(1)).alias("many"))
    met = asked.select("vector").distinct()
    for row in range(depth):
        counter = sketches.where(F.col("row") == row).select("node", F.col("bucket").alias("_bucket"), F.col("n").alias("_n"))
        met = met.withColumn("_bucket", F.get("vector", F.lit(row)))
        met = met.join(counter, ["_bucket"] if row == 0 else ["node", "_bucket"])
        met = met.select("vector", "node", F.col("_n").alias("least") if row == 0 else F.least("least", "_n").alias("least"))
    found = met.join(asked, "vector").join(a.select(F.col("set").alias("a"), "node"), "node").groupBy("a", "b").agg(F.sum(F.col("least") * F.col("many")).alias("estimate"))
    pairs = a.select(F.col("set").alias("a")).distinct().crossJoin(b.select(F.col("set").alias("b")).distinct())  # the sets are the question
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("estimate", F.lit(0)).alias("estimate"))


# ---------------------------------------------------------------- bottom-k


def neighbour_sketches(edges: DataFrame, k: int, hash_of=A.mixed_hash, with_self: bool = True) -> DataFrame:
    """``node, hashes``: the k smallest hashes of each node's targets (and its own)."""
    rows = edges.select(F.col("src").alias("node"), hash_of("dst").alias("h"))
    if with_self:
        rows = rows.unionAll(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", hash_of("node").alias("h")))
    rank = F.dense_rank().over(W.partitionBy("node").orderBy("h"))
    return rows.withColumn("r", rank).where(F.col("r") <= k).groupBy("node").agg(F.array_sort(F.collect_set("h")).alias("hashes"))


def set_sketches(rows: DataFrame, k: int) -> DataFrame:
    """``set, hashes`` from ``set, h``."""
    rank = F.dense_rank().over(W.partitionBy("set").orderBy("h"))
    return rows.withColumn("r", rank).where(F.col("r") <= k).groupBy("set").agg(F.array_sort(F.collect_set("h")).alias("hashes"))


def _size(hashes: Column, k: int, space: int) -> Column:
    return F.when(F.size(hashes) < k, F.size(hashes).cast("double")).otherwise(A.cardinality_one(hashes, k, space))


def bottomk_edges_union(edges: DataFrame, a: DataFrame, b: DataFrame, k: int, hash_of=A.mixed_hash, space: int = A.MAX_HASH) -> DataFrame:
    """``a, b, estimate`` by inclusion-exclusion of the union over a with the identities of b."""
    held = neighbour_sketches(edges, k, hash_of).join(a, "node").select("set", F.explode("hashes").alias("h"))
    left = set_sketches(held, k).withColumnsRenamed({"set": "a", "hashes": "ha"})
    sizes = b.groupBy("set").agg(F.count(F.lit(1)).cast("double").alias("nb"))
    right = set_sketches(b.select("set", hash_of("node").alias("h")), k).join(sizes, "set").withColumnsRenamed({"set": "b", "hashes": "hb"})
    both = left.crossJoin(right)
    union = A.merge("ha", "hb", k)
    return both.select("a", "b", A.intersection_size(_size(F.col("ha"), k, space), F.col("nb"), _size(union, k, space)).alias("estimate"))


def bottomk_edges_sum(edges: DataFrame, a: DataFrame, b: DataFrame, k: int, hash_of=A.mixed_hash, space: int = A.MAX_HASH) -> DataFrame:
    """``a, b, estimate``: the same estimate for each node of a, summed."""
    held = neighbour_sketches(edges, k, hash_of).join(a.withColumnRenamed("set", "a"), "node")
    sizes = b.groupBy("set").agg(F.count(F.lit(1)).cast("double").alias("nb"))
    right = set_sketches(b.select("set", hash_of("node").alias("h")), k).join(sizes, "set").withColumnsRenamed({"set": "b", "hashes": "hb"})
    both = held.crossJoin(right)
    union = A.merge("hashes", "hb", k)
    one = A.intersection_size(_size(F.col("hashes"), k, space), F.col("nb"), _size(union, k, space))
    return both.groupBy("a", "b").agg(F.sum(one).alias("estimate"))


# ---------------------------------------------------------------- truth and summaries


def ground_truth(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``a, b, weight, multiplicity, density`` of the edges from each set a to each set b."""
    na = a.groupBy("set").agg(F.count(F.lit(1)).alias("na")).withColumnRenamed("set", "a")
    nb = b.groupBy("set").agg(F.count(F.lit(1)).alias("nb")).withColumnRenamed("set", "b")
    left = a.select(F.col("set").alias("a"), F.col("node").alias("src"))
    right = b.select(F.col("set").alias("b"), F.col("node").alias("dst"))
    met = edges.select("src", "dst").join(left, "src").join(right, "dst").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("weight"), F.count_distinct("dst").alias("targets")
    )
    return met.join(na, "a").join(nb, "b").select(
        "a", "b", "weight", (F.col("weight") / F.col("targets")).alias("multiplicity"), (F.col("weight") / (F.col("na") * F.col("nb"))).alias("density")
    )


def error_summary(found: DataFrame) -> DataFrame:
    """Per method: mean and largest absolute error, its correlation with density, and rank."""
    e = F.abs(F.col("estimate") - F.col("exact"))
    out = found.groupBy("method").agg(F.avg(e).alias("mae"), F.max(e).alias("max_error"), F.coalesce(F.try_divide(F.covar_samp(e, "density"), F.stddev_samp(e) * F.stddev_samp("density")), F.lit(0.0)).alias("density_r"))
    return out.withColumn("place", F.row_number().over(W.orderBy("mae", "method")))  # one row a method


def method_correlations(found: DataFrame, keys: list[str]) -> DataFrame:
    """``m1, m2, r``: Pearson correlation of the estimates of each two methods."""
    a = found.select(*keys, F.col("method").alias("m1"), F.col("estimate").alias("e1"))
    b = found.select(*keys, F.col("method").alias("m2"), F.col("estimate").alias("e2"))
    return a.join(b, keys).groupBy("m1", "m2").agg(
        F.coalesce(F.try_divide(F.covar_samp("e1", "e2"), F.stddev_samp("e1") * F.stddev_samp("e2")), F.lit(0.0)).alias("r")
    )


def pair_errors(found: DataFrame, by: tuple[str, ...] = ("level",)) -> DataFrame:
    """MAE, relative error, MAPE, extremes per group of ``exact, estimate``."""
    e = F.abs(F.col("estimate") - F.col("exact"))
    nonzero = F.when(F.col("exact") != 0, e / F.abs(F.col("exact")))
    return found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(e).alias("mae"),
        F.coalesce(F.try_divide(F.sum(e), F.sum(F.abs("exact"))), F.lit(0.0)).alias("relative"),
        F.coalesce(100 * F.avg(nonzero), F.lit(0.0)).alias("mape"), F.min(e).alias("least"), F.max(e).alias("most"),
    )


def degree_errors(found: DataFrame) -> DataFrame:
    """RMSE, MAE, MAPE (zeros skipped but counted), Pearson and R2 of ``exact, estimate``."""
    d = F.col("estimate") - F.col("exact")
    mean = found.agg(F.avg("exact").alias("mean"))
    s = found.crossJoin(F.broadcast(mean)).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
        (100 * F.sum(F.when(F.col("exact") != 0, F.abs(d) / F.abs(F.col("exact"))).otherwise(0.0)) / F.count(F.lit(1))).alias("mape"),
        F.coalesce(F.try_divide(F.covar_samp("exact", "estimate"), F.stddev_samp("exact") * F.stddev_samp("estimate")), F.lit(0.0)).alias("pearson"),
        F.sum(d * d).alias("res"), F.sum((F.col("exact") - F.col("mean")) ** 2).alias("tot"),
    )
    return s.withColumn("r2", F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(0.0)).drop("res", "tot")


def place_median(df: DataFrame, value: str) -> DataFrame:
    """The value at place floor(n / 2) of the sorted rows."""
    held = cut(df.select(value), "values")
    found = at_places(held, value, [held.where(F.col(value).isNotNull()).count() // 2])
    kind = dict(held.dtypes)[value]
    return held.agg(F.lit(next(iter(found.values()), None)).cast(kind).alias("median"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """mean, population deviation, extremes and interpolated percentiles."""
    held = cut(df.select(value), "values")
    names = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    found = dict(zip(names, interpolated(held, value, list(names.values()))))
    basic = held.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return basic.select("*", *[F.lit(x).cast("double").alias(n) for n, x in found.items()])


def best_k(found: DataFrame) -> DataFrame:
    """The k whose ratio of estimate to truth is nearest 1: score 1 - |ratio - 1|."""
    return found.withColumn("score", 1 - F.abs(F.col("ratio") - 1)).orderBy(F.desc("score"), "k").limit(1)


def moments(df: DataFrame, value: str) -> DataFrame:
    """mean, true median, population deviation, skewness, excess kurtosis."""
    held = cut(df.select(value), "values")
    (median,) = interpolated(held, value, [0.5])
    return held.agg(
        F.avg(value).alias("mean"), F.lit(median).cast("double").alias("median"), F.stddev_pop(value).alias("std"),
        F.coalesce(F.skewness(value), F.lit(0.0)).alias("skewness"), F.coalesce(F.kurtosis(value), F.lit(0.0)).alias("kurtosis"),
    )


def distances(both: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """KL, Jensen-Shannon, Wasserstein-1, cosine and Pearson of aligned ``idx, a, b``.

    For the first three each side is shifted by its minimum plus 1e-10 and normalised.
    """
    keys = list(by)
    held = cut(both.select(*keys, "idx", "a", "b"), "aligned")
    few = held.groupBy(*keys).agg(F.min("a").alias("la"), F.min("b").alias("lb"), F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.lit(1)).alias("n"))
    rows = held.join(few, keys) if keys else held.crossJoin(F.broadcast(few))  # one row
    side = lambda x, low, total: (F.col(x) - F.col(low) + 1e-10) / (F.col(total) - F.col("n") * (F.col(low) - 1e-10))
    rows = rows.select(*keys, "idx", "a", "b", side("a", "la", "ta").alias("p"), side("b", "lb", "tb").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    rows = O.running_sums(rows, keys, "idx", {"pp": "p", "qq": "q"}).withColumn("cdf", F.abs(F.col("pp") - F.col("qq")))
    kl = F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))
    js = (F.sum(F.col("p") * F.log(F.col("p") / m)) + F.sum(F.col("q") * F.log(F.col("q") / m))) / 2
    norm = F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    return grouped.agg(
        kl.alias("kl"), js.alias("js"), F.sum("cdf").alias("wasserstein"),
        F.coalesce(F.try_divide(F.sum(F.col("a") * F.col("b")), norm), F.lit(0.0)).alias("cosine"),
        F.coalesce(F.try_divide(F.covar_samp("a", "b"), F.stddev_samp("a") * F.stddev_samp("b")), F.lit(0.0)).alias("pearson"),
    )


def weight_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """``communities, mae, wasserstein, cosine, pearson`` of two tables ``comm, weight``.

    Only communities with a weight in both count, in the order of their ids; a repeated
    community has the sum of its weights. Without a common one, ``communities`` is 0 and the
    mean error null.
    """
    total = lambda df, name: df.where("weight IS NOT NULL").groupBy(F.col("comm").alias("idx")).agg(F.sum("weight").cast("double").alias(name))
    both = cut(total(a, "a").join(total(b, "b"), "idx"), "weights")
    errors = both.agg(F.count(F.lit(1)).alias("communities"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"))
    return errors.crossJoin(distances(both).select("wasserstein", "cosine", "pearson"))  # one row each


def over_samples(found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation (0 for one value), without NaN and infinities."""
    kept = found.where(~F.isnan(value) & (F.abs(value) != float("inf")))
    return kept.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))


def trend(series: DataFrame, order: str, value: str) -> DataFrame:
    """Second half against first half, with a band of 0.01."""
    n = series.agg(F.count(F.lit(1)).alias("n"))
    numbered = O.running_sums(series.select(order, value, F.lit(1).alias("_one")), [], order, {"_i": "_one"})
    placed = numbered.withColumn("i", F.col("_i") - 1).crossJoin(F.broadcast(n))  # one row
    early = F.avg(F.when(F.col("i") < F.floor(F.col("n") / 2), F.col(value)))
    late = F.avg(F.when(F.col("i") >= F.floor(F.col("n") / 2), F.col(value)))
    s = placed.agg(early.alias("early"), late.alias("late"))
    d = F.col("late") - F.col("early")
    return s.withColumn("trend", F.when(d > 0.01, "increasing").when(d < -0.01, "decreasing").otherwise("stable"))


def move_ranks(exact: DataFrame, sketched: DataFrame) -> DataFrame:
    """Per node: where the exactly best community stands among the sketched gains.

    Both are ``node, comm, gain``; ``score`` is (best - its gain) / (best - worst).
    """
    node = W.partitionBy("node")
    chosen = exact.withColumn("r", F.row_number().over(node.orderBy(F.desc("gain"), "comm"))).where("r = 1").select("node", "comm")
    ranked = sketched.select(
        "node", "comm", "gain", F.row_number().over(node.orderBy(F.desc("gain"), "comm")).alias("rank"),
        F.max("gain").over(node).alias("best"), F.min("gain").over(node).alias("worst"), F.count(F.lit(1)).over(node).alias("options"),
    )
    spread = F.col("best") - F.col("worst")
    return ranked.join(chosen, ["node", "comm"]).select(
        "node", "comm", "rank", "options", F.when(spread > 0, (F.col("best") - F.col("gain")) / spread).otherwise(0.0).alias("score")
    )


def rank_quality(ranks: DataFrame) -> DataFrame:
    """Mean rank, share of perfect ranks and of ranks up to 1, 3, 5 and 10."""
    share = lambda n: F.avg((F.col("rank") <= n).cast("double")).alias(f"top{n}")
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.avg("rank").alias("mean_rank"), F.avg((F.col("rank") == 1).cast("double")).alias("perfect"), share(1), share(3), share(5), share(10))


def rank_histogram(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def efficiency(runs: DataFrame) -> DataFrame:
    """Over runs of ``mean_rank, perfect``: mean, deviation, consistency and the joint score."""
    s = runs.agg(F.avg("mean_rank").alias("rank"), F.coalesce(F.stddev_samp("mean_rank"), F.lit(0.0)).alias("std"), F.avg("perfect").alias("perfect"))
    c = 1 / (1 + F.col("std"))
    return s.withColumn("consistency", c).withColumn("efficiency", 0.4 * F.col("perfect") + 0.3 / F.col("rank") + 0.3 * c)


def set_degree_errors(found: DataFrame) -> DataFrame:
    """Sum of degrees against the union sketch: errors of both and who is nearer how often."""
    es, eu = F.abs(F.col("by_sum") - F.col("exact")), F.abs(F.col("by_union") - F.col("exact"))
    return found.agg(
        F.avg(es).alias("mae_sum"), F.avg(eu).alias("mae_union"), F.sqrt(F.avg(es * es)).alias("rmse_sum"), F.sqrt(F.avg(eu * eu)).alias("rmse_union"),
        F.coalesce(F.stddev_samp(es), F.lit(0.0)).alias("std_sum"), F.coalesce(F.stddev_samp(eu), F.lit(0.0)).alias("std_union"),
        F.sum((es < eu).cast("bigint")).alias("sum_wins"), F.sum((eu < es).cast("bigint")).alias("union_wins"),
    )
