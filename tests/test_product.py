"""Products by blocks of starts: the same sums as a join and a group by, walks aren't shuffled."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from metaweave.model import Graph, LouvainSettings, MetaPath, Traversal
from metaweave.operators import layout as G
from metaweave.operators import louvain as L
from metaweave.operators import metapath as M
from metaweave.operators import product as P
from metaweave.sources import tables as T


def _rows(n, starts, middles, seed):
    draw = random.Random(seed)
    return sorted({(draw.randrange(starts), draw.randrange(middles)) for _ in range(n)})


@pytest.mark.parametrize("heavy", [8, 0])
def test_products_as_by_a_join(spark, rows, monkeypatch, heavy):
    monkeypatch.setattr(P, "LEAST", 50)
    monkeypatch.setattr(P, "HEAVY", heavy)
    monkeypatch.setattr(P, "BLOCK", 120)
    held = _rows(600, 30, 40, 1)
    text = lambda df, c: df.withColumn(c, F.col(c).cast("string"))
    left = spark.createDataFrame([(a, m, 1 + a % 3) for a, m in held] + [(None, 3, 5), (1, None, 5)], "a bigint, m bigint, x bigint")
    right = spark.createDataFrame([(m, b, 2 + b % 2) for b, m in held] + [(3, None, 7), (None, 1, 5)], "m bigint, b bigint, y bigint")
    aggregates = [F.sum(F.col("x") * F.col("y")).alias("s"), F.max(F.col("x") + F.col("y")).alias("h")]
    key = lambda r: [(v is None, v) for v in r]
    got = sorted((tuple(r) for r in P.product(left, right, "m", ["a"], "b", aggregates).collect()), key=key)
    assert got == sorted((tuple(r) for r in P.plain(left, right, "m", ["a"], "b", aggregates).collect()), key=key)
    named = text(left, "a"), text(right, "b")  # strings are grouped by numbers
    assert sorted((tuple(r) for r in P.product(*named, "m", ["a"], "b", aggregates).collect()), key=key) == sorted((tuple(r) for r in P.plain(*named, "m", ["a"], "b", aggregates).collect()), key=key)
    apart = F.col("a") != F.col("b")
    assert rows(P.product(left, right, "m", ["a"], "b", aggregates, apart)) == rows(P.plain(left, right, "m", ["a"], "b", aggregates, apart))


def test_walks_are_not_shuffled(spark):
    """300 starts share a part: 90,000 walks of 300 rows; no exchange follows the lists."""
    left = spark.range(300).select(F.col("id").alias("a"), F.lit(1).alias("m"))
    found = P.product(left, left.withColumnRenamed("a", "b"), "m", ["a"], "b", [F.count(F.lit(1)).alias("n")])
    assert found.count() == 90_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")


def test_ties_and_meta_paths_of_copies(spark, rows, tmp_path):
    """Copies of a graph under shifted keys keep the results of each copy."""
    held = _rows(300, 12, 25, 2)
    lines = [(s + 100 * i, p + 1000 * i, 1.0 + (s + p) % 4) for i in range(3) for s, p in held]
    spark.createDataFrame(lines, "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(sorted({(s,) for s, _, _ in lines}), "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(sorted({(p,) for _, p, _ in lines}), "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    parts: dict = {}
    for s, p, _ in lines:
        parts.setdefault(p, []).append(s)
    ties = Counter((a, b) for held in parts.values() for a in held for b in held)
    assert rows(T.supplier_ties(spark, str(tmp_path))) == sorted((a, b, float(n)) for (a, b), n in ties.items() if a < b)
    graph = T.supply_graph(spark, str(tmp_path))
    walks, loops = sum(ties.values()), sum(n for (a, b), n in ties.items() if a == b)
    assert rows(M.traversal_counts(graph, T.SPS)) == [(36, walks, walks - loops, loops)]
    assert M.materialise(graph, T.SPS, keep=True).nodes.where("degree > 0").count() == 36


@pytest.mark.parametrize("cycles", [True, False])
def test_instances_are_counted_without_the_last_hop(spark, cycles):
    draw = random.Random(3)
    kinds = {f"{k}{i}": k for k in "AB" for i in range(6)}
    made = [(draw.choice(list(kinds)), draw.choice(list(kinds)), "x", 1.0) for _ in range(90)]
    graph = Graph(spark.createDataFrame(list(kinds.items()), "id string, type string"), spark.createDataFrame(made, "src string, dst string, etype string, weight double"))
    for path in ("AB", "ABA", "AAA", "ABAB", "ABBAA"):
        wanted = M.instances(graph, MetaPath(tuple(path), ("x",) * (len(path) - 1)), Traversal(allow_cycles=cycles)).count()
        assert M.instance_count(graph, MetaPath(tuple(path), ("x",) * (len(path) - 1)), Traversal(allow_cycles=cycles)).first()[0] == wanted


def test_exact_moves_by_components(spark):
    """Three components moved apart end where one sequential run ends, level by level."""
    draw = random.Random(5)
    made = sorted({(min(a, b) + 100 * c, max(a, b) + 100 * c) for c in range(3) for a, b in ((draw.randrange(24), draw.randrange(24)) for _ in range(90)) if a != b})
    canon = spark.createDataFrame([(u, v, 1.0 + (u + v) % 3) for u, v in made], "u bigint, v bigint, w double")
    whole = sorted(map(tuple, L.louvain(canon, LouvainSettings(), "exact").levels.collect()))
    assert sorted(map(tuple, L.louvain(canon, LouvainSettings(exact_limit=100), "exact").levels.collect())) == whole
    with pytest.raises(ValueError, match="at most 20"):
        L.louvain(canon, LouvainSettings(exact_limit=20), "exact")


def test_hop_distances_of_any_number_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(G, "MDS_LIMIT", 3)
    edges = spark.createDataFrame([(0, i) for i in range(1, 67)] + [(100, 101)], "src bigint, dst bigint")
    found = {(r.src, r.dst): r.hops for r in G.hop_distances(edges, unreachable=99).collect()}
    near = lambda a, b: 0 if a == b else 99 if (a < 100) != (b < 100) else 1 if 0 in (a, b) or a >= 100 else 2
    ids = [*range(67), 100, 101]
    assert found == {(a, b): near(a, b) for a in ids for b in ids}
    with pytest.raises(ValueError, match="at most 3"):
        G.coordinates(edges)
