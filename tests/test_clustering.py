import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaweave.functions import arrays as A
from metaweave.model import LouvainSettings, SketchSettings
from metaweave.operators import compare as C
from metaweave.operators import hierarchy as H
from metaweave.operators import layout as G
from metaweave.operators import louvain as L
from metaweave.operators import scar
from metaweave.operators import sketch as S
from metaweave.operators.components import star_components
from metaweave.sources import generate as R

TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src bigint, dst bigint, weight double")


def split(spark, comms):
    return spark.createDataFrame(list(enumerate(comms)), "node bigint, comm bigint")


def test_components(spark, rows):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    df = spark.createDataFrame(chain, "u bigint, v bigint")
    found = dict(rows(star_components(df)))
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)}
    assert star_components(df.where("u < 0")).count() == 0
    ring = spark.createDataFrame([(str(i), str((i * 7 + 3) % 50)) for i in range(50)] + [(None, "x")], "u string, v string")
    parent = {str(i): str(i) for i in range(50)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(50):
        a, b = root(str(i)), root(str((i * 7 + 3) % 50))
        parent[max(a, b)] = min(a, b)
    found = dict(rows(star_components(ring)))
    assert all(found[x] == root(x) for x in found)


def test_two_triangles(spark, rows):
    canon = L.canonical(edges(spark, TRIANGLES))
    halves = split(spark, [0, 0, 0, 3, 3, 3])
    q = L.modularity(canon, halves).first()[0]
    assert math.isclose(q, 6 / 7 - 1 / 2)
    small = L.aggregate(canon, halves)
    assert rows(small) == [(0, 0, 3.0), (0, 3, 1.0), (3, 3, 3.0)]
    alone = L.singletons(small)
    assert math.isclose(L.modularity(small, alone).first()[0], q)
    for mode in ("exact", "distributed"):
        found = L.louvain(edges(spark, TRIANGLES), LouvainSettings(exclude_self=True), mode)
        assert rows(found.levels.where("level = 1"), "node", "comm") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)]
    assert H.inconsistencies(found.levels, found.parents).count() == 0


def test_reference_formula_and_options(spark):
    canon = L.canonical(edges(spark, TRIANGLES))
    rows_ = [tuple(r) for r in canon.collect()]
    for setting in (LouvainSettings(), LouvainSettings(min_gain=-100.0, max_iterations=3), LouvainSettings(require_improvement=True, max_community_size=2)):
        comm = L.move_all(rows_, setting)
        assert set(comm) == set(range(6))
    sizes = list(L.move_all(rows_, LouvainSettings(exclude_self=True, max_community_size=2)).values())
    assert max(sizes.count(c) for c in sizes) <= 2


def test_planted_partition(spark):
    e = R.planted_partition(spark, 200, 4, 0.4, 0.01)
    truth = R.block_of(spark, 200, 4)
    found = L.louvain(e, LouvainSettings(exclude_self=True), "exact")
    assert C.nmi(found.final(), truth).first()[0] > 0.8


def test_scar_matches_blocks(spark):
    e = R.both_directions(R.planted_partition(spark, 60, 3, 0.8, 0.01))
    nodes = spark.range(60).select("id", F.lit("x").alias("type"))
    found = scar.scar(nodes, e, ["x", "x"], SketchSettings(k=128, nk=1, louvain=LouvainSettings(exclude_self=True, max_iterations=6, max_levels=2)))
    assert C.nmi(found.final(), R.block_of(spark, 60, 3)).first()[0] > 0.7


def test_bottom_k(spark):
    row = spark.range(1).select(
        A.merge(F.array(F.lit(1), F.lit(3), F.lit(5)), F.array(F.lit(2), F.lit(3), F.lit(9)), 4).alias("m"),
        A.cardinality(F.array(F.array(F.lit(1), F.lit(3))), 4).alias("small"),
        A.cardinality(F.array(F.array(F.lit(1), F.lit(3), F.lit(4), F.lit(10))), 4).alias("large"),
        A.without(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(2)), 2).alias("w"),
        A.common_layers(F.array(F.array(F.lit(1), F.lit(2))), F.array(F.array(F.lit(2), F.lit(3)))).alias("c"),
        A.merge_layers(F.array(F.array(F.lit(1))), F.array(F.array(F.lit(1)), F.array(F.lit(2))), 2).alias("none"),
        A.cardinality_one(F.array(F.lit(1)), 1).alias("inf"),
    ).first()
    assert row.m == [1, 2, 3, 5] and row.small == 2 and math.isclose(row.large, 3 * A.MAX_HASH / 10)
    assert row.w == [1, 3] and row.c == 1 and row.none is None and row.inf == math.inf


def test_sketches_are_exact_while_not_full(spark, rows):
    pairs = [(0, 100), (1, 100), (2, 100), (2, 101), (3, 101), (4, 102)]
    e = edges(spark, pairs)
    nodes = spark.createDataFrame([(i, "a") for i in range(5)] + [(i, "b") for i in (100, 101, 102)], "id bigint, type string")
    found, own = S.sketch_graph(nodes, e, ["a", "b", "a"], 8)
    assert {r.node for r in found.collect()} == {0, 1, 2, 3}  # 4 reaches itself only
    want = {(0, 1), (0, 2), (1, 2), (2, 3)}
    assert {(a, b) for a, b in rows(S.adjacency(found, own, 8)) if a < b} == want
    assert dict(rows(S.degrees(found, own, 8))) == {0: 2.0, 1: 2.0, 2: 3.0, 3: 1.0}
    assert rows(S.unique_edges(S.leaf_adjacency(found, own))) == sorted(want)


def test_nmi_and_rand(spark):
    a, b = split(spark, [0, 0, 1, 1]), split(spark, [0, 1, 0, 1])
    assert C.nmi(a, a).first()[0] == 1.0 and abs(C.nmi(a, b).first()[0]) < 1e-12
    assert C.nmi(split(spark, [0, 0]), split(spark, [1, 1])).first()[0] == 1.0
    assert C.nmi(split(spark, [0, 0, 0, 0]), a).first()[0] == 0.0
    assert C.rand_index(a, split(spark, [0, 0, 0, 1])).first()[0] == 0.5
    assert C.rand_index(split(spark, [0]), split(spark, [0])).first()[0] == 1.0
    assert C.rescaled_rand(a, a).first()[0] == 1.0 and C.adjusted_rand(a, a).first()[0] == 1.0
    assert C.nmi(a, a.where("node > 9")).first()[0] is None


def test_cophenetic_against_pairs(spark):
    rng = np.random.default_rng(3)
    fine = rng.integers(0, 8, 40)
    other = rng.integers(0, 8, 40)
    levels = lambda x: spark.createDataFrame([(l + 1, i, int(v >> l)) for l in range(4) for i, v in enumerate(x)], "level int, node bigint, comm bigint")
    merge = lambda x, i, j: next(l + 1 for l in range(4) if x[i] >> l == x[j] >> l)
    pairs = [(merge(fine, i, j), merge(other, i, j)) for i in range(40) for j in range(i)]
    want = np.corrcoef(np.array(pairs).T)[0, 1]
    assert math.isclose(C.cophenetic(levels(fine), levels(other)).first()[0], want, abs_tol=1e-9)


def test_layout(spark, rows):
    line = edges(spark, [(0, 1), (1, 2), (2, 3)])
    hops = {(a, b): h for a, b, h in rows(G.hop_distances(line))}
    assert hops[0, 3] == 3 and hops[1, 1] == 0
    at = {i: x for i, x, _ in rows(G.mds(G.hop_distances(line)))}
    assert abs(abs(at[0] - at[3]) - 3) < 1e-9
    assert G.stress(G.hop_distances(line), G.mds(G.hop_distances(line))).first()[0] < 1e-12
    ranks = dict(rows(G.pagerank(line)))
    assert math.isclose(sum(ranks.values()), 1, abs_tol=1e-4) and ranks[1] > ranks[0] and math.isclose(ranks[0], ranks[3], abs_tol=1e-6)
    two = edges(spark, [(0, 1), (2, 3)])
    assert {h for a, b, h in rows(G.hop_distances(two)) if {a, b} == {0, 2}} == {10}
    assert G.scale(np.zeros((1, 1))).tolist() == [[0.0, 0.0]]
    with pytest.raises(ValueError):
        G.scale(np.zeros((3, 3)))


def test_root_and_paths(spark, rows):
    assign = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 2), (2, 0, 5), (2, 1, 5), (2, 2, 6)], "level int, node bigint, comm bigint")
    assert rows(H.with_root(assign, "-1").where("level = 3"), "node", "comm") == [(0, -1), (1, -1), (2, -1)]
    assert H.with_root(assign.where("level = 1 AND node < 2")).count() == 2
    assert dict((n, p) for n, p in rows(H.paths(assign))) == {0: [0, 5], 1: [0, 5], 2: [2, 6]}
    assert rows(G.drill_down(assign), "level", "comm") == [(1, 0), (2, 5)]
    assert G.path_metrics(G.alternative_paths(assign)).count() == 4


def test_registered_pagerank_takes_all_ties(spark):
    from metaweave.plans import queries
    from metaweave.sources import tables

    sf = "/root/testdata/sf0.01"
    ties = {frozenset((r.u, r.v)) for r in tables.supplier_ties(spark, sf).collect()}
    near = {}
    for u, v in map(tuple, ties):
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    rank = {x: 1 / len(near) for x in near}
    for _ in range(100):
        rank = {x: 0.15 / len(near) + 0.85 * sum(rank[y] / len(near[y]) for y in near[x]) for x in near}
    got = {r.id: r["rank"] for r in queries.g1_pagerank(spark, sf).collect()}
    assert got.keys() == rank.keys() and all(abs(got[x] - rank[x]) < 1e-5 for x in rank)
