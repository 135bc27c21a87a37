"""Distributed local moving and sketch weights against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from metaweave.functions import arrays as A
from metaweave.model import Graph, LouvainSettings, MetaPath, SketchSettings
from metaweave.operators import louvain as L
from metaweave.operators import scar
from metaweave.operators import sketch as S
from metaweave.plans import registry
from metaweave.sources import generate as R


def quality(edges, comm, resolution=1.0):
    m2 = 2.0 * sum(w for _, _, w in edges)
    inside = sum(2 * w for u, v, w in edges if comm[u] == comm[v])
    tot = {}
    for u, v, w in edges:
        for x in (u, v):
            tot[comm[x]] = tot.get(comm[x], 0.0) + w
    return inside / m2 - resolution * sum(t * t for t in tot.values()) / m2**2


def random_graph(seed, n=24, p=0.3):
    rng = random.Random(seed)
    edges = [(u, v, float(rng.randint(1, 5))) for u in range(n) for v in range(u + 1, n) if rng.random() < p]
    edges += [(u, u, 2.0) for u in range(0, n, 5)]
    return edges + [(u, u + 1, 1.0) for u in range(n - 1) if not any(e[:2] == (u, u + 1) for e in edges)], rng


@pytest.mark.parametrize(("seed", "resolution"), [(1, 1.0), (2, 0.5), (3, 1.7)])
def test_proposals_and_joint_gains_are_exact(spark, seed, resolution):
    edges, rng = random_graph(seed)
    comm = {n: rng.randrange(6) for n in range(24)}
    canon = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    assign = spark.createDataFrame(list(comm.items()), "node bigint, comm bigint")
    state = L.degrees(canon).join(assign, "node")
    loops = canon.where("u = v").select(F.col("u").alias("node"), F.col("w").alias("loop"))
    m2 = 2.0 * sum(w for *_, w in edges)
    setting = LouvainSettings(resolution=resolution, exclude_self=True, min_gain=float("-inf"))
    found = L.proposals(state, L.community_weights(L.adjacency(canon), assign), m2, setting, loops).collect()
    base = quality(edges, comm, resolution)
    for r in found:
        near = {comm[b if a == r.node else a] for a, b, _ in edges if r.node in (a, b)} - {comm[r.node]}
        alone = {c: quality(edges, comm | {r.node: c}, resolution) - base for c in near}
        assert r.delta == pytest.approx(alone[r.new], abs=1e-9) and r.delta == pytest.approx(max(alone.values()), abs=1e-9)
    for n in set(comm) - {r.node for r in found}:  # nothing to gain
        near = {comm[b if a == n else a] for a, b, _ in edges if n in (a, b)} - {comm[n]}
        assert all(quality(edges, comm | {n: c}, resolution) - base < 1e-9 for c in near)
    movers = [(r.node, r.k, r.old, r.new, r.delta, rng.randrange(4)) for r in found]
    frame = spark.createDataFrame(movers, "node bigint, k double, old bigint, new bigint, delta double, slot int")
    gained = dict(L.joint_gains(canon, frame, m2, resolution))
    assert set(gained) == {m[5] for m in movers}
    for slot, change in gained.items():
        after = comm | {m[0]: m[3] for m in movers if m[5] >= slot}
        assert change == pytest.approx(quality(edges, after, resolution) - base, abs=1e-9)


def test_rounds_never_lower_the_modularity_and_reach_the_exact_mode(spark):
    edges = R.planted_partition(spark, 160, 4, 0.4, 0.02)
    canon = spark.createDataFrame(L.canonical(edges).collect(), "u bigint, v bigint, w double")
    setting = LouvainSettings(exclude_self=True)
    trace = []
    moved = L.distributed_moves(canon, setting, trace=trace)
    comm = {r.node: r.comm for r in moved.collect()}
    held = [tuple(r) for r in canon.collect()]
    qs = [q for *_, q in trace]
    assert qs == sorted(qs) and len(qs) > 2 and max(n for _, n, _ in trace) > 20
    assert qs[-1] == pytest.approx(quality(held, comm), abs=1e-9)
    assert all(c == min(n for n in comm if comm[n] == c) for c in comm.values())
    exact, spread = L.louvain(canon, setting, "exact"), L.louvain(canon, setting, "distributed")
    assert spread.summary[-1][2] >= 0.99 * exact.summary[-1][2]


def test_size_limit_and_no_edges(spark):
    edges = [(u, v, 1.0) for u in range(12) for v in range(u + 1, 12)]
    canon = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    moved = L.distributed_moves(canon, LouvainSettings(exclude_self=True, max_community_size=3, resolution=0.2))
    assert max(r["count"] for r in moved.groupBy("comm").count().collect()) <= 3
    assert L.distributed_moves(canon.limit(0), LouvainSettings()).collect() == []


def sketched(spark, groups=5, size=40, k=8, nk=2):
    nodes = [(g * 100 + i, "a") for g in range(groups) for i in range(size)] + [(-1 - g, "b") for g in range(groups)]
    edges = [(g * 100 + i, -1 - g) for g in range(groups) for i in range(size if g else 5)]
    nodes, edges = spark.createDataFrame(nodes, "id bigint, type string"), spark.createDataFrame(edges, "src bigint, dst bigint")
    return nodes, edges, *S.sketch_graph(nodes, edges, ["a", "b", "a"], k, nk)


def test_weights_of_met_communities_are_those_of_the_cross_join(spark):
    _, _, sketches, own = sketched(spark)
    assign = own.select("node", (F.col("node") % 7).alias("comm")).distinct()
    pairs = lambda df: {(r.node, r.comm): r.w for r in df.collect()}
    some = pairs(S.community_weights(sketches, own, assign, 8, 2))
    every = pairs(S.community_weights(sketches, own, assign, 8, 2, every=True))
    layers = {r.node: r.layers for r in sketches.collect()}
    owner = {(r.layer, r.hash): r.node for r in own.collect()}
    full = {n for n, x in layers.items() if len(x[0]) >= 8}
    assert full and set(layers) - full
    want = {(n, owner[i, h] % 7) for n in full for i, layer in enumerate(layers[n]) for h in layer}
    assert {p for p in some if p[0] in full} == want
    assert all(every[p] == w for p, w in some.items()) and {p for p in every if p[0] not in full} == {p for p in some if p[0] not in full}
    assert {p for p in every if p[0] in full} == {(n, c) for n in full for c in range(7)}


def test_a_sketched_graph_holds_the_neighbours_in_the_sketches(spark):
    _, _, sketches, own = sketched(spark)
    owner = {(r.layer, r.hash): r.node for r in own.collect()}
    layers = {r.node: r.layers for r in sketches.collect()}
    got = {(r.src, r.dst): r.weight for r in S.reconstruct(sketches, own, 8, 2).collect()}
    held = {(n, owner[i, h]) for n, x in layers.items() for i, layer in enumerate(x) for h in layer if i == 0 or len(x[0]) >= 8}
    assert set(got) <= held and {p for p in held if len(layers[p[0]][0]) < 8} <= set(got)
    assert all(a // 100 == b // 100 for a, b in got)


def test_clustering_on_full_sketches_finds_the_groups(spark):
    nodes, edges, *_ = sketched(spark)
    said = []
    found = scar.scar(nodes, edges, ["a", "b", "a"], SketchSettings(k=8, louvain=LouvainSettings(exclude_self=True)), progress=lambda *x: said.append(x))
    comm = {r.node: r.comm for r in found.final().collect()}
    big = [n for n in comm if n >= 100]
    assert len({(n // 100, comm[n]) for n in big}) == len({comm[n] for n in big}) == 4  # a community each, none mixed
    assert said


def test_the_distributed_mode_is_reached_by_name(spark):
    nodes = spark.createDataFrame([(f"{k}{i}", k) for k in "ab" for i in range(6)], "id string, type string")
    rows = [(f"a{i}", f"b{j}", "ab", 1.0, "a", "b") for i in range(6) for j in range(6) if i // 3 == j // 3]
    rows += [(b, a, "ba", w, "b", "a") for a, b, _, w, _, _ in rows]
    graph = Graph(nodes, spark.createDataFrame(rows, "src string, dst string, etype string, weight double, src_type string, dst_type string"))
    path = MetaPath(("a", "b", "a"), ("ab", "ba"), "aba")
    got = registry.run("louvain", graph, path, {"mode": "distributed", "exclude_self": True, "exact_limit": 0})
    comm = {r.node: r.comm for r in got.final().collect()}
    assert {frozenset(n for n in comm if comm[n] == c) for c in comm.values()} == {frozenset(("a0", "a1", "a2")), frozenset(("a3", "a4", "a5"))}
    with pytest.raises(ValueError, match="at most 0"):
        registry.run("louvain", graph, path, {"exact_limit": 0})
