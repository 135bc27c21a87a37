"""Older rules, degree studies, debugger views and hop distances against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from metaweave.functions import arrays as A
from metaweave.operators import accuracy, degree_study, hierarchy, layout, legacy
from metaweave.operators import louvain as L
from metaweave.operators import sketch as S
from metaweave.streaming import debug, replay

K, SPACE = 6, A.MAX_HASH


def sketched(spark, seed=3, n=40):
    """Sketches of one layer over a random graph, most of them full; one hash a node."""
    rng = random.Random(seed)
    hashes = dict(enumerate(rng.sample(range(1, SPACE), n)))
    near = {i: set() for i in range(n)}
    for i in range(n):
        for j in rng.sample(range(n), rng.choice([1, 2, 5, 9])):
            if i != j:
                near[i].add(j)
                near[j].add(i)
    held = {i: sorted(hashes[j] for j in near[i])[:K] for i in near}
    sketches = spark.createDataFrame([(i, [h]) for i, h in held.items()], "node bigint, layers array<array<bigint>>")
    own = spark.createDataFrame([(i, 0, h) for i, h in hashes.items()], "node bigint, layer int, hash bigint")
    return near, hashes, held, sketches, own


def size(hs):
    return (K - 1) * float(SPACE) / hs[K - 1] if len(hs) >= K else float(len(hs))


def test_legacy_weights_by_all_three_rules(spark):
    _, hashes, held, sketches, own = sketched(spark)
    owner = {h: i for i, h in hashes.items()}
    comm = {i: i % 13 if len(held[i]) >= K else 100 + i % 9 for i in held}
    assign = spark.createDataFrame(list(comm.items()), "node bigint, comm bigint")
    got = {(r.node, r.comm): r.w for r in legacy.community_weights(sketches, own, assign, K).collect()}
    unions = {c: sorted({h for i in held if comm[i] == c for h in held[i]})[:K] for c in comm.values()}
    want, used = {}, set()
    for i in held:
        if len(held[i]) < K:
            for h in held[i]:
                want[i, comm[owner[h]]] = want.get((i, comm[owner[h]]), 0.0) + 1
            continue
        for c in unions:
            if len(unions[c]) >= K:
                if any(comm[owner[h]] == c for h in held[i]):
                    tot = sum(size(held[j]) for j in held if comm[j] == c)
                    want[i, c] = max(0.0, size(held[i]) + tot - size(sorted({*held[i], *unions[c]})[:K]))
                    used.add("united")
            elif w := sum(hashes[i] in held[j] for j in held if comm[j] == c):
                want[i, c] = float(w)
                used.add("members")
    assert used == {"united", "members"}
    assert got == {p: pytest.approx(w, rel=1e-9) for p, w in want.items()}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_degrees_by_edges_without_pairs(spark, seed):
    _, hashes, held, sketches, own = sketched(spark, seed)
    got = {r.node: (r.by_sketch, r.by_edges) for r in degree_study.degrees_by_edges(sketches, own, K).collect()}
    for i, hs in held.items():
        if len(hs) < K:
            assert got[i] == (len(hs), len(hs))
            continue
        ws = [size(hs) + 1 - size(sorted({*hs, hashes[j]})[:K]) for j in held if j != i]
        assert got[i] == (pytest.approx(size(hs)), pytest.approx(sum(w for w in ws if w > 0.1), rel=1e-6))


def test_community_degrees(spark):
    _, _, held, sketches, own = sketched(spark)
    assign = sketches.select("node", (F.col("node") % 15).alias("comm"))
    for r in degree_study.community_degrees(sketches, own, assign, K).collect():
        members = [i for i in held if i % 15 == r.comm]
        united = sorted({h for i in members for h in held[i]})[:K]
        total = sum(size(held[i]) for i in members)
        assert r.by_sum == pytest.approx(total) and r.by_union == pytest.approx(size(united) if len(united) >= K else total)


def test_phases_end_in_one_community(spark):
    nodes = spark.createDataFrame([(g * 10 + i, "a") for g in range(3) for i in range(6)] + [(-1 - g, "b") for g in range(3)], "id bigint, type string")
    edges = spark.createDataFrame([(g * 10 + i, -1 - g) for g in range(3) for i in range(6)], "src bigint, dst bigint")
    found = legacy.phases(nodes, edges, ["a", "b", "a"], k=8, nk=1)
    by = {}
    for r in found.levels.collect():
        by.setdefault(r.level, {})[r.node] = r.comm
    assert set(by[1].values()) == {0, 10, 20} and all(c == n // 10 * 10 for n, c in by[1].items())
    assert set(by[max(by)].values()) == {0} and max(by) <= 3 and all(len(x) == 18 for x in by.values())
    open_end = legacy.phases(nodes, edges, ["a", "b", "a"], k=8, nk=1, forced_root=False)
    assert {r.comm for r in open_end.final().collect()} == {0, 10, 20}


def log_and_graph(spark):
    rng = random.Random(21)
    edges = [(u, v, float(rng.randint(1, 4))) for u in range(12) for v in range(u, 12) if rng.random() < 0.5]
    log = [(i + 1, 0, rng.randrange(14), rng.choice([0, 1, 2, 11, 40])) for i in range(60)]
    return edges, log, spark.createDataFrame(edges, "u bigint, v bigint, w double"), spark.createDataFrame(log, "move int, level int, node bigint, to_comm bigint").repartition(4)


def test_gains_of_each_move_and_totals_in_step(spark):
    edges, log, canon, moves = log_and_graph(spark)
    nodes = {n for e in edges for n in e[:2]}
    degree = {n: sum(w * ((u == n) + (v == n)) for u, v, w in edges) for n in nodes}
    m2 = sum(degree.values())
    comm, want, states = {n: n for n in nodes}, {}, {0: {n: n for n in nodes}}
    for step, _, node, to in log:
        if node in nodes:
            w = sum(x for u, v, x in edges if u != v and node in (u, v) and comm[v if u == node else u] == to)
            tot = sum(degree[n] for n in nodes if comm[n] == to)
            want[step] = (node, to, w, degree[node], tot, w - degree[node] * tot / m2)
            comm[node] = to
        states[step] = dict(comm)
    got = {r.step: (r.node, r.comm, r.w, r.k, r.tot, r.gain) for r in debug.move_gains(moves, canon).collect()}
    assert got.keys() == want.keys() and len(want) < 60
    assert all(got[s] == pytest.approx(want[s], abs=1e-9) for s in want)
    totals = {(s, c): (sum(degree[n] for n in nodes if states[s][n] == c), sum(x == c for x in states[s].values())) for s in (0, 17, 60) for c in set(states[s].values())}
    kept = {(r.step, r.comm): (r.tot, r.members) for r in debug.kept_totals(moves, canon, [0, 17, 60, 17]).collect()}
    assert kept == {k: (pytest.approx(t), n) for k, (t, n) in totals.items()}
    checked = debug.sync_check(moves, canon, [0, 17, 60]).collect()
    assert len(checked) == len(totals) and all(r.in_step for r in checked)
    same = debug.gain_differences(debug.move_gains(moves, canon), debug.move_gains(moves, canon)).collect()
    assert {r.verdict for r in same} == {"same"} and len(same) == len(want)


def test_health_and_differences_of_states(spark):
    a = spark.createDataFrame([(1, n, 0 if n < 60 else n) for n in range(70)] + [(2, n, n) for n in range(70)], "step int, node int, comm int")
    got = {r.step: r for r in debug.health(a).collect()}
    assert (got[1].communities, got[1].largest, got[1].very_small, got[1].large, got[1].giant, got[1].fragmented, got[1].fine_grained) == (11, 60, 10, 1, True, True, False)
    assert got[2].fine_grained and not got[2].giant and got[2].mean_size == 1
    x, y = a.where("step = 1").select("node", "comm"), a.where("step = 2 and node < 69").select("node", "comm")
    assert debug.state_differences(x, y).count() == 60 and debug.state_differences(x, x).count() == 0


def test_hops_over_more_than_one_word_of_sources(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(149) if i not in (70, 120)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(8)]
    near = {i: set() for i in range(150)}
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    want = {}
    for s in near:
        front, hops = {s}, 0
        while front:
            want |= {(s, t): hops for t in front}
            front, hops = {y for x in front for y in near[x] if (s, y) not in want}, hops + 1
    frame = spark.createDataFrame(edges, "src int, dst int")
    got = {(r.src, r.dst): r.hops for r in layout.hop_distances(frame, spark.createDataFrame([(500,)], "id int"), unreachable=-1).collect()}
    assert len(got) == 151**2 and all(h == want.get(p, -1 if p != (500, 500) else 0) for p, h in got.items())


def test_replayed_gains_agree_with_those_of_the_steps(spark):
    edges, log, canon, moves = log_and_graph(spark)
    step, _, node, to = next(m for m in log[30:] if m[2] in {n for e in edges for n in e[:2]})
    ends = L.degrees(canon)
    before = replay.states(moves, ends, [step - 1]).select("node", "comm")
    weights = L.community_weights(L.adjacency(canon.where("u <> v")), before)
    found = L.gains(weights, ends, L.community_totals(canon, before), before, ends.agg(F.sum("k").alias("m2")))
    gain = found.where((F.col("node") == node) & (F.col("comm") == to)).collect()
    mine = debug.move_gains(moves, canon).where(F.col("step") == step).first()
    assert not gain or mine.gain == pytest.approx(gain[0].gain, abs=1e-9)


def test_flattened_hierarchy(spark):
    """Other levels and other nodes don't count; a missing or null community is 0, of several the least holds."""
    held = [(1, 1, 9), (2, 1, 5), (2, 1, 4), (2, 2, None), (2, 7, 3)]
    assign = spark.createDataFrame(held, "level int, node long, comm long")
    leaves = spark.createDataFrame([(1,), (1,), (2,), (3,)], "node long")
    flat = lambda a, n: sorted(map(tuple, hierarchy.flattened(a, n, 2).collect()))
    assert flat(assign, leaves) == [(1, 4), (2, 0), (3, 0)]
    assert flat(assign.limit(0), leaves) == [(1, 0), (2, 0), (3, 0)] and flat(assign, leaves.limit(0)) == []


def test_weight_distances(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 1.0), (2, 5.0), (3, None), (4, 1.0)], "comm long, weight double")
    b = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 2.0), (5, 8.0)], "comm long, weight double")
    got = accuracy.weight_distances(a, b).first()
    assert (got.communities, got.mae) == (2, 1.0) and abs(got.wasserstein) < 1e-6 and abs(got.pearson - 1) < 1e-9
    same = accuracy.weight_distances(b, b).first()
    assert same.mae == 0 and same.wasserstein == 0 and abs(same.cosine - 1) < 1e-12
    none = accuracy.weight_distances(a, b.limit(0)).first()
    assert none.communities == 0 and none.mae is None
