"""Ordered sums, modularity of every move, and sketches over a stream, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from metaweave.operators import louvain as L
from metaweave.operators import ordered as O
from metaweave.streaming import replay, sketches


def test_running_sums_and_next_values_across_ranges(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 2, rng.randint(-9, 9), 1) for i in range(900)]
    frame = spark.createDataFrame(rows, "key string, at bigint, x bigint, one bigint").repartition(9)
    got = {r.at: r for r in O.running_sums(frame, ["key"], "at", {"sum": "x", "place": "one"}).collect()}
    nxt = {r.at: r.after for r in O.next_values(frame, ["key"], "at", "after").collect()}
    sums, place, last = {}, {}, {}
    for key, at, x, _ in rows:
        sums[key], place[key] = sums.get(key, 0) + x, place.get(key, 0) + 1
        assert (got[at].sum, got[at].place) == (sums[key], place[key])
        if key in last:
            assert nxt[last[key]] == at
        last[key] = at
    assert all(nxt[at] is None for at in last.values())
    alone = sorted((r.at, r.sum) for r in O.running_sums(frame, [], "at", {"sum": "x"}).collect())
    assert [s for _, s in alone] == [sum(x for *_, x, _ in rows[: i + 1]) for i in range(len(rows))]
    assert O.running_sums(frame.limit(0), ["key"], "at", {"sum": "x"}).count() == 0


@pytest.mark.parametrize("resolution", [1.0, 0.6])
def test_modularity_of_every_move(spark, resolution):
    rng = random.Random(11)
    edges = [(u, v, float(rng.randint(1, 4))) for u in range(9) for v in range(u, 9) if rng.random() < 0.5]
    canon = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    log = [(i + 1, 0, rng.choice([*range(9), 99]), rng.choice([0, 1, 2, 8, 50])) for i in range(80)]
    log += [(5, 1, 3, 7)]  # of another level
    moves = spark.createDataFrame(log, "move int, level int, node bigint, to_comm bigint").repartition(5)
    got = sorted((r.step, r.modularity) for r in replay.modularity_every(moves, canon, resolution=resolution).collect())
    nodes = sorted({n for e in edges for n in e[:2]})
    comm = {n: n for n in nodes}
    want = []
    for step in range(81):
        if step and log[step - 1][2] in comm:
            comm[log[step - 1][2]] = log[step - 1][3]
        m2 = 2 * sum(w for *_, w in edges)
        k = {n: sum(w * (u == n) + w * (v == n) for u, v, w in edges) for n in nodes}
        tot = {c: sum(k[n] for n in nodes if comm[n] == c) for c in comm.values()}
        want.append(sum(2 * w for u, v, w in edges if comm[u] == comm[v]) / m2 - resolution * sum(t * t for t in tot.values()) / m2**2)
    assert [s for s, _ in got] == list(range(81))
    assert [q for _, q in got] == pytest.approx(want, abs=1e-9)
    last = spark.createDataFrame(list(comm.items()), "node bigint, comm bigint")
    assert got[-1][1] == pytest.approx(L.modularity(canon, last, resolution).first()[0], abs=1e-9)


def test_modularity_of_an_empty_log(spark):
    canon = spark.createDataFrame([(0, 1, 1.0)], "u bigint, v bigint, w double")
    moves = spark.createDataFrame([], "move int, level int, node bigint, to_comm bigint")
    assert [tuple(r) for r in replay.modularity_every(moves, canon).collect()] == [(0, pytest.approx(-0.5))]


def test_streamed_sketches_survive_any_split_repeats_and_a_restart(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"n{min(9, int(rng.expovariate(0.4)))}", i % 2, rng.randint(0, 500)) for i in range(1200)]
    rows += [(None, 0, 5), ("n1", None, 5), ("n1", 0, None), ("alone", 0, 3)]
    shape = "node string, layer int, hash bigint"
    want = {}
    for node, layer, h in rows:
        if None not in (node, layer, h):
            want.setdefault((node, layer), set()).add(h)
    want = {key: sorted(hs)[:16] for key, hs in want.items()}
    read = lambda df: {(r.node, r.layer): list(r.hashes) for r in df.collect()}
    assert read(sketches.streamed_sketches(spark, spark.createDataFrame(rows, shape), 16, batches=3)) == want
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    follow = lambda: sketches.follow_folder(spark, folder, spark.createDataFrame([], shape).schema, lambda s: s, 16, out, state, files=2)
    half = spark.createDataFrame(rows[:500], shape)
    half.repartition(3).write.parquet(folder)
    first = read(follow())
    assert first.keys() <= want.keys() and first != want
    spark.createDataFrame(rows[400:], shape).repartition(2).write.mode("append").parquet(folder)  # a hundred rows come again
    assert read(follow()) == want
    assert read(follow()) == want  # nothing new


def test_spans(spark, rows):
    moves = spark.createDataFrame([(3, 0, 1, 7), (5, 0, 1, 1), (4, 0, 9, 7)], "move int, level int, node bigint, to_comm bigint")
    nodes = spark.createDataFrame([(1,), (2,)], "node bigint")
    got = replay.spans(moves, nodes).orderBy("node", "start").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 3), (1, 7, 3, 5), (1, 1, 5, None), (2, 2, 0, None)]
    assert rows(replay.spans(moves.where(F.lit(False)), nodes), "node", "start") == [(1, 0), (2, 0)]
