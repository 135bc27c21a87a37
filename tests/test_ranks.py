"""Exact order statistics, and what is built on them, against sorting."""

import random

import numpy as np
import pytest

from metaweave.operators import accuracy as X
from metaweave.operators import weights
from metaweave.operators.ranks import at_places, interpolated
from metaweave.streaming import replay

CASES = {
    "uniform": [random.Random(1).random() for _ in range(5000)],
    "ties": [float(random.Random(2).choice([0, 1, 1, 1, 7])) for _ in range(50)] + [3.0] * 4000,
    "wide": [random.Random(3).choice([1e-300, -1e300, 5.0, 1e300]) * random.Random(i).random() for i in range(3000)],
    "close": [1.0 + i * 2**-52 for i in range(700)],
    "ends": [float("-inf"), -1.0, 0.0, 2.0, float("inf"), float("inf")],
    "one": [4.5],
}


@pytest.mark.parametrize("name", CASES)
def test_places_are_exact(spark, name):
    values = CASES[name]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(4)
    n = len(values)
    places = sorted({0, n // 7, n // 2, n - 1, max(0, n - 2)})
    assert at_places(frame, "x", [*places, n, n + 5]) == {p: sorted(values)[p] for p in places}


def test_percentiles_and_empty_columns(spark):
    values = CASES["uniform"][:777]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    points = [0.0, 0.25, 0.5, 0.99, 1.0]
    assert interpolated(frame, "x", points) == pytest.approx(np.percentile(values, [100 * p for p in points]).tolist(), abs=1e-12)
    assert interpolated(frame.limit(0), "x", points) == [None] * 5 and at_places(frame.limit(0), "x", [0]) == {}
    got = weights.statistics(frame.limit(0).withColumnRenamed("x", "weight")).first()
    assert got["count"] == 0 and got["p50"] is None
    assert X.place_median(frame.limit(0), "x").first()["median"] is None


def test_distances_by_group_and_whole(spark):
    rng = np.random.default_rng(5)
    rows = [(["g", "h"][int(i % 3 == 0)], i, float(rng.integers(0, 9)), float(rng.integers(0, 9))) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, idx int, a double, b double")

    def plain(part):
        a, b = np.array([r[2] for r in part]), np.array([r[3] for r in part])
        p, q = a - a.min() + 1e-10, b - b.min() + 1e-10
        p, q = p / p.sum(), q / q.sum()
        return float(np.abs(np.cumsum(p) - np.cumsum(q)).sum()), float((p * np.log(p / q)).sum())

    got = {r.g: (r.wasserstein, r.kl) for r in X.distances(frame, ("g",)).collect()}
    assert got == {g: pytest.approx(plain([r for r in rows if r[0] == g]), rel=1e-6) for g in "gh"}
    whole = X.distances(frame.drop("g")).first()
    assert (whole.wasserstein, whole.kl) == pytest.approx(plain(rows), rel=1e-6)


def test_count_min_by_vectors_is_that_of_all_pairs(spark):
    rng = random.Random(8)
    edges = spark.createDataFrame([(rng.randint(0, 9), rng.randint(100, 160)) for _ in range(150)], "src int, dst int")
    a = spark.createDataFrame([(s % 3, s) for s in range(12)] + [(0, 1), (9, 500)], "set int, node int")
    b = spark.createDataFrame([(i % 4, i) for i in range(95, 170)] + [(2, 100)], "set int, node int")
    for depth, width in ((1, 4), (3, 16), (4, 256)):
        counters = {(r.node, r.row, r.bucket): r.n for r in X.cms_build(edges, depth, width).collect()}
        buckets = {r.item: [x.bucket for x in r.p] for r in b.select(b.node.alias("item")).distinct().select("item", X.cms_buckets("item", depth, width).alias("p")).collect()}
        want = {}
        for s, node in (tuple(r) for r in a.collect()):
            for t, item in (tuple(r) for r in b.collect()):
                low = min(counters.get((node, i, x), 0) for i, x in enumerate(buckets[item]))
                want[s, t] = want.get((s, t), 0) + (low if node in range(10) else 0)
        assert {(r.a, r.b): r.estimate for r in X.cms_edges_single(edges, a, b, depth, width).collect()} == want


def test_padded_runs_hold_their_last_value(spark, rows):
    runs = spark.createDataFrame([("a", 0, 0.1), ("a", 2, 0.3), ("b", 1, 0.5), ("b", 4, 0.6)], "run string, step int, modularity double")
    got = {(r.run, r.step): r.modularity for r in replay.padded(runs).collect()}
    assert got == {("a", 0): 0.1, ("a", 1): 0.1, ("a", 2): 0.3, ("a", 3): 0.3, ("a", 4): 0.3, ("b", 0): None, ("b", 1): 0.5, ("b", 2): 0.5, ("b", 3): 0.5, ("b", 4): 0.6}
