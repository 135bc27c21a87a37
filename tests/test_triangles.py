"""Triangles of communities, without a shuffle of the wedges."""

import random
from collections import Counter
from itertools import combinations

import pytest

from metaweave.operators import compare as C
from metaweave.operators import product as P
from metaweave.operators import triangles as X


def test_triangles_of_communities(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST", 50)
    monkeypatch.setattr(P, "BLOCK", 200)
    draw = random.Random(5)
    held = {(a, b) for a, b in combinations(range(60), 2) if draw.random() < 0.5}
    edges = spark.createDataFrame(sorted(held), "src bigint, dst bigint")
    assign = spark.createDataFrame([(i, i % 3) for i in range(60)], "node bigint, comm bigint")
    got = {r["comm"]: (r["edges"], r["clustering"]) for r in C.subgraph_statistics(edges, assign).collect()}
    for comm in range(3):
        own = [i for i in range(60) if i % 3 == comm]
        inner = {(a, b) for a, b in held if a in own and b in own}
        degree = Counter(x for e in inner for x in e)
        triangles = sum((a, b) in inner and (b, c) in inner and (a, c) in inner for a, b, c in combinations(own, 3))
        wedges = sum(d * (d - 1) / 2 for d in degree.values())
        assert got[comm] == (len(inner), pytest.approx(3 * triangles / wedges))


def test_wedges_are_not_shuffled(spark, monkeypatch):
    """A complete community: its wedges outnumber its edges, and no join makes rows of them."""
    joined = []
    monkeypatch.setattr(C, "product", lambda *a: joined.append(a) or P.product(*a))
    edges = spark.createDataFrame(list(combinations(range(40), 2)), "src bigint, dst bigint")
    assign = spark.createDataFrame([(i, 0) for i in range(40)], "node bigint, comm bigint")
    assert C.subgraph_statistics(edges, assign).first()["clustering"] == 1.0 and len(joined) == 1


def test_dense_communities_are_multiplied_in_blocks(spark, monkeypatch):
    """No wedge of them is listed, and blocks of any size count each triangle once."""
    left = []
    monkeypatch.setattr(C, "product", lambda *a: left.append(a[0].count()) or P.product(*a))
    monkeypatch.setattr(X, "ROWS", 16)
    monkeypatch.setattr(X, "COLUMNS", 24)
    draw = random.Random(7)
    held = [(a, b) for a, b in combinations(range(100), 2) if a % 2 == b % 2 and draw.random() < 0.4]
    edges = spark.createDataFrame([(b, a) if draw.random() < 0.5 else (a, b) for a, b in held + held[:50]], "src bigint, dst bigint")
    got = {r["comm"]: r["clustering"] for r in C.subgraph_statistics(edges, spark.createDataFrame([(i, i % 2) for i in range(110)], "node bigint, comm bigint")).collect()}
    near = set(held)
    for comm in range(2):
        own = [i for i in range(100) if i % 2 == comm]
        triangles = sum((a, b) in near and (b, c) in near and (a, c) in near for a, b, c in combinations(own, 3))
        degree = Counter(x for e in near if e[0] % 2 == comm for x in e)
        assert got[comm] == pytest.approx(3 * triangles / sum(d * (d - 1) / 2 for d in degree.values()))
    assert left == [0]
