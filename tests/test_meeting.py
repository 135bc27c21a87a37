import random
from collections import defaultdict

import pytest

from metaweave.model import Aggregation
from metaweave.operators import metapath as M
from metaweave.operators import totals as T


@pytest.mark.parametrize("strategy", ["count", "sum", "average", "maximum", "minimum"])
@pytest.mark.parametrize("once", [False, True])
def test_meetings_are_added_up_without_rows_of_walks(spark, rows, monkeypatch, strategy, once):
    monkeypatch.setattr(T, "FEW", 0)
    monkeypatch.setattr(T, "BLOCK", 64)
    monkeypatch.setattr(T, "LEAST", 16)
    monkeypatch.setattr(M, "product", None)  # walks as rows, with lists of structs
    draw = random.Random(4)
    ends = [(f"s{s}", f"m{m}", draw.randrange(1, 4), draw.randrange(1, 90) / 8, draw.randrange(30, 60) / 4, draw.randrange(1, 30) / 4) for s in range(25) for m in range(12) if draw.random() < 0.5]
    want = defaultdict(float)
    for s, m, n1, t1, h1, l1 in ends:
        for d, o, n2, t2, h2, l2 in ends:
            if m == o and s < d:
                f = {"count": n1 * n2, "sum": t1 * n2 + t2 * n1, "average": (t1 * n2 + t2 * n1) / (2 * n1 * n2), "maximum": max(h1, h2), "minimum": min(l1, l2)}[strategy]
                want[s, d] += f * (1 if once else n1 * n2)
    frame = spark.createDataFrame(ends, "src string, dst string, n bigint, total double, high double, low double")
    found = M.meeting(frame, Aggregation(strategy=strategy, mode="meeting", per_node_pair=once))
    got = {(a, b): w for a, b, w in rows(found)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 * max(1, want[x]) for x in want)
