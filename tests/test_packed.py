import random

import numpy as np
import pytest

from metaweave.model import LouvainSettings
from metaweave.operators import louvain as L
from metaweave.operators import packed as P

SETTINGS = [LouvainSettings(), LouvainSettings(exclude_self=True), LouvainSettings(require_improvement=True, max_community_size=6), LouvainSettings(exclude_self=True, resolution=1.5)]


def drawn(spark, n=40, m=160, seed=3):
    draw = random.Random(seed)
    made = {(min(a, b), max(a, b)) for a, b in ((draw.randrange(n), draw.randrange(n)) for _ in range(m))}  # some loops
    return spark.createDataFrame([(u, v, 1.0 + (u * v) % 4) for u, v in sorted(made)], "u bigint, v bigint, w double")


@pytest.mark.parametrize("setting", SETTINGS)
def test_passes_over_lists_propose_what_joins_propose(spark, monkeypatch, setting):
    canon = drawn(spark)
    state = L.degrees(canon).selectExpr("node", "k", "node % 7 AS comm")
    m2 = state.agg({"k": "sum"}).first()[0]
    loops = canon.where("u = v").selectExpr("u AS node", "w AS loop")
    want = L.proposals(state, L.community_weights(L.adjacency(canon), state.select("node", "comm")), m2, setting, loops)
    want = sorted((r.node, r.old, r.new, round(r.delta, 12)) for r in want.collect())
    for block in (1 << 22, 50):
        monkeypatch.setattr(P, "BLOCK", block)
        found = P.proposals(P.packed(canon), state, m2, setting)
        assert sorted((r.node, r.old, r.new, round(r.delta, 12)) for r in found.collect()) == want and want


def test_weights_by_cells_and_by_sorted_keys(spark, monkeypatch):
    graph = P.packed(drawn(spark, seed=9))
    comm = np.arange(len(graph.names)) % 5
    for batch in graph.blocks.toArrow().to_batches():
        for low, degrees, others, w in P.lists(batch):
            dense = [x.tolist() for x in P.weights_of(low, degrees, others, w, comm)]
            monkeypatch.setattr(P, "DENSE", 0)
            assert [x.tolist() for x in P.weights_of(low, degrees, others, w, comm)] == dense


@pytest.mark.parametrize("setting", SETTINGS)
def test_streamed_moves_are_the_exact_ones(spark, rows, monkeypatch, setting):
    monkeypatch.setattr(P, "BLOCK", 50)
    canon = drawn(spark)
    moved = rows(L.streamed_moves(canon, setting))
    assert moved == sorted(L.move_all([tuple(r) for r in canon.collect()], setting).items())


def test_a_component_beyond_the_exact_limit_is_moved_whole(spark, rows):
    canon = drawn(spark)
    want = rows(L.louvain(canon, LouvainSettings(), "exact").levels)
    assert rows(L.louvain(canon, LouvainSettings(exact_limit=20), "streamed").levels) == want
    assert rows(L.louvain(canon.where("u < 0"), LouvainSettings(), "streamed").levels) == []
