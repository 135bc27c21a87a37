"""Hierarchical modularity clustering.

Edges are canonical: ``u <= v, w`` with each undirected edge once; a self loop counts twice
in its node's degree.  Modularity is always computed from the assignment, never updated in
place.  Local moving comes in three modes:

* ``exact``: the whole (small) graph in one grouped task, nodes in ascending order;
* ``streamed``: the same moves in one task that holds the nodes only, for a graph beyond that;
* ``distributed``: synchronous rounds of joins.  Every node proposes its best move; the
  proposals are dealt into nested random sets, each about half of the next, and the exact
  change of modularity of each whole set, with all that its moves do to one another, comes
  from sums per community and per edge between movers.  The best set is applied, so the
  modularity never falls, however many neighbours move at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaweave.model import LouvainSettings
from metaweave.operators import packed as P
from metaweave.operators.components import star_components
from metaweave.plans.scratch import cut, release


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """``u, v, w``: one row an undirected pair, the larger weight of its two directions, w > 0."""
    return (
        edges.where(F.col(weight) > 0)
        .groupBy(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"))
        .agg(F.max(weight).alias("w"))
    )


def adjacency(canon: DataFrame) -> DataFrame:
    """``node, other, w``: both directions, a self loop once."""
    back = canon.where("u <> v").select(F.col("v").alias("node"), F.col("u").alias("other"), "w")
    return canon.select(F.col("u").alias("node"), F.col("v").alias("other"), "w").unionAll(back)


def degrees(canon: DataFrame) -> DataFrame:
    return canon.select(F.explode(F.array("u", "v")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k"))


def singletons(canon: DataFrame) -> DataFrame:
    return degrees(canon).select("node", F.col("node").alias("comm"))


def community_totals(canon: DataFrame, assign: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """``comm, tot, members``; ``degree`` is that of ``canon`` where it is known."""
    return (degrees(canon) if degree is None else degree).join(assign, "node").groupBy("comm").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("members"))


def community_weights(adj: DataFrame, assign: DataFrame) -> DataFrame:
    """``node, comm, w``: the weight from each node to each community next to it."""
    return adj.join(assign.withColumnRenamed("node", "other"), "other").groupBy("node", "comm").agg(F.sum("w").alias("w"))


def modularity(canon: DataFrame, assign: DataFrame, resolution: float = 1.0, degree: DataFrame | None = None) -> DataFrame:
    """One row ``modularity``: sum of in_c / 2m - (tot_c / 2m)^2, 0 without weight; ``degree`` is that of ``canon`` where it is known."""
    a = assign.withColumnsRenamed({"node": "u", "comm": "cu"})
    b = assign.withColumnsRenamed({"node": "v", "comm": "cv"})
    inside = canon.join(a, "u").join(b, "v").agg(
        F.sum(F.when(F.col("cu") == F.col("cv"), 2 * F.col("w")).otherwise(0.0)).alias("inside"), (2 * F.sum("w")).alias("m2")
    )
    squares = community_totals(canon, assign, degree).agg(F.sum(F.col("tot") * F.col("tot")).alias("sq"))
    q = F.col("inside") / F.col("m2") - resolution * F.col("sq") / (F.col("m2") * F.col("m2"))
    return inside.crossJoin(squares).select(F.when(F.col("m2") > 0, q).otherwise(0.0).alias("modularity"))


def gains(weights: DataFrame, degree: DataFrame, totals: DataFrame, assign: DataFrame, m2, setting: LouvainSettings = LouvainSettings(), loops: DataFrame | None = None) -> DataFrame:
    """``node, old, comm, w, gain, members``: w(node, C) - k * tot_C / 2m for each candidate.

    ``exclude_self`` takes the node out of its own community first (textbook); by default its
    own community's total includes it, as the reference does.  ``m2`` is 2m or a one-row frame.
    """
    out = (
        weights.join(degree, "node")
        .join(assign.select("node", F.col("comm").alias("old")), "node")
        .join(totals, "comm")
    )
    if isinstance(m2, DataFrame):
        out = out.crossJoin(F.broadcast(m2))
        m2 = F.col("m2")
    else:
        m2 = F.lit(float(m2))
    own = F.col("comm") == F.col("old")
    tot, w = F.col("tot"), F.col("w")
    if setting.exclude_self:
        tot = F.when(own, tot - F.col("k")).otherwise(tot)
        if loops is not None:
            out = out.join(loops, "node", "left")
            w = F.when(own, w - F.coalesce("loop", F.lit(0.0))).otherwise(w)
    gain = w - setting.resolution * F.col("k") * tot / m2
    return out.select("node", "old", "comm", "w", gain.alias("gain"), "members")


def best_moves(found: DataFrame, setting: LouvainSettings = LouvainSettings()) -> DataFrame:
    """``node, old, comm, gain``: the largest gain, ties to the smallest community; moves only."""
    if setting.max_community_size:
        found = found.where((F.col("comm") == F.col("old")) | (F.col("members") < setting.max_community_size))
    first = W.partitionBy("node").orderBy(F.desc("gain"), "comm")
    ranked = found.withColumn("r", F.row_number().over(first))
    if setting.require_improvement:
        stay = F.max(F.when(F.col("comm") == F.col("old"), F.col("gain"))).over(W.partitionBy("node"))
        ranked = ranked.withColumn("stay", F.coalesce(stay, F.lit(float("-inf")))).where((F.col("r") > 1) | (F.col("gain") > F.col("stay")))
    return ranked.where((F.col("r") == 1) & (F.col("comm") != F.col("old")) & (F.col("gain") > setting.min_gain)).select("node", "old", "comm", "gain")


def aggregate(canon: DataFrame, assign: DataFrame) -> DataFrame:
    """``u, v, w`` among communities; internal edges become self loops, each counted once."""
    a = assign.withColumnsRenamed({"node": "u", "comm": "cu"})
    b = assign.withColumnsRenamed({"node": "v", "comm": "cv"})
    return (
        canon.join(a, "u")
        .join(b, "v")
        .groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v"))
        .agg(F.sum("w").alias("w"))
    )


def move_all(rows: list[tuple], setting: LouvainSettings, whole: float | None = None) -> dict:
    """Sequential local moving of a small graph in ascending node order.

    ``whole`` is 2m where the rows are a component of a larger graph.
    """
    adj: dict = {}
    degree: dict = {}
    loop: dict = {}
    m2 = 0.0
    for u, v, w in rows:
        m2 += 2 * w
        degree[u] = degree.get(u, 0.0) + w
        degree[v] = degree.get(v, 0.0) + w
        if u == v:
            loop[u] = loop.get(u, 0.0) + w
            adj.setdefault(u, []).append((u, w))
        else:
            adj.setdefault(u, []).append((v, w))
            adj.setdefault(v, []).append((u, w))
    m2 = whole or m2
    comm = {n: n for n in adj}
    tot = dict(degree)
    size = dict.fromkeys(adj, 1)
    for _ in range(setting.max_iterations):
        moved = 0
        for node in sorted(adj):
            old, k = comm[node], degree[node]
            near = {old: 0.0}
            for other, w in adj[node]:
                near[comm[other]] = near.get(comm[other], 0.0) + w
            if setting.exclude_self:
                near[old] -= loop.get(node, 0.0)
            best, top, stay = old, None, None
            for c in sorted(near):
                t = tot[c] - (k if setting.exclude_self and c == old else 0.0)
                gain = near[c] - setting.resolution * k * t / m2
                if c == old:
                    stay = gain
                elif setting.max_community_size and size[c] >= setting.max_community_size:
                    continue
                if top is None or gain > top + 1e-12:
                    best, top = c, gain
            if best != old and top > setting.min_gain and not (setting.require_improvement and top <= stay):
                comm[node] = best
                tot[old] -= k
                tot[best] += k
                size[old] -= 1
                size[best] += 1
                moved += 1
        if not moved:
            break
    least: dict = {}
    for n, c in comm.items():
        least[c] = min(least.get(c, n), n)
    return {n: least[c] for n, c in comm.items()}


def exact_moves(canon: DataFrame, setting: LouvainSettings, parts: DataFrame | None = None) -> DataFrame:
    """``node, comm``: the whole graph in one task, or with ``parts`` (``node, component``) each of its
    components; the caller has checked their size.

    A node's gain depends on its neighbours, their communities and 2m alone, and a component that
    a sweep leaves as it is stays so.  So moving the components apart, with the 2m of the whole
    graph, makes the moves of one sequential run.
    """
    kind = dict(canon.dtypes)["u"]
    whole = None if parts is None else canon.agg((2 * F.sum("w")).alias("m2")).first()["m2"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        comm = move_all(list(rows[["u", "v", "w"]].itertuples(index=False, name=None)), setting, whole)
        return pd.DataFrame({"node": list(comm), "comm": list(comm.values())})

    if parts is None:
        return canon.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"node {kind}, comm {kind}")
    # partitions by number: AQE would put components of few bytes into one task
    dealt = with_component(canon, parts).repartition(4 * canon.sparkSession.sparkContext.defaultParallelism, "component")
    return dealt.groupBy("component").applyInPandas(run, f"node {kind}, comm {kind}")


def streamed_moves(canon: DataFrame, setting: LouvainSettings) -> DataFrame:
    """:func:`exact_moves` of a graph of at most ``packed.NODES`` nodes and any number of edges, written."""
    graph = P.packed(canon)
    if graph is None:
        if canon.isEmpty():
            return cut(singletons(canon), "moved")
        raise ValueError(f"more than {P.NODES} nodes; use 'distributed'")
    moved = cut(P.streamed_moves(graph, setting), "moved")
    release(graph.blocks)
    return moved


def with_component(canon: DataFrame, parts: DataFrame) -> DataFrame:
    """``u, v, w, component``; nodes with only a self loop are not in ``parts``."""
    return canon.join(parts.withColumnRenamed("node", "u"), "u", "left").withColumn("component", F.coalesce("component", "u"))


def relabelled(assign: DataFrame) -> DataFrame:
    """Communities named by their smallest member."""
    names = assign.groupBy("comm").agg(F.min("node").alias("name"))
    return assign.join(names, "comm").select("node", F.col("name").alias("comm"))


#: Nested sets of a round: a proposal is in set ``i`` if its slot is at least ``i``.
SLOTS = 40
#: Rounds in a row without a gain worth it after which a level is settled.
STILL = 3


def proposals(state: DataFrame, weights: DataFrame, m2: float, setting: LouvainSettings = LouvainSettings(), loops: DataFrame | None = None) -> DataFrame:
    """``node, k, old, new, delta``: each node's best move, if alone it raises the modularity.

    ``state`` is ``node, k, comm``, ``weights`` is ``node, comm, w`` with self loops in a node's own
    community (``loops`` is ``node, loop``).  The move is chosen by the gain of ``setting``; ``delta``
    is the exact change of modularity.
    """
    totals = state.groupBy("comm").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("members"))
    listed = weights.select("node", "comm", "w").unionByName(state.select("node", "comm", F.lit(0.0).alias("w")))
    listed = listed.groupBy("node", "comm").agg(F.sum("w").alias("w"))
    rows = listed.join(state.select("node", "k", F.col("comm").alias("old")), "node").join(totals, "comm")
    own = F.col("comm") == F.col("old")
    loop = F.lit(0.0)
    if loops is not None:
        rows, loop = rows.join(loops, "node", "left"), F.coalesce("loop", F.lit(0.0))
    share = setting.resolution / m2 * F.col("k")
    exact = F.when(own, F.col("w") - loop - share * (F.col("tot") - F.col("k"))).otherwise(F.col("w") - share * F.col("tot"))
    gain = exact if setting.exclude_self else F.col("w") - share * F.col("tot")
    rows = rows.select("node", "k", "old", "comm", "members", own.alias("own"), exact.alias("exact"), gain.alias("gain"))
    if setting.max_community_size:
        rows = rows.where(F.col("own") | (F.col("members") < setting.max_community_size))
    best = F.min(F.when(~F.col("own"), F.struct((-F.col("gain")).alias("less"), F.col("comm"), F.col("exact"))))
    stay = F.max(F.when(F.col("own"), F.struct("exact", "gain")))
    found = rows.groupBy("node", "k", "old").agg(best.alias("b"), stay.alias("s")).where("b is not null")
    found = found.where((-F.col("b.less") > setting.min_gain) & (F.col("b.exact") - F.col("s.exact") > 1e-12))
    if setting.require_improvement:
        found = found.where(-F.col("b.less") > F.col("s.gain"))
    return found.select("node", "k", "old", F.col("b.comm").alias("new"), ((F.col("b.exact") - F.col("s.exact")) * (2.0 / m2)).alias("delta"))


def joint_gains(canon: DataFrame, movers: DataFrame, m2: float, resolution: float = 1.0) -> list[tuple[int, float]]:
    """``(slot, change)``: the exact change of modularity if all movers (``node, k, old, new, delta,
    slot``) of at least that slot move at once, for each slot that occurs, highest first.

    Two movers count on each other's present place.  So beside the sum of their own changes,
    with ``s`` = [same new] + [same old] - [one's new is the other's old] - [and the reverse], an
    edge between them adds ``2 w s / 2m``, and all pairs take away, for the degrees that join and
    leave each community, ``((joining - leaving)^2 - sum of k^2) / (2m)^2``.
    """
    own = movers.groupBy("slot").agg(F.sum("delta").alias("x"))
    touched = F.explode(F.array(F.struct(F.col("new").alias("comm"), F.col("k").alias("f")), F.struct(F.col("old").alias("comm"), (-F.col("k")).alias("f")))).alias("t")
    flows = movers.select("slot", touched).select("slot", "t.comm", "t.f").groupBy("comm", "slot").agg(F.sum("f").alias("f"), F.sum(F.col("f") * F.col("f")).alias("sq"))
    down = W.partitionBy("comm").orderBy(F.desc("slot"))  # at most SLOTS rows a community
    flows = flows.withColumn("all", F.sum("f").over(down))
    pushed = F.col("all") * F.col("all") - (F.col("all") - F.col("f")) * (F.col("all") - F.col("f")) - F.col("sq")
    crowd = flows.groupBy("slot").agg((F.sum(pushed) * (-resolution / (m2 * m2))).alias("x"))
    a = movers.select(F.col("node").alias("u"), F.col("old").alias("ou"), F.col("new").alias("nu"), F.col("slot").alias("su"))
    b = movers.select(F.col("node").alias("v"), F.col("old").alias("ov"), F.col("new").alias("nv"), F.col("slot").alias("sv"))
    same = lambda x, y: (F.col(x) == F.col(y)).cast("int")
    s = same("nu", "nv") + same("ou", "ov") - same("nu", "ov") - same("ou", "nv")
    met = canon.where("u <> v").join(a, "u").join(b, "v").select(F.least("su", "sv").alias("slot"), (F.col("w") * s).alias("ws")).where("ws <> 0")
    ties = met.groupBy("slot").agg((F.sum("ws") * (2.0 / m2)).alias("x"))
    sums = own.unionByName(crowd).unionByName(ties).groupBy("slot").agg(F.sum("x").alias("x")).collect()  # at most SLOTS rows
    out, total = [], 0.0
    for slot, x in sorted(((r["slot"], r["x"]) for r in sums), reverse=True):
        total += x
        out.append((slot, total))
    return out


def applied(assign: DataFrame, moves: DataFrame) -> DataFrame:
    """``assign`` (with node and comm) after ``moves`` (``node, new``)."""
    others = [c for c in assign.columns if c != "comm"]
    return assign.join(moves.select("node", "new"), "node", "left").select(*others, F.coalesce("new", "comm").alias("comm"))


def _dealt(movers: DataFrame, turn: int, setting: LouvainSettings) -> DataFrame:
    """``slot`` for each proposal: half get 0, a quarter 1 and so on, dealt anew each turn."""
    draw = F.xxhash64(F.col("node"), F.lit(turn), F.lit(setting.seed))
    part = (F.shiftrightunsigned(draw, 11) + 1) / F.lit(float(1 << 53))
    return movers.withColumn("slot", F.least(F.lit(SLOTS - 1), F.floor(-F.log2(part))).cast("int"))


def distributed_moves(
    canon: DataFrame,
    setting: LouvainSettings,
    weigh: Callable[[DataFrame], DataFrame] | None = None,
    degree: DataFrame | None = None,
    trace: list[tuple[int, int, float]] | None = None,
) -> DataFrame:
    """``node, comm`` after synchronous rounds, at most ``2 * max_iterations``.

    ``weigh(assign)`` gives ``node, comm, w``, the exact weights by default; with estimated ones the
    changes are estimates, and the partition of the largest modularity wins.  ``trace`` gets
    ``(turn, moves, modularity)`` of each round.  Tables of a round go when the next has read them.
    """
    adj = adjacency(canon)
    exact = weigh is None
    graph = P.packed(canon) if exact else None
    weigh = weigh or (lambda assign: community_weights(adj, assign))
    state = cut((degree if degree is not None else degrees(canon)).select("node", "k", F.col("node").alias("comm")), "state")
    known = state.select("node", "k") if exact else None
    loops = canon.where("u = v").select(F.col("u").alias("node"), F.col("w").alias("loop"))
    m2 = state.agg(F.sum("k").alias("s")).first()["s"] or 0.0
    if not m2:
        return state.select("node", "comm")

    def quality(a: DataFrame) -> float:
        return modularity(canon, a.select("node", "comm"), setting.resolution, known).first()[0] or 0.0

    q = quality(state)
    best, best_q, still = state, q, 0
    for turn in range(2 * setting.max_iterations):
        if graph:
            found = P.proposals(graph, state, m2, setting)
        else:
            found = proposals(state, weigh(state.select("node", "comm")), m2, setting, loops)
        dealt = cut(_dealt(found, turn, setting), "movers")
        movers = _within_size(dealt, state, setting.max_community_size) if setting.max_community_size else dealt
        gained = joint_gains(canon, movers, m2, setting.resolution)
        slot, gain = max(gained, key=lambda x: x[1], default=(0, 0.0))
        if not gained or gain <= 0:
            release(dealt)
            still = STILL if not gained else still + 1
        else:
            chosen = movers.where(F.col("slot") >= slot)
            nxt = cut(applied(state, chosen), "state")
            q = q + gain if exact else quality(nxt)
            if trace is not None:
                trace.append((turn, chosen.count(), q))
            still = still + 1 if gain <= setting.min_gain else 0
            release(dealt, *([state] if state is not best else []))
            if q > best_q or exact:
                if best is not state:
                    release(best)
                best, best_q = nxt, q
            state = nxt
        if still >= STILL:
            break
    out = cut(relabelled(best.select("node", "comm")), "moved")
    if graph:
        release(graph.blocks)
    release(best, *([state] if state is not best else []))
    return out


def _within_size(movers: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """Of the joiners of each community those for which there is room, whoever leaves."""
    size = state.groupBy(F.col("comm").alias("new")).agg(F.count(F.lit(1)).alias("members"))
    place = F.row_number().over(W.partitionBy("new").orderBy(F.desc("slot"), "node"))
    return movers.withColumn("place", place).where(F.col("place") <= most).join(size, "new").where(F.col("members") + F.col("place") <= most).drop("place", "members")


@dataclass(frozen=True)
class Hierarchy:
    #: level (from 1), node (of the original graph), comm (smallest node in it)
    levels: DataFrame
    #: level, comm, supernode: what a node of level - 1 became at the level
    parents: DataFrame
    #: level, communities, modularity
    summary: list[tuple[int, int, float]]

    def final(self) -> DataFrame:
        return self.levels.where(F.col("level") == max(x[0] for x in self.summary)).drop("level")


def louvain(edges: DataFrame, setting: LouvainSettings = LouvainSettings(), mode: str | None = None, progress: Callable[[int, int, str], None] | None = None) -> Hierarchy:
    """Cluster ``src, dst, weight`` (or canonical ``u, v, w``) level by level.

    ``mode`` (by default that of ``setting``) is the caller's choice and never follows the size: ``exact`` moves a graph of more
    than ``exact_limit`` edges by its components and refuses one with a component beyond that by a ValueError, ``streamed`` makes the same
    moves for any number of edges, ``distributed`` takes any.
    """
    mode = mode or setting.mode
    if mode not in ("exact", "streamed", "distributed"):
        raise ValueError(f"unknown mode {mode!r}")
    edges = edges if {"u", "v", "w"} <= set(edges.columns) else canonical(edges)
    base = edges if hasattr(edges, "_metaweave_path") else cut(edges, "canon")
    canon = base
    parts = None
    if mode == "exact" and canon.count() > setting.exact_limit:
        parts = cut(star_components(canon), "parts")
        n = with_component(canon, parts).groupBy("component").count().agg(F.max("count")).first()[0]
        if n > setting.exact_limit:
            raise ValueError(f"{n} edges in a component; the exact mode is for at most {setting.exact_limit}, use 'distributed'")
    degree = cut(degrees(base), "degrees")
    final = cut(degree.select("node", F.col("node").alias("comm")), "final")
    size = final.count()
    levels, parents, summary = [], [], []
    last_q = modularity(base, final, setting.resolution, degree).first()[0] or 0.0
    for level in range(1, setting.max_levels + 1):
        if mode == "streamed":
            moved = streamed_moves(canon, setting)
        else:
            moved = cut(exact_moves(canon, setting, parts) if mode == "exact" else distributed_moves(canon, setting), "moved")
        now = moved.select("comm").distinct().count()
        composed = cut(
            final.withColumnRenamed("comm", "c").join(moved.withColumnRenamed("node", "c"), "c").select("node", "comm"), "final"
        )
        q = modularity(base, composed, setting.resolution, degree).first()[0] or 0.0
        if progress:
            progress(level, setting.max_levels, f"{now} communities, modularity {q:.6f}")
        if now >= size or (level > 1 and q <= last_q + 1e-12 and not setting.min_gain < 0):
            break
        levels.append(composed.select(F.lit(level).alias("level"), "node", "comm"))
        parents.append(moved.select(F.lit(level).alias("level"), F.col("node").alias("comm"), F.col("comm").alias("supernode")))
        summary.append((level, now, q))
        last_q, size, final = q, now, composed
        if now <= 1:
            break
        nxt = cut(aggregate(canon, moved), "canon")
        if canon is not base:
            release(canon)
        canon = nxt
        if parts is not None:  # communities don't reach beyond components and are named by a member
            parts = cut(parts.join(nxt.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi"), "parts")
    if not levels:  # nothing merged: the nodes are the communities
        levels = [final.select(F.lit(1).alias("level"), "node", "comm")]
        parents = [final.select(F.lit(1).alias("level"), F.col("node").alias("comm"), F.col("comm").alias("supernode"))]
        summary = [(1, size, last_q)]
    out, up = levels[0], parents[0]
    for a, b in zip(levels[1:], parents[1:]):
        out, up = out.unionByName(a), up.unionByName(b)
    return Hierarchy(out, up, summary)
