"""Materialisation: meta-path instances aggregated to a weighted homogeneous graph.

Instances are a chain of equi-joins over edges that carry their end types.  Where only
``(start, end, weight)`` is wanted, each hop drops the inner nodes that no later cycle test
needs and pre-aggregates parallel partial paths, so dense inner hops shrink before the next
join instead of after the last.  Weights must be positive to count (validation rejects
negative ones), which makes every strategy a semiring and the pre-aggregation exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.model import Aggregation, Graph, MetaPath, Traversal
from metaweave.operators import weights
from metaweave.operators.product import product
from metaweave.operators.totals import FOLDS, totals
from metaweave.plans.scratch import cut


def typed_edges(graph: Graph) -> DataFrame:
    """Edges with the types of both ends; edges with an unknown end have no place on a path."""
    if {"src_type", "dst_type"} <= set(graph.edges.columns):
        return graph.edges
    kinds = graph.nodes.select("id", "type")
    return (
        graph.edges.join(kinds.withColumnsRenamed({"id": "src", "type": "src_type"}), "src")
        .join(kinds.withColumnsRenamed({"id": "dst", "type": "dst_type"}), "dst")
        .select("src", "dst", "etype", "weight", "src_type", "dst_type")
    )


#: What is kept of the instances of a pair of ends: number, sum, largest and smallest weight.
VALUES = ("n", "total", "high", "low")


def _hop(typed: DataFrame, path: MetaPath, i: int) -> DataFrame:
    return typed.where(
        (F.col("etype") == path.edge_types[i])
        & (F.col("src_type") == path.node_types[i])
        & (F.col("dst_type") == path.node_types[i + 1])
    ).select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"), F.col("weight").alias("w"))


def _length(path: MetaPath, traversal: Traversal) -> int:
    """Hops that are followed; a path longer than the cap has no complete instance."""
    return len(path) if len(path.node_types) <= traversal.max_length else 0


def instances(graph: Graph, path: MetaPath, traversal: Traversal = Traversal()) -> DataFrame:
    """``n0 .. nk, weight``, one row an instance; the weight is the product along the path."""
    typed = typed_edges(graph)
    kinds = path.node_types
    hops = _length(path, traversal)
    out = _hop(typed, path, 0).withColumnRenamed("w", "weight")
    if not hops:
        out = out.where(F.lit(False))
    for i in range(len(path)):
        if i:
            out = out.join(_hop(typed, path, i), f"n{i}").withColumn("weight", F.col("weight") * F.col("w")).drop("w")
        if not traversal.allow_cycles:
            for j in range(i + 1):
                if kinds[j] == kinds[i + 1]:
                    out = out.where(F.col(f"n{j}") != F.col(f"n{i + 1}"))
    names = [f"n{i}" for i in range(len(kinds))]
    out = out.select(*names, "weight")
    if traversal.max_instances is not None:
        out = out.orderBy(*names, "weight").limit(traversal.max_instances)
    return out


def as_arrays(found: DataFrame, path: MetaPath) -> DataFrame:
    """Instances as ``nodes, edges, weight``."""
    return found.select(
        F.array(*[f"n{i}" for i in range(len(path.node_types))]).alias("nodes"),
        F.array(*map(F.lit, path.edge_types)).alias("edges"),
        "weight",
    )


def valid(found: DataFrame) -> DataFrame:
    return found.where("weight > 0")


def _walked(graph: Graph, path: MetaPath, traversal: Traversal, needs: list[str], until: int | None = None) -> tuple[DataFrame, DataFrame | None, list[str], list[str]]:
    """``(out, hop, keys, same)``: partial paths of the first ``until`` hops (default: all) with the ``keys`` that the
    rest needs and the values ``needs``; the hop after them, and which of the keys its end must not repeat."""
    last = len(path)
    until = last if until is None else until
    typed = typed_edges(graph).where("weight > 0")
    kinds = path.node_types
    if not _length(path, traversal):
        typed = typed.where(F.lit(False))
    how = {"n": "sum", "total": "sum", "high": "max", "low": "min"}
    fold = {v: FOLDS[h][0] for v, h in how.items()}
    alone = {"n": F.lit(1).cast("bigint"), "total": F.col("w"), "high": F.col("w"), "low": F.col("w")}
    joined = [fold[v](F.col(v) * F.col(f"h{v}")).alias(v) for v in needs]

    out, keys = None, ["n0"]
    for i in range(last):
        hop = _hop(typed, path, i)
        if out is not None:
            hop = hop.groupBy(f"n{i}", f"n{i + 1}").agg(*[fold[v](alone[v]).alias(f"h{v}") for v in needs])
        same = [] if traversal.allow_cycles else [k for k in keys if kinds[int(k[1:])] == kinds[i + 1]]
        if i == until:
            return out, hop, keys, same
        repeats = reduce(and_, [F.col(k) != F.col(f"n{i + 1}") for k in same]) if same else None
        later = set() if traversal.allow_cycles else set(kinds[i + 2 :])
        keys = [k for k in [*keys, f"n{i + 1}"] if k in ("n0", f"n{i + 1}") or kinds[int(k[1:])] in later]
        if out is None:
            out = (hop if repeats is None else hop.where(repeats)).groupBy("n0", "n1").agg(*[fold[v](alone[v]).alias(v) for v in needs])
        else:
            *starts, end = keys
            if starts == ["n0"] and set(same) <= {"n0"}:
                out = totals(out, hop, f"n{i}", "n0", end, {v: (how[v], v, f"h{v}") for v in needs}, "different" if same else None)
            else:
                out = product(out, hop, f"n{i}", starts, end, joined, repeats)
    return out, None, keys, []


def endpoints(graph: Graph, path: MetaPath, traversal: Traversal = Traversal(), needs: Iterable[str] = VALUES) -> DataFrame:
    """``src, dst`` and of ``n, total, high, low`` those in ``needs``, over the valid instances of each pair of ends."""
    last, needs = len(path), [v for v in VALUES if v in needs]
    if traversal.max_instances is not None:
        found = valid(instances(graph, path, traversal))
        made = {"n": F.count(F.lit(1)), "total": F.sum("weight"), "high": F.max("weight"), "low": F.min("weight")}
        return found.groupBy(F.col("n0").alias("src"), F.col(f"n{last}").alias("dst")).agg(*[made[v].alias(v) for v in needs])
    return _walked(graph, path, traversal, needs)[0].withColumnsRenamed({"n0": "src", f"n{last}": "dst"})


def instance_count(graph: Graph, path: MetaPath, traversal: Traversal = Traversal()) -> DataFrame:
    """One row ``n``: the number of valid instances.  The last hop isn't walked: its edges a middle are
    counted, and those that lead back to a node of the partial path are taken off."""
    last = len(path)
    if traversal.max_instances is not None or last < 2:
        return endpoints(graph, path, traversal, ["n"]).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
    out, hop, keys, same = _walked(graph, path, traversal, ["n"], last - 1)
    middle, end = f"n{last - 1}", f"n{last}"
    out = cut(out, "partial") if same else out
    here = out.groupBy(middle).agg(F.sum("n").alias("n"))
    on = hop.groupBy(middle).agg(F.sum("hn").alias("hn"))
    counts = here.join(on, middle).select((F.col("n") * F.col("hn")).alias("n"))
    if same:
        back = out.select(middle, "n", F.explode(F.array_distinct(F.array(*same))).alias(end)).groupBy(middle, end).agg(F.sum("n").alias("n"))
        counts = counts.unionByName(back.join(hop, [middle, end]).select((-F.col("n") * F.col("hn")).alias("n")))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))


def _needed(setting: Aggregation) -> tuple[str, ...]:
    """The values of :func:`endpoints` that the strategy reads."""
    if setting.mode == "meeting":
        return {"maximum": ("n", "high"), "minimum": ("n", "low"), "count": ("n",)}.get(setting.strategy, ("n", "total"))
    return {"count": ("n",), "sum": ("total",), "average": ("n", "total"), "maximum": ("high",), "minimum": ("low",)}[setting.strategy]


def _value(strategy: str):
    return {
        "count": F.col("n").cast("double"),
        "sum": F.col("total"),
        "average": F.col("total") / F.col("n"),
        "maximum": F.col("high"),
        "minimum": F.col("low"),
    }[strategy]


def direct(ends: DataFrame, setting: Aggregation) -> DataFrame:
    """``src, dst, weight`` by start and end; ``symmetric`` adds the reversed edges."""
    out = ends.select("src", "dst", _value(setting.strategy).alias("weight")).where(F.col("weight") >= setting.min_weight)
    if setting.symmetric:
        back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        out = out.unionAll(back).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return out


def meeting(ends: DataFrame, setting: Aggregation) -> DataFrame:
    """``src, dst, weight`` between starts whose instances end at the same node.

    For m and n instances of two starts at a meeting point the reference contract adds
    ``m * n * f`` where f is taken over the m x n pairs; ``per_node_pair`` adds f once.
    """
    a = ends.select(F.col("dst").alias("at"), F.col("src").alias("src"), *[F.col(c).alias(f"a_{c}") for c in VALUES if c in ends.columns])
    b = ends.select(F.col("dst").alias("at"), F.col("src").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in VALUES if c in ends.columns])
    if not setting.min_weight:  # weights are positive, so nothing is cut
        return _met(a, b, setting)
    pairs = F.col("a_n") * F.col("b_n")
    f = {
        "count": pairs.cast("double"),
        "sum": F.col("a_total") * F.col("b_n") + F.col("b_total") * F.col("a_n"),
        "average": (F.col("a_total") * F.col("b_n") + F.col("b_total") * F.col("a_n")) / (2 * pairs),
        "maximum": F.greatest("a_high", "b_high"),
        "minimum": F.least("a_low", "b_low"),
    }[setting.strategy]
    each = f if setting.per_node_pair else f * pairs
    kept = (F.col("src") < F.col("dst")) & (each >= setting.min_weight)
    out = product(a, b, "at", ["src"], "dst", [F.sum(each).alias("weight")], kept)
    return _mirrored(out, setting)


def _mirrored(out: DataFrame, setting: Aggregation) -> DataFrame:
    return out.unionAll(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")) if setting.symmetric else out


def _met(a: DataFrame, b: DataFrame, setting: Aggregation) -> DataFrame:
    """:func:`meeting` of all pairs as sums of products of a value of each side."""
    times = (lambda c, side: c) if setting.per_node_pair else (lambda c, side: c * F.col(f"{side}_n"))
    for side, df in (("a", a), ("b", b)):
        made = {f"{side}_m": F.col(f"{side}_n")}
        if setting.strategy in ("count", "sum"):
            made[f"{side}_m"] = times(F.col(f"{side}_n"), side)
        if setting.strategy == "sum":
            made[f"{side}_t"] = times(F.col(f"{side}_total"), side)
        if setting.strategy == "average":
            made[f"{side}_m"] = F.lit(1) if setting.per_node_pair else F.col(f"{side}_n")
            made[f"{side}_t"] = F.col(f"{side}_total") / (2 * F.col(f"{side}_n") if setting.per_node_pair else F.lit(2))
        if setting.strategy in ("maximum", "minimum"):
            value = {"maximum": "high", "minimum": "low"}[setting.strategy]
            made = {f"{side}_v": F.col(f"{side}_{value}"), f"{side}_m": F.lit(1) if setting.per_node_pair else F.col(f"{side}_n")}
        df = df.select("at", "src" if side == "a" else "dst", *[c.alias(n) for n, c in made.items()])
        a, b = (df, b) if side == "a" else (a, df)
    if setting.strategy == "count":
        folds = {"x": ("sum", "a_m", "b_m")}
    elif setting.strategy in ("sum", "average"):
        folds = {"x": ("sum", "a_t", "b_m"), "y": ("sum", "a_m", "b_t")}
    else:
        folds = {"x": ("sum", "a_m", "b_m", {"maximum": "greatest", "minimum": "least"}[setting.strategy], "a_v", "b_v")}
    found = totals(a, b, "at", "src", "dst", folds, "ascending")
    weight = (F.col("x") + F.col("y") if "y" in folds else F.col("x")).cast("double")
    return _mirrored(found.select("src", "dst", weight.alias("weight")), setting)


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(k) if k else edges


def no_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def node_set(ends: DataFrame, path: MetaPath) -> DataFrame:
    """Starts and ends of the valid instances, whether or not an edge survives."""
    kind = path.node_types[0] if path.symmetric else "Mixed"
    return ends.select(F.col("src").alias("id")).unionAll(ends.select(F.col("dst").alias("id"))).distinct().withColumn("type", F.lit(kind))


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed edges in and out of each node; a symmetric pair counts two for each end."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


@dataclass(frozen=True)
class Homogeneous:
    nodes: DataFrame
    edges: DataFrame
    path: MetaPath


def nodes_at_once(ends: DataFrame, path: MetaPath, setting: Aggregation) -> DataFrame:
    """:func:`node_set` with degrees in one pass over ``ends``, where each edge is one of their rows."""
    kind = path.node_types[0] if path.symmetric else "Mixed"
    edge = ((_value(setting.strategy) >= setting.min_weight) & (F.col("src") != F.col("dst"))).cast("bigint")
    both = ends.select(edge.alias("edge"), F.explode(F.array("src", "dst")).alias("id"))
    return both.groupBy("id").agg(F.coalesce(F.sum("edge"), F.lit(0)).cast("bigint").alias("degree")).select("id", F.lit(kind).alias("type"), "degree")


def materialise(graph: Graph, path: MetaPath, traversal: Traversal = Traversal(), setting: Aggregation = Aggregation(), keep: bool = False) -> Homogeneous:
    """Enumerate, aggregate, cut, normalise; the last hop stays lazy.

    ``keep`` writes the pairs of ends once, for callers that read nodes and edges, or either
    several times; normalisation by aggregates of the edges does so too.
    """
    ends = endpoints(graph, path, traversal, _needed(setting))
    if keep or setting.normalisation in ("degree", "max", "zscore"):
        ends = cut(ends, "ends")
    raw = meeting(ends, setting) if setting.mode == "meeting" else direct(ends, setting)
    edges = no_self_loops(top_edges(raw, setting.max_edges))
    edges = weights.normalise(edges, setting)
    if setting.mode == "direct" and not (setting.symmetric or setting.max_edges or setting.normalisation == "custom"):
        nodes = nodes_at_once(ends, path, setting)
    else:
        nodes = with_degrees(node_set(ends, path), edges)
    if setting.drop_isolated:
        nodes = nodes.where("degree > 0")
    return Homogeneous(nodes, edges, path)


def materialise_many(graph: Graph, paths: Iterable[MetaPath], traversal: Traversal = Traversal(), setting: Aggregation = Aggregation()) -> tuple[DataFrame | None, dict[str, str]]:
    """Edges of all paths with ``path_id``, and the paths that failed with their reasons."""
    out, failed = None, {}
    for i, path in enumerate(paths):
        name = path.id or str(i)
        try:
            one = materialise(graph, path, traversal, setting).edges.withColumn("path_id", F.lit(name))
            one.schema  # analysed here, so that a wrong path fails alone
        except Exception as error:
            failed[name] = str(error)
            continue
        out = one if out is None else out.unionByName(one)
    return out, failed


def coverage(ends: DataFrame) -> DataFrame:
    """Distinct starts and ends of the valid instances, and their number."""
    return ends.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("instances"),
        F.count_distinct("src").alias("starts"),
        F.count_distinct("dst").alias("ends"),
    )


def traversal_counts(graph: Graph, path: MetaPath) -> DataFrame:
    """Start nodes, instances without and with cycles, and how many the cycle test removes."""
    starts = graph.nodes_of(path.node_types[0]).agg(F.count(F.lit(1)).alias("start_nodes"))
    open_ = instance_count(graph, path, Traversal(allow_cycles=True)).withColumnRenamed("n", "walks")
    closed = instance_count(graph, path).withColumnRenamed("n", "instances")
    return starts.crossJoin(open_).crossJoin(closed).withColumn("cycles", F.col("walks") - F.col("instances"))


CAP = 10_000_000


def estimate_instances(graph: Graph, path: MetaPath) -> int:
    """Start nodes times max(1, edges of each hop / all nodes), cut to whole numbers, capped."""
    kinds = {r["type"]: r["n"] for r in graph.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(kinds.values())
    counts = {
        (r["src_type"], r["etype"], r["dst_type"]): r["n"]
        for r in typed_edges(graph).groupBy("src_type", "etype", "dst_type").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    out = kinds.get(path.node_types[0], 0)
    for a, e, b in zip(path.node_types, path.edge_types, path.node_types[1:]):
        n = counts.get((a, e, b), 0)
        if not n or not total:
            return 0
        out = math.floor(out * max(1.0, n / total))
        if out > CAP:
            return CAP
    return out


def estimate_memory(found: int, nodes: int, edges: int) -> int:
    """Bytes: 100 an instance, 50 a node or edge, and 100 MB."""
    return found * 100 + (nodes + edges) * 50 + 100 * 1024 * 1024


def feasible(graph: Graph, path: MetaPath, traversal: Traversal = Traversal(), max_bytes: int = 8 << 30) -> tuple[bool, str]:
    found = estimate_instances(graph, path)
    if traversal.max_instances is not None and found > traversal.max_instances:
        return False, f"about {found} instances; the limit is {traversal.max_instances}"
    need = estimate_memory(found, graph.nodes.count(), graph.edges.count())
    return need <= max_bytes, f"about {need} bytes"
