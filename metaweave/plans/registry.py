"""Plug-in points: clustering algorithms by name and sketch estimators by method."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Protocol

from pyspark.sql import DataFrame

from metaweave.model import Graph, LouvainSettings, MetaPath, SketchSettings
from metaweave.operators import accuracy as X
from metaweave.operators import louvain, metapath, scar

Progress = Callable[[int, int, str], None]


class Estimator(Protocol):
    """Edges between node sets ``set, node`` estimated from sketches of ``edges``."""

    name: str

    def parameters(self) -> dict: ...

    def estimate(self, edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
        """``a, b, estimate``."""


@dataclass(frozen=True)
class BottomK:
    k: int = 64
    by_node: bool = False

    @property
    def name(self) -> str:
        return f"bottom-k {'sum' if self.by_node else 'union'} {self.k}"

    def parameters(self) -> dict:
        return {"k": self.k, "by_node": self.by_node}

    def estimate(self, edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
        return (X.bottomk_edges_sum if self.by_node else X.bottomk_edges_union)(edges, a, b, self.k)


@dataclass(frozen=True)
class CountMin:
    depth: int = 4
    width: int = 256
    by_node: bool = False

    @property
    def name(self) -> str:
        return f"count-min {'single' if self.by_node else 'merged'} {self.depth}x{self.width}"

    def parameters(self) -> dict:
        return {"depth": self.depth, "width": self.width, "by_node": self.by_node}

    def estimate(self, edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
        return (X.cms_edges_single if self.by_node else X.cms_edges_merged)(edges, a, b, self.depth, self.width)


def study(edges: DataFrame, a: DataFrame, b: DataFrame, estimators: list[Estimator]) -> DataFrame:
    """``a, b, method, exact, estimate, density`` of every estimator against the truth."""
    from pyspark.sql import functions as F

    truth = X.ground_truth(edges, a, b).select("a", "b", F.col("weight").cast("double").alias("exact"), "density")
    out = None
    for e in estimators:
        one = truth.join(e.estimate(edges, a, b).withColumn("estimate", F.col("estimate").cast("double")), ["a", "b"]).withColumn("method", F.lit(e.name))
        out = one if out is None else out.unionByName(one)
    return out


def _checked(kind, values: dict):
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**values)


def _materialised(graph: Graph, path: MetaPath, values: dict, progress: Progress | None) -> louvain.Hierarchy:
    return louvain.louvain(metapath.materialise(graph, path).edges, _checked(LouvainSettings, values), progress=progress)


def _sketched(graph: Graph, path: MetaPath, values: dict, progress: Progress | None) -> louvain.Hierarchy:
    return scar.scar(graph.nodes, graph.edges, list(path.node_types), _checked(SketchSettings, values), progress=progress)


#: name -> run(graph, path, settings, progress)
ALGORITHMS: dict[str, Callable[[Graph, MetaPath, dict, Progress | None], louvain.Hierarchy]] = {"louvain": _materialised, "scar": _sketched}


def run(name: str, graph: Graph, path: MetaPath, settings: dict | None = None, progress: Progress | None = None) -> louvain.Hierarchy:
    if name not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name!r}")
    return ALGORITHMS[name](graph, path, settings or {}, progress)
