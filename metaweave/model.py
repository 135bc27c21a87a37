"""Data model: schemas, meta-paths and the settings of the operators."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "id string, type string, props map<string,string>"
EDGES = "src string, dst string, etype string, weight double"
HOMOGENEOUS = "src string, dst string, weight double"
ASSIGNMENT = "level int, node string, comm string"
SKETCHES = "level int, node string, layer int, hashes array<bigint>"
MOVES = (
    "move int, level int, algorithm string, node int, from_comm int, to_comm int, "
    "gain double, modularity double, timestamp bigint"
)
COORDINATES = "id string, x double, y double, radius double"

STRATEGIES = ("count", "sum", "average", "maximum", "minimum")
NORMALISATIONS = ("none", "degree", "max", "zscore", "custom")


@dataclass(frozen=True)
class Graph:
    """Typed nodes and typed directed edges."""

    nodes: DataFrame
    edges: DataFrame

    def nodes_of(self, kind: str) -> DataFrame:
        return self.nodes.where(F.col("type") == kind)

    def edges_of(self, kind: str) -> DataFrame:
        return self.edges.where(F.col("etype") == kind)

    def incident(self) -> DataFrame:
        """``(node, other, etype, weight)``: each edge from both ends, duplicates kept."""
        e = self.edges
        return e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "etype", "weight").unionAll(
            e.select(F.col("dst").alias("node"), F.col("src").alias("other"), "etype", "weight")
        )

    def neighbours(self, node: str, kind: str | None = None) -> DataFrame:
        out = self.incident().where(F.col("node") == node)
        return (out.where(F.col("etype") == kind) if kind else out).select("other", "etype", "weight")

    def weight(self, src: str, dst: str) -> float:
        """The weight of the edge, or 0 where there is none; of parallel edges the least type's."""
        row = self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).orderBy("etype").select("weight").first()
        return row[0] if row else 0.0

    def has_edge(self, src: str, dst: str) -> bool:
        return bool(self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).take(1))


@dataclass(frozen=True)
class MetaPath:
    """A sequence of node types joined by edge types."""

    node_types: tuple[str, ...]
    edge_types: tuple[str, ...]
    id: str = ""
    description: str = ""

    def __post_init__(self):
        object.__setattr__(self, "node_types", tuple(self.node_types))
        object.__setattr__(self, "edge_types", tuple(self.edge_types))
        if problems := self.problems():
            raise ValueError("; ".join(problems))

    def problems(self) -> list[str]:
        out = []
        if len(self.node_types) < 2:
            out.append("a meta-path has two node types at least")
        if len(self.edge_types) != len(self.node_types) - 1:
            out.append("a meta-path has one edge type less than node types")
        if any(not t.strip() for t in (*self.node_types, *self.edge_types)):
            out.append("a type is blank")
        return out

    @property
    def symmetric(self) -> bool:
        """Starts and ends with the same type (a palindrome isn't asked for)."""
        return self.node_types[0] == self.node_types[-1]

    def __len__(self) -> int:
        return len(self.edge_types)

    def __str__(self) -> str:
        out = self.node_types[0]
        for e, n in zip(self.edge_types, self.node_types[1:]):
            out += f" --{e}--> {n}"
        return out

    @classmethod
    def parse(cls, text: str) -> MetaPath:
        raw = json.loads(text)
        return cls(raw["node_sequence"], raw["edge_sequence"], raw.get("id", ""), raw.get("description", ""))

    @classmethod
    def of_types(cls, *types: str) -> MetaPath:
        """Edge types inferred from their ends, as for text input."""
        return cls(types, tuple(f"{a}_to_{b}" for a, b in zip(types, types[1:])))


@dataclass(frozen=True)
class Traversal:
    allow_cycles: bool = False
    max_length: int = 10
    max_instances: int | None = None


@dataclass(frozen=True)
class Aggregation:
    strategy: str = "count"
    mode: str = "direct"
    symmetric: bool = False
    min_weight: float = 0.0
    max_edges: int = 0
    normalisation: str = "none"
    custom: Callable[[DataFrame], Column] | None = field(default=None, compare=False)
    per_node_pair: bool = False
    drop_isolated: bool = False

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.mode not in ("direct", "meeting"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.normalisation not in NORMALISATIONS:
            raise ValueError(f"unknown normalisation {self.normalisation!r}")
        if self.min_weight < 0:
            raise ValueError("min_weight is negative")
        if self.max_edges < 0:
            raise ValueError("max_edges is negative")
        if self.normalisation == "custom" and self.custom is None:
            raise ValueError("a custom normalisation needs an expression")


@dataclass(frozen=True)
class LouvainSettings:
    max_levels: int = 10
    max_iterations: int = 20
    min_gain: float = 1e-6
    resolution: float = 1.0
    exclude_self: bool = False
    require_improvement: bool = False
    max_community_size: int = 0
    seed: int = 42
    exact_limit: int = 1_000_000
    mode: str = "exact"


@dataclass(frozen=True)
class SketchSettings:
    k: int = 64
    nk: int = 4
    louvain: LouvainSettings = LouvainSettings()
