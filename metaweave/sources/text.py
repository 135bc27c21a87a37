"""Readers of the text formats: edge lists, properties, paths, community blocks, sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.functions.ids import dense_ids
from metaweave.model import Graph, MetaPath


class FormatError(ValueError):
    """A file that doesn't follow its format."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, fields, file, at``: lines that are neither blank nor comments.

    ``at`` orders the lines of a file: by split, and within a split as it is read.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    trimmed = F.trim(F.regexp_replace("value", r"\s+", " "))
    return text.withColumn("value", trimmed).where((F.col("value") != "") & ~F.col("value").startswith("#")).withColumn("fields", F.split("value", " "))


def _field(i: int):
    return F.get("fields", F.lit(i))


def _refuse(bad: DataFrame, what: str) -> None:
    row = bad.select("value").first()
    if row:
        raise FormatError(f"{what}: {row['value']!r}")


def read_edges(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``src, dst, weight``: directed; a weight that isn't a number is 1.

    A line with fewer than two fields is an error, or skipped if not ``strict``.
    """
    rows = lines(spark, path)
    if strict:
        _refuse(rows.where(F.size("fields") < 2), "an edge needs two fields")
    return rows.where(F.size("fields") >= 2).select(
        _field(0).alias("src"), _field(1).alias("dst"), F.coalesce(_field(2).try_cast("double"), F.lit(1.0)).alias("weight")
    )


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """``id, type`` as ``Type_<n>``; exactly two fields a line; the last line of an id holds."""
    rows = lines(spark, path)
    _refuse(rows.where(F.size("fields") != 2), "a property line has two fields")
    last = F.max_by(_field(1), F.struct("file", "at"))
    return rows.groupBy(_field(0).alias("id")).agg(F.concat(F.lit("Type_"), last).alias("type"))


def read_path(spark: SparkSession, path: str) -> MetaPath:
    """One type a line, two at least; edge types follow from their ends."""
    kinds = [f"Type_{r['value']}" for r in lines(spark, path).orderBy("file", "at").select("value").collect()]
    if len(kinds) < 2:
        raise FormatError("a path has two types at least")
    return MetaPath.of_types(*kinds)


def inferred_edge_types(nodes: DataFrame, edges: DataFrame, default_type: str | None = None) -> DataFrame:
    """Edges with ``etype`` from the types of their ends; unlisted nodes have ``default_type`` or drop out."""
    kinds = nodes.select("id", "type")
    how = "inner" if default_type is None else "left"
    fill = lambda c: F.coalesce(F.col(c), F.lit(default_type)) if default_type is not None else F.col(c)
    out = edges.join(kinds.withColumnsRenamed({"id": "src", "type": "a"}), "src", how).join(kinds.withColumnsRenamed({"id": "dst", "type": "b"}), "dst", how)
    return out.select("src", "dst", F.concat_ws("_to_", fill("a"), fill("b")).alias("etype"), "weight")


def load_graph(spark: SparkSession, graph: str, properties: str, path: str, directed: bool = True) -> tuple[Graph, MetaPath]:
    """The three files together; ``directed=False`` adds each edge's reverse."""
    nodes = read_properties(spark, properties).withColumn("props", F.create_map().cast("map<string,string>"))
    edges = read_edges(spark, graph)
    if not directed:
        edges = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return Graph(nodes, inferred_edge_types(nodes, edges)), read_path(spark, path)


# ---------------------------------------------------------------- the sketch pipeline's reading


def read_numbered_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst`` whole numbers, both directions, weights ignored, bad lines skipped."""
    rows = lines(spark, path).select(_field(0).try_cast("bigint").alias("src"), _field(1).try_cast("bigint").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    return rows.unionAll(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def read_numbered_types(spark: SparkSession, path: str, edges: DataFrame, default: int = 0) -> DataFrame:
    """``id, type`` for every number up to the largest in ``edges``; unlisted ones have the default."""
    rows = lines(spark, path).select(_field(0).try_cast("bigint").alias("id"), _field(1).try_cast("int").alias("type"), "file", "at")
    listed = rows.where("id >= 0 AND type IS NOT NULL").groupBy("id").agg(F.max_by("type", F.struct("file", "at")).alias("type"))
    top = edges.agg(F.max(F.greatest("src", "dst")).alias("m")).first()["m"]
    every = spark.range(0 if top is None else top + 1)
    return every.join(listed, "id", "left").select("id", F.coalesce("type", F.lit(default)).alias("type"))


def read_numbered_path(spark: SparkSession, path: str | None) -> list[int]:
    """The types of the path; [0] where there is no file."""
    if path is None:
        return [0]
    try:
        rows = lines(spark, path).orderBy("file", "at").select(_field(0).try_cast("int").alias("t")).where("t IS NOT NULL").collect()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return [0]
    return [r["t"] for r in rows] or [0]


def normalised_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges over dense numbers and the table ``id, n`` behind them (numeric-aware order)."""
    edges = read_edges(spark, path, strict=False)
    ids = dense_ids(edges.select(F.explode(F.array("src", "dst")).alias("id")), "id")
    out = edges.join(ids.withColumnsRenamed({"id": "src", "n": "u"}), "src").join(ids.withColumnsRenamed({"id": "dst", "n": "v"}), "dst")
    return out.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight"), ids


def distinct_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``node, others``: sorted distinct neighbours."""
    return read_numbered_edges(spark, path).groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("others"))


# ---------------------------------------------------------------- block files

_BLOCKS = "head string, member string, place int, file string"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``head, member, place, file`` of ``name / count / count lines`` blocks, in file order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for text, file in zip(rows["value"], rows["file"]):
                held = [x.strip() for x in text.splitlines() if x.strip()]
                out, i = [], 0
                while i < len(held):
                    if i + 1 >= len(held) or not held[i + 1].isdigit():
                        raise FormatError(f"{file}: {held[i]!r} has no count")
                    n = int(held[i + 1])
                    own = held[i + 2 : i + 2 + n]
                    if len(own) != n:
                        raise FormatError(f"{file}: {held[i]!r} has {len(own)} of {n} lines")
                    out += [(held[i], m, k, file) for k, m in enumerate(own)]
                    i += 2 + n
                yield pd.DataFrame(out, columns=["head", "member", "place", "file"])

    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return whole.mapInPandas(run, _BLOCKS)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``level, node, comm`` of a mapping file."""
    level = F.regexp_extract("head", r"_l(\d+)_", 1).try_cast("int")
    return read_blocks(spark, path).select(level.alias("level"), F.col("member").alias("node"), F.col("head").alias("comm"))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """``level, parent, child``; bare child numbers become ids of the level below."""
    level = F.regexp_extract("head", r"_l(\d+)_", 1).try_cast("int")
    bare = F.col("member").rlike(r"^\d+$") & (level > 1)
    child = F.when(bare, F.concat(F.lit("c0_l"), (level - 1).cast("string"), F.lit("_"), F.col("member"))).otherwise(F.col("member"))
    return read_blocks(spark, path).select(level.alias("level"), F.col("head").alias("parent"), child.alias("child"))


def read_root(spark: SparkSession, path: str) -> str | None:
    row = lines(spark, path).orderBy("file", "at").select("value").first()
    return row["value"] if row else None


_SKETCHES = "level int, node string, layer int, own array<bigint>, hashes array<bigint>"


def read_sketch_header(spark: SparkSession, path: str) -> dict[str, str]:
    row = spark.read.text(path).where(F.col("value").startswith("k=")).first()
    if row is None:
        raise FormatError("a sketch file starts with k=")
    return dict(x.partition("=")[::2] for x in row["value"].split())


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """``level, node, layer, own, hashes`` of a sketch file."""

    def numbers(text: str) -> list[int]:
        return sorted({int(x) for x in text.replace(" ", "").split(",") if x and int(x) != (1 << 32) - 1})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for text in rows["value"]:
                held = text.splitlines()
                head = dict(x.partition("=")[::2] for x in held[0].split())
                if "k" not in head or "nk" not in head:
                    raise FormatError("a sketch file starts with k= and nk=")
                nk, out, i = int(head["nk"]), [], 1
                while i < len(held):
                    if not held[i].strip():
                        i += 1
                        continue
                    if i + 1 + nk >= len(held) + (0 if held[-1] else 1):
                        raise FormatError(f"{held[i]!r} lacks lines")
                    name = held[i].strip()
                    level = int(name.split("_l")[1].split("_")[0]) if "_l" in name else 0
                    own = numbers(held[i + 1])
                    out += [(level, name, j, own, numbers(held[i + 2 + j])) for j in range(nk)]
                    i += 2 + nk
                yield pd.DataFrame(out, columns=["level", "node", "layer", "own", "hashes"])

    whole = spark.read.text(path, wholetext=True)
    return whole.mapInPandas(run, _SKETCHES)


# ---------------------------------------------------------------- JSON, binary, uploads

_GRAPH_JSON = "nodes map<string,map<string,string>>, edges array<struct<from:string,to:string,type:string,weight:double>>"


def read_graph_json(spark: SparkSession, path: str, zero_weight_as_one: bool = False) -> Graph:
    """Nodes by id with their type and further attributes, and directed edges."""
    raw = spark.read.schema(_GRAPH_JSON).json(path, multiLine=True)
    entry = raw.select(F.explode("nodes").alias("id", "a"))
    rest = F.map_filter("a", lambda k, v: ~k.isin("id", "type", "properties"))
    nodes = entry.select("id", F.try_element_at("a", F.lit("type")).alias("type"), rest.alias("props"))
    weight = F.col("e.weight")
    if zero_weight_as_one:
        weight = F.when(F.coalesce(weight, F.lit(0.0)) == 0, 1.0).otherwise(weight)
    edges = raw.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.type").alias("etype"), F.coalesce(weight, F.lit(0.0)).alias("weight"))
    return Graph(nodes, edges)


def read_meta_path_json(spark: SparkSession, path: str) -> MetaPath:
    return MetaPath.parse(spark.read.text(path, wholetext=True).first()["value"])


def read_levels_json(spark: SparkSession, path: str) -> DataFrame:
    """``level, id, x, y, radius, pagerank`` of a drawing file."""
    shape = "map<string,map<string,struct<x:double,y:double,radius:double,pagerank:double>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("m"))
    per = raw.select(F.explode("m").alias("level", "nodes")).select("level", F.explode("nodes").alias("id", "v"))
    return per.select("level", "id", "v.x", "v.y", "v.radius", "v.pagerank")


BINARY = {"double": ("<f8", "double"), "int": ("<u4", "bigint"), "float": ("<f4", "float")}


def read_binary(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """``file, idx, value`` of little-endian numbers; the file size must divide by their width."""
    code, sql = BINARY[kind]
    width = np.dtype(code).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for file, content in zip(rows["path"], rows["content"]):
                if len(content) % width:
                    raise FormatError(f"{file}: {len(content)} bytes don't divide by {width}")
                values = np.frombuffer(content, code)
                for i in range(0, len(values), 1 << 16):
                    part = values[i : i + (1 << 16)]
                    yield pd.DataFrame({"file": file, "idx": np.arange(i, i + len(part)), "value": part.astype(np.int64 if kind == "int" else code)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, idx bigint, value {sql}")


def upload_summary(spark: SparkSession, graph: str, properties: str, path: str) -> DataFrame:
    """``nodes, edges, bytes``: lines that aren't comments, and sizes of the three files."""
    n = lines(spark, properties).agg(F.count(F.lit(1)).alias("nodes"))
    e = lines(spark, graph).agg(F.count(F.lit(1)).alias("edges"))
    size = None
    for one in (graph, properties, path):
        b = spark.read.format("binaryFile").load(one).select("length")
        size = b if size is None else size.unionAll(b)
    return n.crossJoin(e).crossJoin(size.agg(F.sum("length").alias("bytes")))
