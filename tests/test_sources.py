import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaweave.functions import ids
from metaweave.model import Graph, MetaPath
from metaweave.operators import metapath as M
from metaweave.sources import generate as R
from metaweave.sources import sinks
from metaweave.sources import text as T


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        p = tmp_path / name
        p.write_bytes(content) if isinstance(content, bytes) else p.write_text(content)
        return str(p)

    return write


def test_triple(spark, put, rows):
    g = put("g.txt", "# edges\n0 1\n1 2\n2 0 2.5\n\n3 4 x\n4 5\n")
    p = put("p.txt", "0 0\n1 1\n2 0\n3 0\n4 9\n5 0\n4 1\n")
    w = put("w.txt", "0\n1\n0\n")
    graph, path = T.load_graph(spark, g, p, w)
    assert path == MetaPath.of_types("Type_0", "Type_1", "Type_0")
    assert rows(M.materialise(graph, path).edges) == [("0", "2", 1.0), ("3", "5", 1.0)]
    both, _ = T.load_graph(spark, g, p, w, directed=False)
    assert rows(M.materialise(both, path).edges) == [("0", "2", 1.0), ("2", "0", 1.0), ("3", "5", 1.0), ("5", "3", 1.0)]
    summary = T.upload_summary(spark, g, p, w).first()
    assert (summary.nodes, summary.edges) == (7, 5) and summary.bytes > 40


def test_strictness(spark, put, rows):
    bad = put("bad.txt", "a\nb c\n")
    with pytest.raises(T.FormatError):
        T.read_edges(spark, bad)
    assert rows(T.read_edges(spark, bad, strict=False)) == [("b", "c", 1.0)]
    with pytest.raises(T.FormatError):
        T.read_properties(spark, put("props.txt", "a b c\n"))
    with pytest.raises(T.FormatError):
        T.read_path(spark, put("path.txt", "1\n"))


def test_numbered(spark, put, rows):
    e = T.read_numbered_edges(spark, put("e.txt", "0 1 5\n1 3\nx y\n"))
    assert rows(e) == [(0, 1), (1, 0), (1, 3), (3, 1)]
    kinds = T.read_numbered_types(spark, put("t.txt", "1 7\n-1 3\n3 2\n3 4\nz\n"), e)
    assert rows(kinds) == [(0, 0), (1, 7), (2, 0), (3, 4)]
    assert T.read_numbered_path(spark, put("q.txt", "1\n0\n")) == [1, 0]
    assert T.read_numbered_path(spark, "/no/such/file") == [0] and T.read_numbered_path(spark, None) == [0]
    out, names = T.normalised_edges(spark, put("n.txt", "10 9\n9 100\n"))
    assert rows(names) == [("10", 1), ("100", 2), ("9", 0)] and rows(out, "src", "dst") == [(0, 2), (1, 0)]
    assert rows(T.distinct_adjacency(spark, put("d.txt", "0 1\n1 0\n0 2\n"))) == [(0, [1, 2]), (1, [0]), (2, [0])]


def test_blocks(spark, put, rows):
    m = put("m.txt", "c0_l1_0\n2\na\nb\nc0_l1_1\n1\nc\n")
    assert rows(T.read_mapping(spark, m)) == [(1, "a", "c0_l1_0"), (1, "b", "c0_l1_0"), (1, "c", "c0_l1_1")]
    h = put("h.txt", "c0_l2_0\n2\n0\nc0_l1_1\nc0_l1_0\n1\n7\n")
    assert rows(T.read_hierarchy(spark, h)) == [(1, "c0_l1_0", "7"), (2, "c0_l2_0", "c0_l1_0"), (2, "c0_l2_0", "c0_l1_1")]
    assert T.read_root(spark, put("r.txt", "c0_l2_0\n")) == "c0_l2_0"
    with pytest.raises(Exception, match="1 of 2"):
        T.read_mapping(spark, put("short.txt", "c0_l1_0\n2\na\n")).collect()


def test_sketch_file_round_trip(spark, tmp_path, rows):
    long = spark.createDataFrame([("a", 0, [1, 5]), ("a", 1, [2]), ("b", 0, [3]), ("b", 1, [])], "node string, layer int, hashes array<bigint>")
    own = spark.createDataFrame([("a", 0, 9), ("a", 1, 8), ("b", 0, 7), ("b", 1, 6)], "node string, layer int, hash bigint")
    path = str(tmp_path / "s.sketch")
    sinks.write_sketches(long, own, 4, 2, path)
    assert T.read_sketch_header(spark, path)["k"] == "4"
    found = rows(T.read_sketches(spark, path), "node", "layer", "own", "hashes")
    assert found == [("a", 0, [8, 9], [1, 5]), ("a", 1, [8, 9], [2]), ("b", 0, [6, 7], [3]), ("b", 1, [6, 7], [])]


def test_json_and_binary(spark, put, rows):
    g = {"nodes": {"a": {"type": "A", "age": "3"}, "b": {"type": "B"}}, "edges": [{"from": "a", "to": "b", "type": "x", "weight": 0}, {"from": "b", "to": "a", "type": "y", "weight": 2}]}
    path = put("g.json", json.dumps(g))
    graph = T.read_graph_json(spark, path)
    assert rows(graph.edges) == [("a", "b", "x", 0.0), ("b", "a", "y", 2.0)]
    assert {r.id: r.props for r in graph.nodes.collect()} == {"a": {"age": "3"}, "b": {}}
    assert rows(T.read_graph_json(spark, path, zero_weight_as_one=True).edges, "weight") == [(1.0,), (2.0,)]
    m = put("m.json", json.dumps({"id": "p", "node_sequence": ["A", "B"], "edge_sequence": ["x"]}))
    assert T.read_meta_path_json(spark, m).node_types == ("A", "B")
    b = put("d.bin", np.array([1.5, -2.0], "<f8").tobytes())
    assert rows(T.read_binary(spark, b), "idx", "value") == [(0, 1.5), (1, -2.0)]
    i = put("i.bin", np.array([2**32 - 1], "<u4").tobytes())
    assert rows(T.read_binary(spark, i, "int"), "value") == [(2**32 - 1,)]
    with pytest.raises(Exception, match="divide"):
        T.read_binary(spark, put("odd.bin", b"12345")).collect()
    lv = put("levels.json", json.dumps({"l1": {"n": {"x": 1.0, "y": 2.0, "radius": 3.0, "pagerank": 0.5}}}))
    assert rows(T.read_levels_json(spark, lv)) == [("l1", "n", 1.0, 2.0, 3.0, 0.5)]


def test_writers(spark, tmp_path, rows):
    nodes = spark.createDataFrame([("a", "A", 2), ("b", "A", 2)], "id string, type string, degree bigint")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.5)], "src string, dst string, weight double")
    result = M.Homogeneous(nodes, edges, MetaPath(("A", "A"), ("x",)))
    read = lambda p: [r.value for r in spark.read.text(p).collect()]
    for name in ("out", "out.txt", "out.edgelist", "out.csv", "out.json"):
        sinks.write(result, str(tmp_path / name))
    assert sorted(read(str(tmp_path / "out.txt"))) == ["# 2 2", "a b 1.000000", "b a 2.500000"]
    assert rows(T.read_edges(spark, str(tmp_path / "out.txt"))) == rows(edges)
    assert sorted(read(str(tmp_path / "out.edgelist"))) == ["a b", "b a 2.5"]
    assert len(read(str(tmp_path / "out.json"))) == 4
    with pytest.raises(ValueError):
        sinks.write(result, str(tmp_path / "out.xml"))
    assign = spark.createDataFrame([("c0_l1_0", "b"), ("c0_l1_0", "a"), ("c0_l1_1", "c")], "comm string, node string")
    sinks.write_mapping(assign, str(tmp_path / "map"))
    found = {(r.comm, r.node) for r in T.read_mapping(spark, str(tmp_path / "map" / "*.txt")).collect()}
    assert found == {(r.comm, r.node) for r in assign.collect()}
    sinks.write_sketch_graph(spark.createDataFrame([("a", "b")], "u string, v string"), str(tmp_path / "sg"))
    assert read(str(tmp_path / "sg")) == ["n = 2", "m = 1", "a b"]


def test_identifiers(spark):
    df = spark.createDataFrame([("c0_l3_12",), ("leaf",), ("7",)], "id string")
    got = df.select(ids.level_of("id").alias("l"), ids.is_leaf("id").alias("leaf"), ids.number_of("id").alias("n")).collect()
    assert [(r.l, r.leaf, r.n) for r in got] == [(3, False, 12), (None, True, None), (None, True, None)]
    assert df.select(ids.community_id(2, F.lit(5)).alias("c")).first().c == "c0_l2_5"
    numbers = spark.createDataFrame([("10",), ("9",), ("100",)], "id string")
    assert sorted((r.n, r.id) for r in ids.dense_ids(numbers, "id").collect()) == [(0, "9"), (1, "10"), (2, "100")]


def test_generators(spark):
    e = R.erdos_renyi(spark, 60, 0.2)
    assert abs(e.count() / (60 * 59 / 2) - 0.2) < 0.06 and e.where("src >= dst").count() == 0
    assert R.erdos_renyi(spark, 60, 0.2).exceptAll(e).count() == 0
    assert R.random_sets(spark, 50, 3, 0.5).groupBy("set").count().count() == 3


def test_graph_access(spark, rows):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, type string")
    edges = spark.createDataFrame([("a", "b", "x", 2.0), ("b", "a", "y", 3.0)], "src string, dst string, etype string, weight double")
    g = Graph(nodes, edges)
    assert g.weight("a", "b") == 2.0 and g.weight("a", "a") == 0.0 and g.has_edge("b", "a") and not g.has_edge("a", "a")
    assert rows(g.neighbours("a")) == [("b", "x", 2.0), ("b", "y", 3.0)] and rows(g.neighbours("a", "x")) == [("b", "x", 2.0)]
    assert g.nodes_of("A").count() == 1 and g.edges_of("y").count() == 1


def test_replay(spark, tmp_path, rows):
    from metaweave.operators import louvain as L
    from metaweave.streaming import replay

    log = tmp_path / "log"
    log.mkdir()
    events = [{"move": i, "level": 0, "algorithm": "x", "node": n, "from_comm": n, "to_comm": c, "gain": 0.0, "modularity": 0.0, "timestamp": i} for i, (n, c) in enumerate([(1, 0), (2, 0), (1, 2)])]
    (log / "a.jsonl").write_text("\n".join(map(json.dumps, events)) + "\nnot json\n")
    moves = replay.read_moves(spark, str(log))
    assert moves.count() == 3
    nodes = spark.range(3).select(F.col("id").cast("int").alias("node"))
    assert rows(replay.states(moves, nodes, [0, 2]).where("step = 2"), "node", "comm") == [(0, 0), (1, 2), (2, 0)]
    canon = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "u int, v int, w double")
    q = dict(rows(replay.modularity_steps(moves, canon, [1])))
    want = L.modularity(canon, spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "node int, comm int")).first()[0]
    assert abs(q[1] - want) < 1e-12
    runs = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2), ("b", 0, 0.3)], "run string, step int, modularity double")
    assert rows(replay.padded(runs).where("run = 'b'"), "step", "modularity") == [(0, 0.3), (1, 0.3)]
    stream = replay.follow(spark, str(log)).writeStream.format("memory").queryName("followed").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert rows(spark.table("followed"), "node", "comm") == [(1, 2), (2, 0)]
