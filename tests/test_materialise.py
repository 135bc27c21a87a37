import math

import pytest
from pyspark.sql import functions as F

from metaweave.model import Aggregation, Graph, MetaPath, Traversal
from metaweave.operators import metapath as M
from metaweave.operators import validate as V
from metaweave.operators import weights as Wt

E = "src string, dst string, etype string, weight double"


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, t) for i, t in nodes.items()], "id string, type string")
    return Graph(n, spark.createDataFrame(edges, E))


def people(spark):
    pairs = {"paper1": "ab", "paper2": "bc", "paper3": "ac", "paper4": "da"}
    nodes = dict.fromkeys("abcd", "A") | dict.fromkeys(pairs, "P")
    edges = [e for p, who in pairs.items() for x in who for e in ((x, p, "writes", 1.0), (p, x, "writtenBy", 1.0))]
    return graph(spark, nodes, edges)


APA = MetaPath(("A", "P", "A"), ("writes", "writtenBy"))


def test_linear_path(spark, rows):
    g = graph(spark, {"a1": "A", "a2": "A", "p1": "P", "p2": "P"}, [("a1", "p1", "w", 1.0), ("a2", "p2", "w", 1.0)])
    found = M.instances(g, MetaPath(("A", "P"), ("w",)))
    assert found.count() == 2
    assert rows(M.coverage(M.endpoints(g, MetaPath(("A", "P"), ("w",))))) == [(2, 2, 2)]


def test_weights_multiply(spark, rows):
    g = graph(spark, {"a1": "A", "p1": "P", "p2": "P", "p3": "P"}, [("a1", "p1", "w", 2.0), ("p1", "p2", "c", 3.0), ("p1", "p3", "c", 1.5)])
    assert rows(M.instances(g, MetaPath(("A", "P", "P"), ("w", "c"))), "weight") == [(3.0,), (6.0,)]


def test_cycles(spark):
    g = graph(spark, {"a1": "A", "a2": "A", "p1": "P"}, [("a1", "p1", "w", 1.0), ("p1", "a2", "by", 1.0), ("a2", "a1", "c", 1.0)])
    path = MetaPath(("A", "P", "A", "A"), ("w", "by", "c"))
    assert M.instances(g, path).count() == 0
    assert M.instances(g, path, Traversal(allow_cycles=True)).count() == 1
    assert M.endpoints(g, path).count() == 0
    assert M.endpoints(g, path, Traversal(allow_cycles=True)).count() == 1


def test_branching_three_hops(spark, rows):
    g = graph(spark, dict(a="A", b="B", c="C", d1="D", d2="D"), [("a", "b", "x", 1.0), ("b", "c", "y", 1.0), ("c", "d1", "z", 1.0), ("c", "d2", "z", 1.0)])
    path = MetaPath(("A", "B", "C", "D"), ("x", "y", "z"))
    assert rows(M.materialise(g, path).edges) == [("a", "d1", 1.0), ("a", "d2", 1.0)]


def test_cap_and_length(spark):
    nodes = {f"a{i}": "A" for i in range(100)} | {f"p{i}": "P" for i in range(100)}
    edges = [(f"a{i}", f"p{i}", "w", 1.0) for i in range(100)] + [(f"p{i}", f"p{i - 1}", "c", 1.0) for i in range(1, 100)]
    g, path = graph(spark, nodes, edges), MetaPath(("A", "P", "P"), ("w", "c"))
    assert M.instances(g, path, Traversal(max_instances=50)).count() == 50
    assert M.endpoints(g, path, Traversal(max_instances=50)).count() == 50
    assert M.instances(g, path, Traversal(max_length=2)).count() == 0
    assert M.endpoints(g, path, Traversal(max_length=2)).count() == 0


def test_collaboration(spark, rows):
    found = M.materialise(people(spark), APA)
    assert found.nodes.count() == 4
    assert len(rows(found.edges)) == 8 and {w for *_, w in rows(found.edges)} == {1.0}
    checks = V.verify(people(spark), found, V.Limits(symmetric=True))
    assert checks.where("NOT passed AND severity = 'error'").count() == 0
    assert V.verification_summary(checks).agg(F.sum("checks")).first()[0] == 17


def test_citations(spark, rows):
    links = [(a, b) for a, b in ("12", "13", "23", "24", "34", "35", "45")]
    g = graph(spark, {f"p{i}": "P" for i in range(1, 6)}, [(f"p{a}", f"p{b}", "c", 1.0) for a, b in links])
    found = dict(((s, d), w) for s, d, w in rows(M.materialise(g, MetaPath(("P", "P", "P"), ("c", "c"))).edges))
    assert found == {("p1", "p3"): 1, ("p1", "p4"): 2, ("p1", "p5"): 1, ("p2", "p4"): 1, ("p2", "p5"): 2, ("p3", "p5"): 1}


def test_empty_and_self_path(spark):
    g = graph(spark, {"a1": "A", "p1": "P"}, [("a1", "p1", "writes", 1.0), ("p1", "a1", "writtenBy", 1.0)])
    empty = M.materialise(g, MetaPath(("A", "V"), ("publishedAt",)))
    assert (empty.nodes.count(), empty.edges.count()) == (0, 0)
    assert M.materialise(g, APA).nodes.count() == 0
    cyclic = M.materialise(g, APA, Traversal(allow_cycles=True))
    assert (cyclic.nodes.count(), cyclic.edges.count()) == (1, 0)


@pytest.mark.parametrize("strategy,want", [("count", 3), ("sum", 6), ("average", 2), ("maximum", 3), ("minimum", 1)])
def test_strategies(spark, rows, strategy, want):
    g = graph(spark, {"a1": "A", "a2": "A"}, [("a1", "a2", "k", w) for w in (2.0, 3.0, 1.0)])
    assert rows(M.materialise(g, MetaPath(("A", "A"), ("k",)), setting=Aggregation(strategy=strategy)).edges) == [("a1", "a2", want)]


def test_meeting(spark, rows):
    edges = [("a1", "v1", "at", 1.0), ("a2", "v1", "at", 1.0), ("a3", "v1", "at", 2.0), ("a1", "v2", "at", 1.5), ("a2", "v2", "at", 1.0)]
    g = graph(spark, dict.fromkeys(("a1", "a2", "a3"), "A") | dict.fromkeys(("v1", "v2"), "V"), edges)
    path = MetaPath(("A", "V"), ("at",))
    found = M.materialise(g, path, setting=Aggregation(mode="meeting", symmetric=True))
    assert {(s, d): w for s, d, w in rows(found.edges)} == {
        (a, b): w for x, y, w in (("a1", "a2", 2), ("a1", "a3", 1), ("a2", "a3", 1)) for a, b in ((x, y), (y, x))
    }
    assert {r[0] for r in rows(found.nodes)} == {"a1", "a2", "a3", "v1", "v2"}


def test_meeting_multiplicity(spark, rows):
    g = graph(spark, {"a1": "A", "a2": "A", "v1": "V"}, [("a1", "v1", "at", 1.0)] * 2 + [("a2", "v1", "at", 1.0)])
    path = MetaPath(("A", "V"), ("at",))
    assert rows(M.materialise(g, path, setting=Aggregation(mode="meeting")).edges, "weight") == [(4.0,)]
    assert rows(M.materialise(g, path, setting=Aggregation(mode="meeting", per_node_pair=True)).edges, "weight") == [(2.0,)]


def test_normalisations(spark):
    def norm(edges, how):
        df = spark.createDataFrame(edges, "src string, dst string, weight double")
        return {(r.src, r.dst): r.weight for r in Wt.normalise(df, Aggregation(normalisation=how)).collect()}

    got = norm([("a1", "a2", 4.0), ("a1", "a3", 2.0), ("a2", "a3", 6.0)], "degree")
    assert math.isclose(got["a1", "a2"], 4 / math.sqrt(60)) and math.isclose(got["a1", "a3"], 2 / math.sqrt(48)) and math.isclose(got["a2", "a3"], 6 / math.sqrt(80))
    assert norm([("a1", "a2", 10.0), ("a2", "a1", 5.0)], "max") == {("a1", "a2"): 1.0, ("a2", "a1"): 0.0}
    assert norm([("a", "b", 5.0), ("b", "c", 5.0)], "max") == {("a", "b"): 1.0, ("b", "c"): 1.0}
    z = norm([("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 3.0)], "zscore")
    assert [round(z[k], 6) for k in sorted(z)] == [-1.224745, 0.0, 1.224745]
    assert set(norm([("a", "b", 5.0)], "zscore").values()) == {0.0}


def test_weight_validity(spark):
    df = spark.createDataFrame([("a", "b", w) for w in (1.0, -1.0, float("nan"), float("inf"), None)], "src string, dst string, weight double")
    assert V.invalid_weights(df).count() == 4
    custom = Wt.custom_normalised(df, lambda e: F.col("weight") * 2)
    assert custom.count() == 2


def test_settings_are_checked():
    for bad in (dict(min_weight=-1.0), dict(max_edges=-1), dict(strategy="median"), dict(normalisation="custom")):
        with pytest.raises(ValueError):
            Aggregation(**bad)
    for bad in (((), ()), (("A",), ()), (("A", "B"), ()), (("A", " "), ("x",))):
        with pytest.raises(ValueError):
            MetaPath(*bad)
    assert APA.symmetric and len(APA) == 2 and str(APA) == "A --writes--> P --writtenBy--> A"


def test_batch_records_failures(spark):
    g = people(spark)
    bad = MetaPath(("A", "P"), ("writes",), "bad")
    object.__setattr__(bad, "edge_types", ())
    out, failed = M.materialise_many(g, [MetaPath(("A", "P", "A"), ("writes", "writtenBy"), "ok"), bad])
    assert out.where("path_id = 'ok'").count() == 8 and set(failed) <= {"bad"}


def test_validation(spark, rows):
    ok = people(spark)
    assert V.problems(ok).count() == 0
    dirty = graph(spark, {"a": "A", "b": "A", "lonely": "A", " ": "A"}, [("a", "b", "x", -1.0), ("a", "b", "x", 1.0), ("a", "a", "x", 1.0), ("a", "zz", "", 1.0)])
    found = {r[0] for r in rows(V.problems(dirty))}
    assert found == {"blank id", "fewer than two types", "unknown target", "blank edge type", "negative weight", "self loop", "duplicate edge", "isolated node"}
    assert V.missing_types(ok, APA).count() == 0 and V.traversable(ok, APA)
    assert rows(V.missing_types(ok, MetaPath(("V", "P"), ("writes",)))) == [("node type", "V")]
    assert rows(V.missing_types(ok, MetaPath(("A", "P"), ("cites",)))) == [("edge type", "cites")]
    assert not V.traversable(ok, MetaPath(("P", "A"), ("writes",)))
    with pytest.raises(ValueError):
        V.check_input(ok, MetaPath(("V", "P"), ("writes",)))


def test_missing_nodes(spark, rows):
    g = graph(spark, {"a": "A", "b": "A", "c": "A", "d": "A", "p": "P", "q": "P", "v": "V"}, [("a", "p", "w", 1.0), ("p", "b", "by", 1.0), ("c", "v", "w", 1.0), ("d", "q", "w", 1.0)])
    found = M.materialise(g, MetaPath(("A", "P", "A"), ("w", "by")))
    assert rows(V.missing_nodes(g, found)) == [("c", "no first step"), ("d", "no complete path")]


def test_estimates(spark):
    g = people(spark)
    assert M.estimate_instances(g, APA) == 4
    assert M.estimate_instances(g, MetaPath(("A", "V"), ("x",))) == 0
    assert M.estimate_memory(2, 3, 4) == 200 + 350 + 100 * 1024 * 1024
    assert M.feasible(g, APA)[0] and not M.feasible(g, APA, max_bytes=10)[0]
