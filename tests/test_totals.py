"""Sums over walks by packed lists: the same as a join and a group by."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metaweave.model import Aggregation
from metaweave.operators import metapath as M
from metaweave.operators import totals as X
from metaweave.plans import queries as Q
from metaweave.sources import tables as T

FOLDS = {"n": ("sum", None, None), "s": ("sum", "x", "y"), "t": ("sum", "p", "q"), "high": ("max", "p", "q"), "low": ("min", "x", "y"), "one": ("max", "x", None)}
KINDS = {"n": "bigint", "s": "bigint", "t": "double", "high": "double", "low": "bigint", "one": "bigint"}


def _tables(spark, shift=0):
    draw = random.Random(4)
    held = sorted({(draw.randrange(30) + shift, draw.randrange(40)) for _ in range(600)})
    left = spark.createDataFrame([(a, m, 1 + a % 3, 0.1 * (a % 7) - 0.2) for a, m in held] + [(None, 3, 5, 1.0), (1, None, 5, 1.0)], "a bigint, m bigint, x bigint, p double")
    right = spark.createDataFrame([(m, b, 2 + b % 2, 1.0 + b % 5) for b, m in held] + [(3, None, 7, 1.0), (None, 1, 5, 1.0)], "m bigint, b bigint, y bigint, q double")
    return left, right


def _listed(df):
    return sorted(((r[0] is None, r[0], r[1] is None, r[1], *[round(v, 9) for v in r[2:]]) for r in df.collect()), key=lambda r: [str(v) for v in r])


@pytest.mark.parametrize("pairs, setting, shift, named", [
    (None, {}, 0, False), ("different", {"HEAVY": 0, "BLOCK": 900}, 1 << 40, False), ("ascending", {"NAMES": 0}, 0, True), (None, {"PIECE": 7}, 0, True),
], ids=str)
def test_totals_as_by_a_join(spark, monkeypatch, pairs, setting, shift, named):
    """Keys beyond 32 bits get codes, as names do."""
    for name, value in ({"LEAST": 50, "BLOCK": 4000} | setting).items():
        monkeypatch.setattr(X, name, value)
    left, right = _tables(spark, shift)
    if named:
        left, right = left.withColumn("a", F.concat(F.lit("N:"), F.col("a").cast("string"))), right.withColumn("b", F.concat(F.lit("N:"), F.col("b").cast("string")))
    got = X.totals(left, right, "m", "a", "b", FOLDS, pairs)
    assert _listed(got) == _listed(X.plain(left, right, "m", "a", "b", FOLDS, KINDS, pairs))


@pytest.mark.parametrize("piece, dense", [(1 << 21, 32), (1 << 21, 0), (7, 32), (100, 0), (100, 1 << 30)])
def test_pieces_and_cells_of_a_block(piece, dense):
    draw = random.Random(1)
    some = lambda most: [(draw.randrange(30) * draw.choice((1, most)), 1 + draw.randrange(3), draw.random()) for _ in range(draw.randrange(1, 9))]
    held = [(some(1), some(1000)) for _ in range(50)]
    lists = lambda rows, side, at: pa.array([[x[at] for x in r[side]] for r in rows], pa.list_(pa.float64() if at == 2 else pa.int32()))
    batch = lambda rows: pa.RecordBatch.from_arrays([lists(rows, i, j) for i in (0, 1) for j in range(3)], names=["_s", "x", "p", "_e", "y", "q"])
    wanted: dict = {}
    for mine, theirs in held:
        for s, x, p in mine:
            for e, y, q in theirs:
                wanted.setdefault((s, e), []).append((x, y, p, q))
    types = {n: "float64" if k == "double" else "int64" for n, k in KINDS.items()}
    found = list(X.add_up(iter([batch(held[:20]), batch(held[20:])]), ["x", "p"], ["y", "q"], FOLDS, types, None, piece, dense))
    got = {(r["_s"], r["_e"]): r for b in found for r in b.to_pylist()}
    assert got.keys() == wanted.keys() and sum(b.num_rows for b in found) == len(wanted)
    for key, w in wanted.items():
        r = got[key]
        assert (r["n"], r["s"], r["low"], r["one"]) == (len(w), sum(x * y for x, y, *_ in w), min(x * y for x, y, *_ in w), max(x for x, *_ in w))
        assert r["t"] == pytest.approx(sum(p * q for *_, p, q in w)) and r["high"] == max(p * q for *_, p, q in w)


def test_middles_of_spread_starts_are_packed(spark, monkeypatch):
    """Starts of all blocks share each middle: what a block gets are lists of numbers, not of structs."""
    monkeypatch.setattr(X, "LEAST", 50)
    left = spark.range(300).select((F.col("id") % 60).alias("a"), (F.col("id") % 5).alias("m"))
    found = X.totals(left, left.withColumnRenamed("a", "b"), "m", "a", "b", {"n": ("sum", None, None)})
    assert found.count() == 60 * 12
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_degrees_in_one_pass(spark, rows, tmp_path):
    """Degrees need no table of all pairs, and count only edges that are kept."""
    lines = sorted({(random.Random(i).randrange(12), i % 25, 1.0 + i % 4) for i in range(300)})
    spark.createDataFrame(lines, "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(12).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(25).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    graph = T.supply_graph(spark, str(tmp_path))
    for setting in (Aggregation(), Aggregation(min_weight=11.0), Aggregation(strategy="average"), Aggregation(normalisation="degree")):
        made = M.materialise(graph, T.SPS, setting=setting)
        wanted = M.with_degrees(M.node_set(M.endpoints(graph, T.SPS), T.SPS), made.edges)
        assert rows(made.nodes) == rows(wanted)
    assert "Window" not in M.materialise(graph, T.SPS).nodes._jdf.queryExecution().optimizedPlan().toString()


def test_moves_are_applied_to_one_table_of_ties(spark, monkeypatch):
    made = []
    monkeypatch.setattr(Q.T, "supplier_ties", lambda spark, sf_dir, make=T.supplier_ties: made.append(make(spark, sf_dir)) or made[-1])
    assert Q.l7_applied_moves(spark, "/root/testdata/sf0.001").count() == 10
    assert len(made) == 1


def test_lists_of_ascending_pairs_leave_out_what_lies_below(spark, monkeypatch):
    """Half of what is shipped: each list's ends up to the smallest of the block's starts."""
    monkeypatch.setattr(X, "FEW", 0)
    monkeypatch.setattr(X, "LEAST", 64)
    rows = spark.range(400).selectExpr("id div 20 AS m", "id * 37 % 400 AS s", "id % 5 AS x")
    ends = rows.withColumnsRenamed({"s": "e", "x": "y"})
    got = X.totals(rows, ends, "m", "s", "e", {"w": ("sum", "x", "y")}, "ascending")
    want = rows.join(ends, "m").where("s < e").groupBy("s", "e").agg({"*": "count"})
    assert got.count() == want.count() and got.join(want, ["s", "e"], "left_anti").isEmpty()
    held = rows.join(ends, "m").where("s < e").selectExpr("s", "e", "x * y AS w").groupBy("s", "e").sum("w")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, held.collect()))
    assert "_past" in got._jdf.queryExecution().optimizedPlan().toString()
