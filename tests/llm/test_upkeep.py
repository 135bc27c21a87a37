"""Maintained aggregates against recomputing every batch, and their defined cases."""

import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metaweave.llm import upkeep

C = "g string, k string, batch int, v bigint, by int"
NONE = (0, 0, 0, None, None, None)


def figures(held):
    """Of a Counter of values."""
    values = sorted(v for v, n in held.items() if v is not None for _ in range(n))
    if not values:
        return (sum(held.values()), 0, 0, None, None, None)
    return (sum(held.values()), len(set(values)), sum(values), values[0], values[-1], values[(len(values) + 1) // 2 - 1])


def plain(changes, first, last, before=()):
    held = collections.defaultdict(collections.Counter)
    for g, k, v, by in before:
        held[g, k][v] += by
    out = []
    for b in range(first, last + 1):
        for key in {c[:2] for c in changes}:
            old = figures(+held[key])
            for _, _, _, v, by in (c for c in changes if c[:2] == key and c[2] == b):
                held[key][v] += by
            new = figures(+held[key])
            if new != old:
                out.append((b, *key, *(x for pair in zip(old, new) for x in pair)))
    return sorted(out, key=repr)


def random_changes(seed, n=700, batches=8, spread=300):
    """Rows enter and some leave later, in no order; groups and values may be null."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        key = (["a", "b", None, ""][int(rng.integers(0, 4)) if rng.random() < 0.6 else 0], ["x", None][int(rng.integers(0, 2))])
        v = None if rng.random() < 0.05 else int(rng.normal(0, spread))
        enter = int(rng.integers(0, batches))
        out.append((*key, enter, v, 1))
        if rng.random() < 0.7:
            out.append((*key, enter + int(rng.integers(0, 4)), v, -1))
    rng.shuffle(out)
    return [(*c[:2], int(c[2]), None if c[3] is None else int(c[3]), int(c[4])) for c in out]


@pytest.mark.parametrize(("seed", "width"), [(1, 32), (2, 1), (3, 1 << 40), (4, 7)])
def test_against_recomputing_every_batch(spark, seed, width):
    changes = random_changes(seed)
    df = spark.createDataFrame(changes, C).repartition(6).withColumns({"_value": F.lit("x"), "_by": F.lit("y"), "_shard": F.lit(1), "n_rows": F.lit(2)})
    got = upkeep.maintain(df, ["g", "k"], "batch", "v", "by", last=7, width=width)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(changes, 0, 7)


def test_batches_in_two_calls(spark):
    changes = random_changes(9)
    df = spark.createDataFrame(changes, C)
    early = upkeep.maintain(df, ["g", "k"], "batch", "v", "by", last=3)
    kept = upkeep.state(df.where("batch <= 3"), ["g", "k"], "v", "by")
    late = upkeep.maintain(df.where("batch > 3"), ["g", "k"], "batch", "v", "by", last=7, before=kept, first=4)
    got = sorted([*map(tuple, early.collect()), *map(tuple, late.collect())], key=repr)
    assert got == plain(changes, 0, 7)


def test_a_hot_group_is_many_shards_and_a_group_may_empty_and_return(spark):
    changes = [("a", "x", b, v, 1) for b in range(3) for v in range(0, 5000, 3)] + [("a", "x", 3, v, -3) for v in range(0, 5000, 3)]
    changes += [("a", "x", 5, 10**12, 2), ("a", "x", 5, -(10**12), 1), ("a", "x", 6, None, 1), ("a", "x", 7, None, -1), ("a", "x", 4, 5, 1), ("a", "x", 4, 5, -1)]
    got = upkeep.maintain(spark.createDataFrame(changes, C), ["g", "k"], "batch", "v", "by", last=7)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(changes, 0, 7)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 6), st.integers(1, 3), st.booleans(), st.floats(0, 1)), max_size=60))
def test_heaps(steps):
    shard, held = upkeep.Shard(), collections.Counter()
    for v, by, take, where in steps:
        by = -min(by, held[v]) if take else by
        shard.change(v, by)
        held[v] += by
        n, distinct, total, least, greatest, median = figures(+held)
        assert (shard.n, shard.distinct, shard.total, shard.least.top(), shard.greatest.top(), shard.median()) == (n, distinct, total, least, greatest, median)
        if n:
            rank = 1 + int(where * (n - 1))
            assert shard.at(rank) == sorted((+held).elements())[rank - 1]


def test_heaps_stay_bounded_and_what_is_not_there_cannot_leave():
    shard = upkeep.Shard()
    for i in range(3000):
        shard.change(i, 1)
        shard.median()
        if i >= 10:
            shard.change(i - 10, -1)
    assert shard.n == 10 and max(len(h.heap) for h in (shard.least, shard.greatest, shard.low, shard.high)) < 60
    with pytest.raises(ValueError, match="taken"):
        shard.change(5, -1)


def test_documents_come_and_go_by_their_id(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [None, "s", "hot", "hot"][i % 4], [None, "en"][i % 2], None if i % 11 == 0 else int(rng.integers(0, 90))) for i in range(600)]
    rows += [(None, "s", "en", 4), (17, "s", "en", 4), (17, "s", "en", 4), (-3, "s", "en", 10**6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint")
    changes = []
    for i, s, l, v in rows:
        h = zlib.crc32(b"" if i is None else str(i).encode())
        b, q = h % 20, h // 20 % 4
        key = (s or "", l or "")
        changes += [(*key, b, v, 1), (*key, b + q, v, -1)]
        if q % 3 == 0:
            changes.append((*key, b + q, None if v is None else v + q, 1))
    got = upkeep.maintain(upkeep.document_changes(docs), ["source", "lang"], "batch", "n_chars", "by", last=19).collect()
    assert sorted(map(tuple, got), key=repr) == plain(changes, 0, 19)


def test_empty_table(spark):
    assert upkeep.maintain(spark.createDataFrame([], C), ["g", "k"], "batch", "v", "by", last=3).collect() == []
