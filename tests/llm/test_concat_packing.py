"""Concatenate and cut, held against the tokenizer."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaweave.llm import concat_packing as cp
from metaweave.llm.packing import vocabulary

D = "doc_id bigint, text string, lang string"
TEXTS = [None, "", " \t\n", "one", "It's Ünï cödé — ß", "x" * 30000, "lorem ipsum, dolor! " * 2500, None, "one", *[f"w{i} some words {i * i}" for i in range(60)]]


def coded(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("capacity", "tail"), [(2048, "powers"), (64, "short"), (100, "powers")])
def test_pieces_and_sequences_hold_every_token_once(spark, capacity, tail):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "nobody's text", "en")]
    docs = spark.createDataFrame(rows, D).repartition(7).withColumns({"task": F.lit(1), "at": F.lit("x"), "ids": F.lit(2), "n": F.lit(3)})
    ids = {i: coded(t) for i, t, _ in rows}
    total = sum(map(len, ids.values()))
    got = cp.pack(docs, capacity=capacity, tail=tail).collect()
    held, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        held[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    assert set(pieces) == set(ids)
    for found, whole in [*((p, len(ids[i])) for i, p in pieces.items()), *((h, None) for h in held.values())]:
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert whole in (None, at)
    sizes = [sum(n for _, n in held[k]) for k in sorted(held)]
    assert sorted(held) == list(range(len(held))) and sum(sizes) == total
    assert sizes[: total // capacity] == [capacity] * (total // capacity)
    last = sizes[total // capacity :]
    assert last == sorted(last, reverse=True) and (all(n & (n - 1) == 0 for n in last) if tail == "powers" else len(last) <= 1)
    seen = cp.sequences(docs, capacity=capacity, tail=tail).collect()
    assert sorted(r.sequence_id for r in seen) == sorted(held)
    for r in seen:
        assert [x & 0xFFFFFFFF for x in r.ids] == [t for m in r.members for t in ids[m.doc_id][m.start : m.start + m.length]]
        assert [m.offset for m in r.members] == np.cumsum([0, *[m.length for m in r.members]])[:-1].tolist()
        assert len(r.ids) == sizes[r.sequence_id]


def test_repeated_rows_are_packed_once_each(spark):
    docs = spark.createDataFrame([(5, "same text", "en")] * 9, D)
    got = cp.pack(docs, capacity=4).collect()
    n = len(coded("same text"))
    assert sum(r.length for r in got) == 9 * n and {r.doc_tokens for r in got} == {n}


def test_starts_of_many_tasks(spark):
    n = {t: t * 7 % 13 for t in range(0, 5000, 3)}
    got = {r.task: r.first for r in cp.task_starts(spark.createDataFrame(list(n.items()), "task int, n bigint")).collect()}
    at, want = 0, {}
    for t in sorted(n):
        want[t], at = at, at + n[t]
    assert got == want


def test_empty_table_and_bad_tail(spark):
    empty = spark.createDataFrame([], D)
    assert cp.pack(empty).collect() == [] and cp.sequences(empty).collect() == []
    with pytest.raises(ValueError, match="tail"):
        cp.Windows(5, tail="x")
