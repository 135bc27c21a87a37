"""Concatenate and cut: all token documents as one stream, cut into windows of a fixed size.

Pass one tokenises every document once (a closing id follows) and writes the ids beside the
number of the task and the place within what that task wrote.  The token totals of the tasks
get distributed prefix sums, so that every document knows its global offset without any row
having moved.  Pass two reads the written ids and cuts at the multiples of ``capacity``:
nothing is shuffled for the table of pieces.  :func:`sequences` emits the windows that lie in
one stretch of rows whole; only the pieces at a stretch's ends, its boundary records, are
brought together by sequence.

The stream's last window is usually shorter than ``capacity``.  It is cut into powers of two,
largest first, which need no padding (``tail="powers"``), or left as one (``tail="short"``).

Defined cases: null text counts as empty, and an empty text has the closing id alone; repeated
rows are packed once each; null doc_ids are packed like others; an empty table gives an empty
result; other columns are ignored.  Long texts are cut, never dropped.  The order of the stream
is that of the tasks and of the rows they read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaweave.llm.common import kept, known_by, raw_texts, slices
from metaweave.llm.packing import CAPACITY, WordEncoder, vocabulary
from metaweave.plans.scratch import cut

END_ID = 1
#: Tasks whose totals are summed up together before the sums are.
TOGETHER = 1024
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
MEMBERS = "array<struct<doc_id: bigint, start: bigint, length: bigint, offset: bigint>>"


def token_rows(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``task, at, n, doc_id, ids``: the ids (little-endian, 16 bits where ``wide`` is false, else
    32) and where they start among those of the same task."""
    path = path or vocabulary()
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(f"encoder {path}", lambda: WordEncoder(path))
        task, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches, most=1 << 20):
            coded = [x + closing for x in encode(raw_texts(batch))]
            n = np.array([len(x) // 4 for x in coded], np.int64)
            ids, wide = [], []
            for x in coded:
                whole = np.frombuffer(x, "<u4")
                wide.append(bool(whole.max() >> 16))
                ids.append(x if wide[-1] else whole.astype("<u2").tobytes())
            arrays = [pa.array(np.full(len(n), task, np.int32)), pa.array(at + np.cumsum(n) - n), pa.array(n), batch.column("doc_id").cast(pa.int64()), pa.array(wide), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["task", "at", "n", "doc_id", "wide", "ids"])
            at += int(n.sum())

    return docs.select("doc_id", "text").mapInArrow(run, "task int, at bigint, n bigint, doc_id bigint, wide boolean, ids binary")


def task_starts(totals: DataFrame) -> DataFrame:
    """``task, first`` of ``task, n``: the tokens before each task, by sums of blocks of tasks."""
    blocks = totals.withColumn("block", F.expr(f"task div {TOGETHER}"))
    zero, until = F.lit(0), (W.unboundedPreceding, -1)
    whole = blocks.groupBy("block").agg(F.sum("n").alias("n"))
    before = whole.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(*until)), zero).alias("_block_first"))  # a row for 1024 tasks
    within = F.coalesce(F.sum("n").over(W.partitionBy("block").orderBy("task").rowsBetween(*until)), zero)
    return blocks.withColumn("_within", within).join(before, "block").select("task", (F.col("_block_first") + F.col("_within")).alias("first"))


class Windows:
    """Where a stream of ``total`` tokens is cut."""

    def __init__(self, total: int, capacity: int = CAPACITY, tail: str = "powers"):
        if tail not in ("powers", "short"):
            raise ValueError(f"tail must be 'powers' or 'short', not {tail!r}")
        self.capacity, self.full = capacity, total // capacity
        left, at, self.ends = total % capacity, self.full * capacity, []
        while left:
            size = 1 << left.bit_length() - 1 if tail == "powers" else left
            at, left = at + size, left - size
            self.ends.append(at)

    def of(self, position: int) -> tuple[int, int, int]:
        """Number, start and end of the window that holds a position."""
        k = position // self.capacity
        if k < self.full:
            return k, k * self.capacity, (k + 1) * self.capacity
        start = self.full * self.capacity
        for i, end in enumerate(self.ends):
            if position < end:
                return self.full + i, start, end
            start = end
        raise IndexError(position)

    def pieces(self, first: int, n: int) -> Iterator[tuple[int, int, int, int, int]]:
        """``start, length, window, offset, size of the window`` of the pieces of ``n`` tokens at ``first``."""
        at = first
        while at < first + n:
            k, start, end = self.of(at)
            stop = min(end, first + n)
            yield at - first, stop - at, k, at - start, end - start
            at = stop


def _placed(docs: DataFrame, path: str | None, end_id: int) -> tuple[DataFrame, int]:
    rows = cut(token_rows(docs, path, end_id), "tokens")
    totals = cut(rows.groupBy("task").agg(F.sum("n").alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    return known_by(rows, cut(task_starts(totals), "starts"), ["task"], "inner"), total


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(x).to_pylist() for x in ("first", "at", "n", "doc_id", "wide", "ids")))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, tail: str = "powers") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece."""
    rows, total = _placed(docs, path, end_id)
    windows = Windows(total, capacity, tail)
    types = [pa.int64()] * 7
    names = [x.split()[0] for x in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            out = []
            for first, at, n, doc, wide, raw in _read(batch):
                ids = _ids(raw, wide).tobytes()
                for start, length, k, offset, _ in windows.pieces(first + at, n):
                    out.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, k, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, types)], names=names)

    return rows.select("first", "at", "n", "doc_id", "wide", "ids").mapInArrow(run, PIECE)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, tail: str = "powers") -> DataFrame:
    """``sequence_id, ids, members``: the token ids of every sequence and whose they are."""
    rows, total = _placed(docs, path, end_id)
    windows = Windows(total, capacity, tail)
    shape = f"sequence_id bigint, size bigint, held bigint, at bigint, ids array<int>, members {MEMBERS}"
    names = ["sequence_id", "size", "held", "at", "ids", "members"]
    member = pa.struct([(x, pa.int64()) for x in ("doc_id", "start", "length", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the piece of a window that the rows so far hold: window, its size, first offset, ids, members
        now: list | None = None
        out: list[list] = []

        def take() -> pa.RecordBatch:
            ids = [np.concatenate(x[3]).astype("<i4") for x in out]
            columns = [
                pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x[2] for x in out], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                pa.array([[dict(zip(("doc_id", "start", "length", "offset"), m)) for m in x[4]] for x in out], pa.list_(member)),
            ]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches, "ids"):
            for first, at, n, doc, wide, raw in _read(batch):
                ids = _ids(raw, wide)
                for start, length, k, offset, size in windows.pieces(first + at, n):
                    if now and (now[0] != k or now[2] + sum(map(len, now[3])) != offset):
                        out.append(now)
                        now = None
                    now = now or [k, size, offset, [], []]
                    now[3].append(ids[start : start + length])
                    now[4].append((doc, start, length, offset))
                if len(out) >= 256:
                    yield take()
        if now:
            out.append(now)
        if out:
            yield take()

    found = cut(rows.select("first", "at", "n", "doc_id", "wide", "ids").mapInArrow(run, shape), "windows")
    whole = found.where("held = size").select("sequence_id", "ids", "members")
    parts = found.where("held < size").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids", "members"))).alias("h"))
    joined = parts.select("sequence_id", F.flatten(F.transform("h", lambda x: x["ids"])).alias("ids"), F.flatten(F.transform("h", lambda x: x["members"])).alias("members"))
    return whole.unionByName(joined)
