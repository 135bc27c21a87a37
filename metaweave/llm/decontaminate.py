"""Benchmark decontamination with one Aho-Corasick automaton.

Every run of ``window`` consecutive words of a benchmark item is a pattern.  The automaton
holds the patterns as normalised text with a space on each side, and each document is
normalised and scanned once; the end of a match is mapped to a word number and, for the
reported spans, to character offsets of the original text.

Normalising: A-Z become lower case; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
An item with fewer than ``window`` words, but at least one, is one pattern.

Defined cases: null and empty texts have no words; items without words have no pattern; an
item id that is null is reported as "null"; repeated items and equal windows count for
every item that holds them; extra columns are ignored; the output has one row per input
row, so repeated document rows stay repeated.

The benchmark is the only broadcast.  Its size is checked first and a larger one than
``max_benchmark_bytes`` is refused with a ValueError: split it and unite the results.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.llm.common import kept, raw_texts, slices

WINDOW = 10
MAX_BENCHMARK_BYTES = 32 << 20

_LOWER = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = (
    "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, "
    "spans array<struct<start:int,end:int>>"
)


def normalised_words(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER).split()


def patterns(items: list[tuple[str, bytes]], window: int = WINDOW) -> dict[str, tuple[int, tuple[str, ...]]]:
    """pattern text -> (its number of words, ids of the items that hold it)."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, raw in items:
        words = normalised_words(raw)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            text = " " + b" ".join(words[i : i + size]).decode() + " "
            found.setdefault(text, (size, set()))[1].add(item)
    return {k: (n, tuple(sorted(ids))) for k, (n, ids) in found.items()}


def build(found: dict[str, tuple[int, tuple[str, ...]]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for text, value in found.items():
        automaton.add_word(text, value)
    automaton.make_automaton()
    return automaton


@dataclass
class Scanned:
    n_words: int
    n_hit: int
    items: list[str]
    spans: list[dict[str, int]]


def scan_text(automaton: ahocorasick.Automaton, raw: bytes) -> Scanned:
    words = normalised_words(raw)
    if not words or not len(automaton):
        return Scanned(len(words), 0, [], [])
    norm = b" ".join(words).decode()
    items: set[str] = set()
    ends: list[int] = []
    sizes: list[int] = []
    for end, (size, ids) in automaton.iter(f" {norm} "):
        ends.append(end)
        sizes.append(size)
        items.update(ids)
    if not ends:
        return Scanned(len(words), 0, [], [])
    closes = np.cumsum(np.fromiter((len(w) + 1 for w in norm.split(" ")), np.int64, len(words)))
    last = np.searchsorted(closes, np.asarray(ends))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, last - np.asarray(sizes) + 1, 1)
    np.add.at(change, last + 1, -1)
    hit = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    text = raw.decode()
    at = [m.span() for m in _WORD.finditer(text)]
    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]
    return Scanned(len(words), int(hit.sum()), sorted(items), spans)


def _automaton_of(spark: SparkSession, benchmark: DataFrame, window: int, max_benchmark_bytes: int) -> Callable[[], ahocorasick.Automaton]:
    """What gives the automaton in a task; it is built once a worker from broadcast patterns."""
    held = benchmark.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    if held > max_benchmark_bytes:
        raise ValueError(f"the benchmark has {held} bytes of text; at most {max_benchmark_bytes} are broadcast")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").collect()
    found = spark.sparkContext.broadcast(patterns([(r["i"], (r["text"] or "").encode()) for r in rows], window))
    name = uuid.uuid4().hex

    return lambda: kept(name, lambda: build(found.value))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_benchmark_bytes: int = MAX_BENCHMARK_BYTES,
) -> DataFrame:
    """One row per document: word counts, items found, and hit spans in the original text."""
    get = _automaton_of(docs.sparkSession, benchmark, window, max_benchmark_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = get()
        for batch in slices(batches):
            got = [scan_text(automaton, raw) for raw in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([x.n_words for x in got], pa.int64()),
                    pa.array([x.n_hit for x in got], pa.int64()),
                    pa.array([x.items for x in got], pa.list_(pa.string())),
                    pa.array([x.spans for x in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_benchmark_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """The documents that hold no window of any item, with their columns unchanged; no shuffle."""
    get = _automaton_of(docs.sparkSession, benchmark, window, max_benchmark_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = get()
        for batch in slices(batches):
            yield batch.filter(pa.array([not scan_text(automaton, raw).n_hit for raw in raw_texts(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
