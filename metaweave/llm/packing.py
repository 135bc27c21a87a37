"""Best-fit packing of token documents into sequences of a fixed capacity.

Documents are tokenised (a closing id follows each), cut into pieces of at most
``capacity`` tokens, and the pieces are packed by bulk-synchronous best fit, longest first.

Range sort: pieces are range-partitioned by (length, doc_id, piece) and get a distributed
rank within their length.  Lengths and gaps are integers up to ``capacity``, so the sorted
sequences of unplaced pieces and of open gaps are runs of equal sizes.  A sweep takes the
longest pieces left and the successor of their length among the gaps (the tightest that
fits), gives the i-th piece the i-th gap by rank, updates those gaps in bulk and repeats;
where no gap fits, the needed sequences are opened at once.  The plan of the sweeps is a
list of rank intervals whose size depends on ``capacity`` only, never on the corpus; it is
broadcast and every piece finds its interval in one pass.  The result is that of
best-fit decreasing over the whole corpus.

Defined cases: null text counts as empty, and an empty text has the closing id alone;
repeated rows are packed once each; null doc_ids are packed like others; an empty table
gives an empty result; extra columns are ignored.  Very long texts are cut, never dropped.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaweave.llm.common import kept, raw_texts, slices
from metaweave.plans.scratch import cut

CAPACITY = 2048
END_ID = 0
#: Distinct words whose ids a worker keeps; in fewer, rare words drive out frequent ones too often.
WORDS_KEPT = 1 << 19
#: Words that are encoded as one text.
TOGETHER = 256

#: Letters and then ASCII marks: the tokenizer never joins the two.
_AFFIX = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)")
#: The tokenizer's pieces of a word of ASCII in lower case.
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def _plain(word: str) -> bool:
    """Letters only, also after normalising: one piece to the tokenizer."""
    return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Numbers(dict):
    """Words by number; a word that is asked for the first time gets the next and is noted."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` one after the other."""
    return flat[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


class WordEncoder:
    """Ids of a text by the tokenizer, which splits at white space, one distinct word at a time.

    A text that spells a special token is encoded whole; a spelling that is one only in lower
    case isn't special.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) or rb"(?!)")
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.ends = np.array([x is not None and x.endswith("</w>") for x in names])
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.starts = self.sizes = np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, "<u4"), 0

    def _put(self, numbers: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        end = self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(max(end, 2 * len(self.flat)) - self.used, "<u4")))
        self.flat[self.used : end] = ids
        self.starts[numbers], self.sizes[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used = end

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast([w.decode() for w in texts], add_special_tokens=False)]

    def _put_alone(self, words: list[bytes]) -> None:
        if words:
            coded = self._encode(words)
            self._put([self.numbers[w] for w in words], np.concatenate(coded), np.array([len(x) for x in coded], np.int64))

    def _put_together(self, words: list[bytes]) -> None:
        """Plain words are one piece each, so they are encoded many to a text and told apart by
        the marks of word ends, which halves the cost of a word."""
        chunks = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for chunk, ids in zip(chunks, self._encode([b" ".join(c) for c in chunks])):
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(chunk):
                self._put([self.numbers[w] for w in chunk], ids, np.diff(ends, prepend=-1))
            else:
                self._put_alone(chunk)

    def _learn(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        easy, hard, made, counts, parts = [], [], [], [], []
        for w in fresh:
            if w.isalpha() or not w.isascii() and _plain(w.decode()):
                easy.append(w)
                continue
            if w.isascii():
                pieces = _PIECES.findall(w)
            elif (m := _AFFIX.fullmatch(w)) and _plain(m[1].decode()):
                pieces = m.groups()
            else:
                pieces = ()
            if len(pieces) > 1:
                made.append(w)
                counts.append(len(pieces))
                parts += pieces
            else:
                hard.append(w)
        known = self.numbers
        parts = [known[w] for w in parts]  # pieces may be new themselves
        for w in known.fresh:
            (easy if w.isalpha() or w[0] >= 0x80 else hard).append(w)
        known.fresh = []
        grow = np.zeros(len(known) - len(self.sizes), np.int64)
        self.starts, self.sizes = np.concatenate((self.starts, grow)), np.concatenate((self.sizes, grow))
        self._put_together(easy)
        self._put_alone(hard)
        if parts:
            parts = np.array(parts, np.int64)
            sizes = self.sizes[parts]
            whole = np.add.reduceat(sizes, np.cumsum([0, *counts[:-1]]))
            self._put([known[w] for w in made], _gather(self.flat, self.starts[parts], sizes), whole)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        if len(self.numbers) > WORDS_KEPT:
            self._clear()
        split = [raw.lower().split() for raw in texts]
        counts = [len(x) for x in split]
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        del split
        if self.numbers.fresh:
            self._learn()
        sizes = self.sizes[at]
        ids = _gather(self.flat, self.starts[at], sizes).tobytes()
        ends = np.concatenate(([0], 4 * np.cumsum(sizes)))[np.cumsum([0, *counts])].tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:])]
        for i, raw in enumerate(texts):
            if self.special.search(raw):
                self.tokenizer.encode_special_tokens = False
                out[i] = self._encode([raw])[0].tobytes()
                self.tokenizer.encode_special_tokens = True
        return out


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    path = path or vocabulary()
    closing = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(f"encoder {path}", lambda: WordEncoder(path))
        for batch in slices(batches, most=1 << 20):
            rows: list[tuple] = []
            ids: list[bytes] = []
            for doc, coded in zip(batch.column("doc_id").to_pylist(), encode(raw_texts(batch))):
                coded += closing
                n = len(coded) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    part = coded[4 * start : 4 * (start + capacity)]
                    rows.append((doc, k, start, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(part)
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            if with_ids:
                ends = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(["ids"] if with_ids else [])])

    shape = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", "text").mapInArrow(run, shape + (", ids array<int>" if with_ids else ""))


def sweeps(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rank intervals ``(length, first rank, how many, first sequence, offset)`` and the number of sequences."""
    runs: dict[int, deque[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    out = []
    opened = 0

    def add(gap: int, first: int, many: int) -> None:
        if gap not in runs:
            runs[gap] = deque()
            bisect.insort(open_gaps, gap)
        if runs[gap] and sum(runs[gap][-1]) == first:
            first, many = runs[gap][-1][0], runs[gap].pop()[1] + many
        runs[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(open_gaps, length)
            if i == len(open_gaps):
                need = -(-left // (capacity // length))
                add(capacity, opened, need)
                opened += need
                continue
            gap = open_gaps[i]
            first, many = runs[gap].popleft()
            take = min(left, many)
            if take < many:
                runs[gap].appendleft((first + take, many - take))
            elif not runs[gap]:
                del runs[gap], open_gaps[i]
            out.append((length, rank, take, first, capacity - gap))
            if gap > length:
                add(gap - length, first, take)
            rank += take
            left -= take
    return out, opened


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``: the place among the rows of equal length, from 0."""
    keys = ["length", "doc_id", "piece"]
    ranged = cut(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = W.partitionBy("_part", "length").orderBy("doc_id", "piece")
    return (
        ranged.join(F.broadcast(starts), ["_part", "length"])  # partitions + lengths rows at most
        .withColumn("rank", F.row_number().over(within) + F.col("_first") - 1)
        .drop("_part", "_first")
    )


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (with doc_id, piece, length) plus ``sequence_id`` and ``offset``."""
    spark: SparkSession = rows.sparkSession
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = sweeps(counts, capacity)
    shape = "length bigint, _a bigint, _n bigint, _seq bigint, offset bigint"
    intervals = spark.createDataFrame(plan, shape)
    at = ranked(rows)
    return at.join(
        F.broadcast(intervals), (at["length"] == intervals["length"]) & (at["rank"] >= F.col("_a")) & (at["rank"] < F.col("_a") + F.col("_n"))
    ).select(*[at[c] for c in rows.columns], (F.col("_seq") + F.col("rank") - F.col("_a")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece."""
    return pack_pieces(cut(pieces(docs, path, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, ids, members``: the token ids of every sequence, ready to train on."""
    rows = cut(pieces(docs, path, capacity, with_ids=True), "pieces")
    placed = pack_pieces(rows, capacity)
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return placed.groupBy("sequence_id").agg(held.alias("h")).select(
        "sequence_id",
        F.flatten(F.transform("h", lambda x: x["ids"])).alias("ids"),
        F.transform("h", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("members"),
    )
