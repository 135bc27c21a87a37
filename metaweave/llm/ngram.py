"""N-gram language model in a sharded, memory-mapped Elias-Fano trie.

Level 1 holds the hashes of all training tokens in order; a token's id is its place.  Level
k holds, under each context (a node of level k-1, by its place), the ids of the tokens that
follow it.  Every level is cut into shards by key range; a shard is one file in the shared
folder whose sections are memory-mapped by the tasks that score:

* contexts, child pointers and children as Elias-Fano sequences (children are monotone
  within and across contexts because they are coded relative to their context's rank);
* quantised log10 of the discounted probability of each child and of the back-off weight
  of each context.

A query finds the shard by its key, the context by successor search, its children through
the pointers, and the child by successor search between them.

Smoothing is interpolated absolute discounting down to the add-half unigram:
``p(w|ctx) = max(c - D, 0) / c(ctx) + backoff(ctx) * p(w|shorter ctx)``, with D from the
n-grams seen once and twice.  Every n-gram is kept, those seen once too.  Counting is over all
training documents and all their tokens.

Tokens: A-Z become lower case, words are ``[^\\x20\\x09-\\x0D]+``, then one end per text.
Documents whose crc32(doc_id as text) mod ``folds`` equals ``held`` don't train.

Defined cases: null text counts as empty (the end alone); a null doc_id trains and is never
held out; repeated rows count each time; without training documents every unknown token
has probability 1 (base and score 0); extra columns are ignored; an empty table gives an
empty result.  A level may have 2**31 nodes at most; beyond that an OverflowError says so.
"""

from __future__ import annotations

import json
import mmap
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.llm.common import fold, forget_shuffles, kept, raw_texts, slices
from metaweave.plans.scratch import cut, release, scratch_path

ORDER = 3
SHARD_NODES = 2_000_000
#: Steps of the probability grid, from 10**-FLOOR to 1.
GRID, FLOOR = 4095, 10.0
WORDS_KEPT = 1 << 19
#: N-grams that a task gathers before it hands them on, and that one of the tasks which add up has in hand.
HELD_KEYS, PART_KEYS = 1_000_000, 2_000_000
#: Keys looked at for each edge between ranges of n-grams.
EDGE_KEYS = 64
#: Of a text, in the mean, for the number of parts that words are counted in.
BYTES_A_TOKEN = 6
_U = np.uint64
#: Turns the order of signed longs into that of unsigned ones.
_SIGN = _U(1 << 63)
#: The end token hashes apart from every word, because no word holds a space.
END = b" end"

_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_b, _k] = _i


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.rint((np.clip(np.log10(p), -FLOOR, 0) + FLOOR) * (GRID / FLOOR)).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (code.astype(np.float64) * (FLOOR / GRID) - FLOOR)


# ---------------------------------------------------------------- Elias-Fano


def ef_build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Sections of a monotone sequence of values below ``universe``."""
    values = values.astype(_U)
    n = len(values)
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = (values >> _U(low_bits)).astype(np.int64)
    n_bits = n + (max(universe - 1, 0) >> low_bits) + 1
    bits = np.zeros(-(-(n_bits + 1) // 512) * 512, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(_U)
    ones = np.bitwise_count(words).reshape(-1, 8).sum(axis=1)
    rank = np.concatenate(([0], np.cumsum(ones))).astype(np.uint32 if n < 1 << 32 else _U)
    if low_bits:
        packed = np.zeros((n, low_bits), np.uint8)
        for i in range(low_bits):
            packed[:, i] = (values >> _U(i)).astype(np.uint8) & 1
        low = np.packbits(packed.ravel(), bitorder="little")
        low = np.concatenate((low, np.zeros(16 + -len(low) % 8, np.uint8))).view(_U)
    else:
        low = np.zeros(2, _U)
    return {"words": words, "rank": rank, "low": low, "meta": np.array([n, low_bits], np.int64)}


class EF:
    """Reads the sections of :func:`ef_build`, wherever they lie."""

    def __init__(self, sections: dict[str, np.ndarray]):
        self.words, self.rank, self.low = sections["words"], sections["rank"], sections["low"]
        self.n, self.low_bits = map(int, sections["meta"])
        self._mask = _U((1 << self.low_bits) - 1)
        self._zeros: np.ndarray | None = None
        self._last: np.uint64 | None = None

    def _pick(self, block: np.ndarray, left: np.ndarray, flip: bool) -> np.ndarray:
        """Bit position of the ``left``-th one (or zero) of each 512-bit block."""
        at = block.astype(np.int64) * 8
        left = left.astype(np.int64)
        end = at + 7
        for _ in range(7):
            w = self.words[at]
            c = np.bitwise_count(~w if flip else w).astype(np.int64)
            go = (left >= c) & (at < end)
            left = np.where(go, left - c, left)
            at = at + go
        w = self.words[at]
        if flip:
            w = ~w
        shift = np.zeros(len(at), np.int64)
        for step in (32, 16, 8):
            c = np.bitwise_count((w >> shift.astype(_U)) & _U((1 << step) - 1)).astype(np.int64)
            go = left >= c
            left = np.where(go, left - c, left)
            shift += go * step
        byte = ((w >> shift.astype(_U)) & _U(255)).astype(np.int64)
        return at * 64 + shift + _SELECT[byte, np.minimum(left, 7)]

    def select1(self, i: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.rank, i, "right") - 1
        return self._pick(block, i - self.rank[block].astype(np.int64), False)

    def select0(self, i: np.ndarray) -> np.ndarray:
        if self._zeros is None:
            self._zeros = np.arange(len(self.rank), dtype=np.int64) * 512 - self.rank.astype(np.int64)
        block = np.searchsorted(self._zeros, i, "right") - 1
        return self._pick(block, i - self._zeros[block], True)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(_U)
        out = self.low[word] >> shift
        over = (bit & 63) + self.low_bits > 64
        if over.any():
            out[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
        return out & self._mask

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self.select1(i) - i).astype(_U) << _U(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Place of each value of ``x``, by successor search, or -1; within [first, last) if given."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        if self._last is None:
            self._last = self.access(np.array([self.n - 1]))[0]
        beyond = x > self._last
        if beyond.any():
            out = np.full(len(x), -1, np.int64)
            inside = np.flatnonzero(~beyond)
            out[inside] = self.find(x[inside], *(None if y is None else y[inside] for y in (first, last)))
            return out
        high = (x >> _U(self.low_bits)).astype(np.int64)
        low = x & self._mask
        a = np.where(high > 0, self.select0(np.maximum(high - 1, 0)) - np.maximum(high - 1, 0), 0)
        b = self.select0(high) - high
        if first is not None:
            a, b = np.maximum(a, first), np.minimum(b, last)
        end = b.copy()
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        out = np.full(len(x), -1, np.int64)
        live = np.flatnonzero(a < end)
        out[live] = np.where(self._low(a[live]) == low[live], a[live], -1)
        return out


# ---------------------------------------------------------------- shards


def pack_sections(sections: dict[str, np.ndarray]) -> tuple[bytes, str]:
    """One file and the directory of its sections."""
    out, where, at = [], {}, 0
    for name, x in sections.items():
        pad = -at % 64
        raw = np.ascontiguousarray(x).tobytes()
        out += [b"\0" * pad, raw]
        where[name] = [at + pad, len(x), x.dtype.str]
        at += pad + len(raw)
    return b"".join(out), json.dumps(where)


def map_sections(path: str, directory: str) -> dict[str, np.ndarray]:
    store, base = pafs.FileSystem.from_uri(path)
    if isinstance(store, pafs.LocalFileSystem):
        with open(base, "rb") as f:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with store.open_input_file(base) as f:
            held = f.read()
    return {k: np.frombuffer(held, dtype, n, at) for k, (at, n, dtype) in json.loads(directory).items()}


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def _group(sections: dict[str, np.ndarray], name: str) -> EF:
    return EF({k.partition(".")[2]: v for k, v in sections.items() if k.startswith(name + ".")})


@dataclass
class Shard:
    level: int
    path: str
    directory: str
    first: int
    last_context: int
    nodes: int
    offset: int = 0
    #: path and directory of the file of probabilities
    scores: tuple[str, str] | None = None
    #: back-off weights of contexts that go on in another shard
    edges: dict[int, float] = field(default_factory=dict)
    opened: dict = field(default_factory=dict, repr=False, compare=False)

    def open(self) -> dict:
        if not self.opened:
            sections = map_sections(self.path, self.directory) | (map_sections(*self.scores) if self.scores else {})
            names = ("hashes",) if self.level == 1 else ("contexts", "pointers", "children")
            self.opened = {n: _group(sections, n) for n in names} | {k: v for k, v in sections.items() if "." not in k}
        return self.opened

    def __getstate__(self):
        return {**self.__dict__, "opened": {}}


@dataclass
class Trie:
    levels: list[list[Shard]]
    tokens: int = 0
    distinct: int = 0

    def _route(self, level: int, keys: np.ndarray) -> Iterator[tuple[Shard, slice]]:
        """Sorted keys, cut by shard."""
        shards = self.levels[level - 1]
        edges = np.searchsorted(keys, np.array([s.first for s in shards[1:]], _U)) if len(shards) > 1 else []
        ends = [0, *map(int, edges), len(keys)]
        for shard, a, b in zip(shards, ends, ends[1:]):
            if a < b:
                yield shard, slice(a, b)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places in level 1, or -1."""
        order = np.argsort(hashes)
        keys = hashes[order]
        out = np.full(len(keys), -1, np.int64)
        for shard, part in self._route(1, keys):
            at = shard.open()["hashes"].find(keys[part])
            out[order[part]] = np.where(at >= 0, at + shard.offset, -1)
        return out

    def counts(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Training counts of nodes of a level; 0 for -1."""
        out = np.zeros(len(nodes), np.int64)
        shards = self.levels[level - 1]
        if len(shards) == 1:
            return np.where(nodes >= 0, shards[0].open()["counts"][np.maximum(nodes, 0)], 0).astype(np.int64)
        which = np.searchsorted(np.array([s.offset for s in shards], np.int64), nodes, "right") - 1
        for i in np.flatnonzero(np.bincount(which + 1, minlength=len(shards) + 1)[1:]):
            own = np.flatnonzero(which == i)
            out[own] = shards[i].open()["counts"][nodes[own] - shards[i].offset]
        return out

    def look(self, level: int, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node, discounted probability and back-off weight of each (context, token).

        Without children the weight is 1; without a node the probability is 0.
        """
        n = len(context)
        node, prob, back = np.full(n, -1, np.int64), np.zeros(n), np.ones(n)
        valid = np.flatnonzero(context >= 0)
        if level > len(self.levels) or not len(valid):
            return node, prob, back
        keys = (context[valid].astype(_U) << _U(32)) | np.where(token[valid] >= 0, token[valid], (1 << 32) - 1).astype(_U)
        unique, inverse = np.unique(keys, return_inverse=True)
        u_node, u_prob, u_back = np.full(len(unique), -1, np.int64), np.zeros(len(unique)), np.ones(len(unique))
        for shard, part in self._route(level, unique):
            s = shard.open()
            ctx, tok = unique[part] >> _U(32), unique[part] & _U(0xFFFFFFFF)
            heads, head_of = np.unique(ctx, return_inverse=True)
            rank = s["contexts"].find(heads)
            has = rank >= 0
            first, last = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
            first[has] = s["pointers"].access(rank[has]).astype(np.int64)
            last[has] = s["pointers"].access(rank[has] + 1).astype(np.int64)
            weight = np.ones(len(heads))
            weight[has] = restore(s["back"][rank[has]])
            for edge, value in shard.edges.items():
                weight[heads == _U(edge)] = value
            live = np.flatnonzero(has[head_of] & (tok < _U(int(s["width"][0]))))
            x = rank[head_of[live]].astype(_U) * _U(int(s["width"][0])) + tok[live]
            at = s["children"].find(x, first[head_of[live]], last[head_of[live]])
            hit = at >= 0
            place = np.arange(part.start, part.stop)
            u_back[part] = weight[head_of]
            u_node[place[live[hit]]] = at[hit] + shard.offset
            u_prob[place[live[hit]]] = restore(s["prob"][at[hit]])
        node[valid], prob[valid], back[valid] = u_node[inverse], u_prob[inverse], u_back[inverse]
        return node, prob, back


class Reader:
    """Token ids of texts; remembers the words it has looked up."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all tokens, ends included, and where each text starts."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        words: list[bytes] = []
        starts = []
        for raw in texts:
            starts.append(len(words))
            words += raw.lower().split()
            words.append(END)
        fresh = [w for w in set(words) if w not in self.known]
        if fresh:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in fresh], _U) ^ _SIGN
            self.known.update(zip(fresh, self.trie.ids(hashes).tolist() if self.trie.levels else [-1] * len(fresh)))
        known = self.known
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), np.array(starts, np.int64)


def before_each(node: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The node of the token before each token of the same text, or -1."""
    out = np.full_like(node, -1)
    out[1:] = node[:-1]
    out[starts] = -1
    return out


# ---------------------------------------------------------------- counting and building

_PAIRS = "key bigint, n bigint"
_BLOCKS = "part int, rows int, keys binary, counts binary"


def pack_block(keys: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as the bytes of their steps, by significance, which compress; and counts."""
    steps = np.diff(keys, prepend=np.int64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), _narrowest(n).tobytes()


def unpack_block(rows: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, rows).T).view(np.int64)
    return np.cumsum(steps.ravel()), np.frombuffer(counts, f"<u{len(counts) // rows}").astype(np.int64)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their counts."""
    keys = np.concatenate([k for k, _ in held])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([c for _, c in held])[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def _blocks(keys: np.ndarray, n: np.ndarray, parts: int | np.ndarray) -> pa.RecordBatch:
    """A block for each of the parts that the ascending keys hash to, or of the ranges between edges."""
    if isinstance(parts, np.ndarray):
        part = np.searchsorted(parts, keys, "right")
    else:
        part = ((keys.view(_U) * _U(0x9E3779B97F4A7C15)) >> _U(33)) % _U(parts)
        order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
        keys, n, part = keys[order], n[order], part[order]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ends = np.append(first[1:], len(keys))
    packed = [pack_block(keys[a:b], n[a:b]) for a, b in zip(first, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first].astype(np.int32)), pa.array((ends - first).astype(np.int32)), pa.array([k for k, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())],
        names=["part", "rows", "keys", "counts"],
    )


def sum_blocks(blocks: DataFrame, parts: int) -> DataFrame:
    """``key, n`` of all keys.

    A part holds about ``PART_KEYS`` keys, all of which its task has in hand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpack_block(*(batch.column(c)[i].as_py() for c in ("rows", "keys", "counts"))) for batch in batches for i in range(batch.num_rows)]
        if not held:
            return
        keys, n = _merged(held)
        held.clear()
        for a in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 17)]), pa.array(n[a : a + (1 << 17)])], names=["key", "n"])

    return blocks.repartitionById(parts, "part").drop("part").mapInArrow(run, _PAIRS)


def _count_words(train: DataFrame, parts: int) -> DataFrame:
    """Hashes of words, in signed order, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            keys = np.array([xxhash.xxh64_intdigest(w) for w in held], _U).view(np.int64)
            n = np.fromiter(held.values(), np.int64, len(held))
            held.clear()
            return _blocks(*_merged([(keys, n)]), parts)

        for batch in slices(batches, most=4 << 20):
            texts = raw_texts(batch)
            for raw in texts:
                held.update(raw.lower().split())
            held[END] += len(texts)
            if len(held) > WORDS_KEPT:
                yield out()
        if held:
            yield out()

    return sum_blocks(train.select("text").mapInArrow(run, _BLOCKS), parts)


IDS = "doc_id bigint, train boolean, ids array<int>"


def token_ids(docs: DataFrame, trie: Trie, train: Column) -> DataFrame:
    """``doc_id, train, ids``: every text as places in level 1 (-1: unknown), ends included."""
    shared, name = docs.sparkSession.sparkContext.broadcast(trie), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = kept(name, lambda: Reader(shared.value))
        for batch in slices(batches, most=4 << 20):
            ids, starts = read(raw_texts(batch))
            offsets = np.append(starts, len(ids)).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("train"), held], names=["doc_id", "train", "ids"])

    return docs.select("doc_id", train.alias("train"), "text").mapInArrow(run, IDS)


def _id_slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of about ``most`` tokens, with their ids and where each text starts."""
    kept(None, lambda: None)  # a worker that has read texts needs its words no more
    for batch in batches:
        lists = batch.column("ids")
        offsets = np.asarray(lists.offsets)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            ids = np.asarray(lists.values)[offsets[at] : offsets[end]].astype(np.int64)
            yield batch.slice(at, end - at), ids, (offsets[at:end] - offsets[at]).astype(np.int64)
            at = end


def _level_keys(trie: Trie, level: int, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The n-grams of a level as (context node << 32 | token), in the order of the texts."""
    before = before_each(ids, starts)
    for shorter in range(2, level):
        before = before_each(trie.look(shorter, before, ids)[0], starts)
    live = before >= 0
    return (before[live] << 32) | ids[live]


def _range_edges(rows: DataFrame, trie: Trie, level: int) -> np.ndarray:
    """Keys that cut a level into ranges of about ``PART_KEYS`` tokens, by the keys of some texts.

    They decide how large the shards are, not what is in them.
    """
    parts = 1 + trie.tokens // PART_KEYS
    if parts == 1:
        return np.empty(0, np.int64)
    share = min(1.0, 4 * EDGE_KEYS * parts / trie.tokens)
    shared = rows.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, starts in _id_slices(batches):
            keys = _level_keys(shared.value, level, ids, starts)
            picked = np.random.default_rng(len(keys)).random(len(keys)) < min(1.0, EDGE_KEYS * parts / trie.tokens / share)
            yield pa.RecordBatch.from_arrays([pa.array(keys[picked])], names=["key"])

    some = rows.where("train").where(F.pmod(F.xxhash64("doc_id", F.size("ids")), F.lit(1 << 20)) < int(share * (1 << 20)))
    table = some.select("ids").mapInArrow(run, "key bigint").toArrow()  # about EDGE_KEYS a part
    keys = np.sort(table["key"].to_numpy())
    return np.unique(keys[np.linspace(0, len(keys), parts + 1)[1:-1].astype(np.int64)]) if len(keys) > parts else keys


def _count_level(rows: DataFrame, trie: Trie, level: int, out_dir: str) -> tuple[list[dict], int, int]:
    """Count the n-grams of a level and write them range by range, without probabilities.

    The task that adds up a range writes its shard, so n-grams are shuffled once, in packed
    blocks.  Gives the rows of the shards, and how many n-grams were seen once and twice.
    """
    edges = _range_edges(rows, trie, level)
    shared = rows.sparkSession.sparkContext.broadcast(trie)
    target = _uri(out_dir)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, ids, starts in _id_slices(batches):
            keys = _level_keys(shared.value, level, ids, starts)
            if len(keys):
                held.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held) > HELD_KEYS:
                yield _blocks(*_merged(held), edges)
                held.clear()
        if held:
            yield _blocks(*_merged(held), edges)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpack_block(*(batch.column(c)[i].as_py() for c in ("rows", "keys", "counts"))) for batch in batches for i in range(batch.num_rows)]
        if not held:
            return
        keys, n = _merged(held)
        held.clear()
        for a in range(0, len(keys), SHARD_NODES):
            key, c = keys[a : a + SHARD_NODES], n[a : a + SHARD_NODES]
            sections, edge = _level_sections(key, c, shared.value, level)
            yield _write_file(target, level, int(key[0]), int(key[-1] >> 32), len(key), sections, edge, int((c == 1).sum()), int((c == 2).sum()))

    blocks = rows.where("train").select("ids").mapInArrow(count, _BLOCKS)
    found = blocks.repartitionById(len(edges) + 1, "part").drop("part").mapInArrow(write, _FILE).collect()  # a row a shard
    return [r.asDict() for r in found], sum(r["once"] for r in found), sum(r["twice"] for r in found)


def trie_counts(trie: Trie, ids: np.ndarray) -> np.ndarray:
    if len(trie.levels[0]) <= 16:  # few passes over the tokens are cheaper than a sort
        return trie.counts(1, ids)
    unique, inverse = np.unique(ids, return_inverse=True)
    return trie.counts(1, unique)[inverse]


def _narrowest(n: np.ndarray) -> np.ndarray:
    top = int(n.max(initial=0))
    return n.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


_FILE = "name string, directory string, first string, last string, nodes bigint, edges string, once bigint, twice bigint"


def _sequences(**given: tuple[np.ndarray, int]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for name, (values, universe) in given.items() for k, v in ef_build(values, universe).items()}


def _level_sections(key: np.ndarray, n: np.ndarray, trie: Trie, level: int) -> tuple[dict[str, np.ndarray], list[list[int]]]:
    """The sections of a shard without its probabilities, and ``context, kept, children, total`` of
    its first and last context, which may go on in other shards."""
    context, token = key >> 32, key & 0xFFFFFFFF
    heads, begin = np.unique(context, return_index=True)
    sizes = np.diff(np.append(begin, len(key)))
    rank = np.repeat(np.arange(len(heads)), sizes)
    width = int(token.max()) + 1
    total, kept = trie.counts(level - 1, heads), np.add.reduceat(n, begin)
    edges = [[int(x[i]) for x in (heads, kept, sizes, total)] for i in ([0, -1] if len(heads) > 1 else [0])]
    sections = {"width": np.array([width], np.int64), "counts": _narrowest(n)}
    sequences = _sequences(
        contexts=(heads, int(heads[-1]) + 1),
        pointers=(np.append(begin, len(key)), len(key) + 1),
        children=(rank.astype(_U) * _U(width) + token.astype(_U), len(heads) * width),
    )
    return sections | sequences, edges


def _write_file(target: str, level: int, first: int, last: int, nodes: int, sections: dict[str, np.ndarray], edges: list, once: int = 0, twice: int = 0) -> pa.RecordBatch:
    raw, directory = pack_sections(sections)
    store, base = pafs.FileSystem.from_uri(target)
    store.create_dir(base, recursive=True)
    name = f"level{level}-{first:016x}"
    attempt = f"{base}/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt, compression=None) as f:
        f.write(raw)
    store.move(attempt, f"{base}/{name}")
    row = {"name": name, "directory": directory, "first": str(first), "last": str(last), "nodes": nodes, "edges": json.dumps(edges), "once": once, "twice": twice}
    return pa.RecordBatch.from_pylist([row])


def _write_words(rows: DataFrame, nodes: int, out_dir: str) -> list[Shard]:
    """Level 1: range-partition the hashes of words and write a file a partition."""
    target = _uri(out_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            hashes, n = table["key"].to_numpy().view(_U) ^ _SIGN, table["n"].to_numpy()
            yield _write_file(target, 1, int(hashes[0]), 0, len(n), {"counts": _narrowest(n)} | _sequences(hashes=(hashes, 1 << 64)), [])

    parts = max(1, -(-nodes // SHARD_NODES))
    ranged = rows.select("key", "n").repartitionByRange(parts, "key").sortWithinPartitions("key")
    return _listed([r.asDict() for r in ranged.mapInArrow(run, _FILE).collect()], 1, target)


def _listed(found: list[dict], level: int, target: str) -> list[Shard]:
    shards = sorted((Shard(level, f"{target}/{r['name']}", r["directory"], int(r["first"]), int(r["last"]), r["nodes"]) for r in found), key=lambda s: s.first)
    at = 0
    for before, s in zip([None, *shards], shards):
        s.offset = at
        at += s.nodes
        if level > 1 and (before is None or before.last_context != s.first >> 32):
            s.first = s.first >> 32 << 32  # the context starts here
    return shards


def _with_probabilities(spark: SparkSession, found: list[dict], level: int, trie: Trie, discount: float, out_dir: str) -> list[Shard]:
    """The shards, each with a second file of quantised probabilities, now that the discount is
    known; a task a shard."""
    target, shared = _uri(out_dir), spark.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sections = map_sections(f"{target}/{r['name']}", r["directory"])
                contexts, pointers = _group(sections, "contexts"), _group(sections, "pointers")
                heads = contexts.access(np.arange(contexts.n)).astype(np.int64)
                begin = pointers.access(np.arange(pointers.n)).astype(np.int64)
                n, sizes = sections["counts"].astype(np.int64), np.diff(begin)
                total = shared.value.counts(level - 1, heads).astype(np.float64)
                prob = quantise((n - discount) / np.repeat(total, sizes))
                back = quantise(left_over(np.add.reduceat(n, begin[:-1]), sizes, total, discount))
                yield _write_file(f"{target}/scores", level, int(r["first"]), int(r["last"]), r["nodes"], {"prob": prob, "back": back}, [])

    rows = spark.createDataFrame(found, _FILE).repartition(len(found))
    scores = {r["name"]: (f"{target}/scores/{r['name']}", r["directory"]) for r in rows.mapInArrow(run, _FILE).collect()}
    shards = _listed(found, level, target)
    for s in shards:
        s.scores = scores[s.path.rpartition("/")[2]]
    _share_edges(shards, {f"{target}/{r['name']}": json.loads(r["edges"]) for r in found}, discount)
    return shards


def left_over(kept, children, total, discount: float):
    """Of a context's mass, what its children leave to shorter contexts."""
    return np.clip(1 - (kept - discount * children) / total, 1e-9, 1)


def _share_edges(shards: list[Shard], edges: dict[str, list[list[int]]], discount: float) -> None:
    """Back-off weights of the contexts whose children lie in more than one shard.

    A shard knows its own children only; the first and last context of each shard, two rows a
    file, are added up here.
    """
    sums: dict[int, list[int]] = {}
    for s in shards:
        for context, kept, children, total in edges[s.path]:
            had = sums.setdefault(context, [0, 0, total, 0])
            sums[context] = [had[0] + kept, had[1] + children, total, had[3] + 1]
    for s in shards:
        for context, *_ in edges[s.path]:
            kept, children, total, many = sums[context]
            if many > 1:
                s.edges[context] = float(restore(quantise(left_over(kept, children, float(total), discount))))


@dataclass
class Trained:
    trie: Trie
    #: doc_id, train, ids of all documents
    ids: DataFrame


def train(docs: DataFrame, order: int = ORDER, folds: int = 5, held: int = 1, out_dir: str | None = None) -> Trained:
    """Count all training documents level by level and write the trie below ``out_dir``.

    Texts are read twice, once for words and once for their ids; later passes read the ids.
    """
    spark = docs.sparkSession
    out_dir = out_dir or scratch_path(spark, "trie")
    own = F.coalesce(fold("doc_id", folds) != held, F.lit(True))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    words = cut(_count_words(docs.where(own), 1 + size // (4 * BYTES_A_TOKEN * PART_KEYS)), "words")
    top = words.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    trie = Trie([], top["tokens"] or 0, top["distinct"])
    if trie.tokens:
        if trie.distinct >= 1 << 31:
            raise OverflowError(f"level 1 has {trie.distinct} nodes")
        trie.levels.append(_write_words(words, trie.distinct, out_dir))
    release(words)
    del words
    forget_shuffles(spark)
    rows = cut(token_ids(docs, trie, own), "ids")
    for level in range(2, order + 1) if trie.tokens else ():
        found, once, twice = _count_level(rows, trie, level, out_dir)
        nodes = sum(r["nodes"] for r in found)
        if not nodes:
            break
        if nodes >= 1 << 31:
            raise OverflowError(f"level {level} has {nodes} nodes")
        discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
        trie.levels.append(_with_probabilities(spark, found, level, trie, discount, out_dir))
        forget_shuffles(spark)
    return Trained(trie, rows)


def log_probabilities(trie: Trie, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the tokens, and log10 of the unigram's and of the whole model's probability."""
    c = trie_counts(trie, ids) if trie.levels else np.zeros(len(ids), np.int64)
    p = unigram = (c + 0.5) / (trie.tokens + 0.5 * (trie.distinct + 1))
    node = token = ids
    for level in range(2, len(trie.levels) + 1):
        node, prob, back = trie.look(level, before_each(node, starts), token)
        p = prob + back * p
    return c, np.log10(unigram), np.log10(p)


SCORES = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score(rows: DataFrame, trie: Trie) -> DataFrame:
    """Per document of ``doc_id, train, ids``: tokens, known tokens, and log10 of the unigram's
    and the model's probability."""
    shared = rows.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch, ids, starts in _id_slices(batches):
            c, base, model = log_probabilities(trie, ids, starts)
            add = lambda x: pa.array(np.add.reduceat(x, starts))
            n = pa.array(np.diff(np.append(starts, len(ids))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("train"), n, add((c > 0).astype(np.int64)), add(base), add(model)],
                names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"],
            )

    return rows.mapInArrow(run, SCORES)


def train_and_score(docs: DataFrame, order: int = ORDER, folds: int = 5, held: int = 1) -> DataFrame:
    """Learn from all folds but one and score every document."""
    made = train(docs, order, folds, held)
    return score(made.ids, made.trie).select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(made.trie.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
