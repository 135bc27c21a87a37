"""SimHash near-duplicates linked through BK-trees.

A fingerprint has bit i set where more than half of the document's shingle hashes have it.
Distinct fingerprints within ``radius`` differing bits are linked; the class of a document
is the component of its fingerprint and is named by the smallest doc_id in it.

Search: the 64 bits are cut into ``radius + 1`` blocks.  Two fingerprints within the radius
agree on at least one block, so each block value is a shard with a BK-tree of its own:
children are keyed by their Hamming distance to the parent and a query follows only the
edges within the radius.  A shard with more than ``shard_limit`` fingerprints is split by
the same rule on the bits that are still free; after four cuts at most 2**14 values are
left, so every tree has a proven bound and nothing is skipped.  The shuffle carries each
shard to the task that queries it.  (Broadcasting all the trees would mean gathering
the fingerprints of the whole corpus on the driver.)  A task floods each tree and emits a
spanning star per linked set instead of all pairs.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z become lower case; shingles are ``width``
words joined by one space, repeats included; fewer words make one shingle; no words give
fingerprint zero, which links like any other.

Defined cases: null text counts as empty; equal texts share a fingerprint; null doc_ids are
kept as rows and never name a class unless it has nothing else; repeated rows stay repeated;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaweave.llm.common import LOCATOR, forget_shuffles, hot_join, kept, known_by, raw_texts, slices, with_locator
from metaweave.operators.components import star_components
from metaweave.plans.scratch import cut, release

SEED = 42
RADIUS = 2
SHARD_LIMIT = 1 << 14
_CHUNK = 1 << 18


def fingerprint(raw: bytes, width: int = 3) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(text, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    n = len(starts)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _CHUNK):
        part = [digest(text[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)``; ``fp`` holds the 64 bits in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(x, width) for x in raw_texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(values, pa.int64())], names=["doc_id", "fp"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


class BKTree:
    """Values in insertion order; ``child[node, d]`` is the child at distance d, or -1."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint64)
        edges: list[dict[int, int]] = []
        plain = self.values.tolist()
        for i, x in enumerate(plain):
            if i:
                at = 0
                while True:
                    d = (plain[at] ^ x).bit_count()
                    down = edges[at].get(d)
                    if down is None:
                        edges[at][d] = i
                        break
                    at = down
            edges.append({})
        self.plain, self.edges = plain, edges
        self._child: np.ndarray | None = None

    @property
    def child(self) -> np.ndarray:
        if self._child is None:
            self._child = np.full((len(self.plain), 65), -1, np.int32)
            for node, down in enumerate(self.edges):
                for d, i in down.items():
                    self._child[node, d] = i
        return self._child

    def near(self, x: int, radius: int) -> list[int]:
        out, todo = [], [0]
        while todo:
            at = todo.pop()
            d = (self.plain[at] ^ x).bit_count()
            if d <= radius:
                out.append(at)
            down = self.edges[at]
            todo += [down[k] for k in range(d - radius, d + radius + 1) if k in down]
        return out

    def near_unseen(self, queries: np.ndarray, radius: int, seen: np.ndarray) -> np.ndarray:
        """Nodes not in ``seen`` that lie within the radius of any of the queries."""
        found = []
        for i in range(0, len(queries), 256):
            q = self.values[queries[i : i + 256]]
            node = np.zeros(len(q), np.int32)
            while len(node):
                d = np.bitwise_count(q ^ self.values[node]).astype(np.int16)
                fresh = np.unique(node[(d <= radius)])
                fresh = fresh[~seen[fresh]]
                seen[fresh] = True
                found.append(fresh)
                nodes, vals = [], []
                for k in range(-radius, radius + 1):
                    key = d + k
                    ok = (key >= 0) & (key <= 64)
                    down = self.child[node[ok], key[ok]]
                    live = down >= 0
                    nodes.append(down[live])
                    vals.append(q[ok][live])
                node, q = np.concatenate(nodes), np.concatenate(vals)
        return np.concatenate(found) if found else np.empty(0, np.int32)


def linked_sets(values: np.ndarray, radius: int) -> list[np.ndarray]:
    """Index sets of two or more values that the radius connects, by flooding a BK-tree."""
    tree = BKTree(values)
    n = len(values)
    out = []
    if n <= 48:
        left = set(range(n))
        while left:
            todo = [min(left)]
            left.discard(todo[0])
            group = []
            while todo:
                x = todo.pop()
                group.append(x)
                fresh = [y for y in tree.near(tree.plain[x], radius) if y in left]
                left.difference_update(fresh)
                todo += fresh
            if len(group) > 1:
                out.append(np.array(group))
        return out
    seen = np.zeros(n, bool)
    for first in range(n):
        if not seen[first]:
            seen[first] = True
            group, todo = [np.array([first])], np.array([first])
            while len(todo):
                todo = tree.near_unseen(todo, radius, seen)
                group.append(todo)
            group = np.concatenate(group)
            if len(group) > 1:
                out.append(group)
    return out


def _cuts(free: list[int], parts: int) -> list[list[int]]:
    size, extra = divmod(len(free), parts)
    out, at = [], 0
    for i in range(parts):
        step = size + (i < extra)
        out.append(free[at : at + step])
        at += step
    return out


def _masks(levels: int, parts: int) -> list[list[tuple[int, int]]]:
    """Per level: (mask, index of the parent mask); each mask fixes one more block."""
    out: list[list[tuple[int, int]]] = []
    before = [(0, 0)]
    for _ in range(levels):
        now = []
        for parent, (mask, _p) in enumerate(before):
            free = [b for b in range(64) if not mask >> b & 1]
            now += [(mask | sum(1 << b for b in block), parent) for block in _cuts(free, parts)]
        out.append(now)
        before = now
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(fps: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Star links ``(u, v)`` among the distinct values of ``fps.fp`` within ``radius`` bits."""

    def flood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
            us, vs = [], []
            for group in linked_sets(values.view(np.uint64), radius):
                members = values[group]
                low = members.min()
                rest = members[members != low]
                us.append(rest)
                vs.append(np.full(len(rest), low))
            return us, vs

        held: list[np.ndarray] = []
        last = None
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []

        def close() -> None:
            if held:
                values = np.concatenate(held)
                if len(values) > 1:
                    a, b = emit(values)
                    us.extend(a)
                    vs.extend(b)
                held.clear()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"]
            )
            us.clear()
            vs.clear()
            return batch

        for batch in batches:
            path = batch.column("path").to_numpy()
            key = batch.column("key").to_numpy()
            fp = batch.column("fp").to_numpy()
            if not len(fp):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (key[1:] != key[:-1])))).tolist()
            for a, b in zip(starts, [*starts[1:], len(fp)]):
                name = (path[a], key[a])
                if name != last:
                    close()
                    last = name
                held.append(fp[a:b])
            if us:
                yield out()
        close()
        if us:
            yield out()

    levels = _masks(4, radius + 1)
    todo = fps.select("fp").distinct()
    keyed = todo.select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, (m, _) in enumerate(levels[0])])
        ).alias("k"),
        "fp",
    ).select("k.path", "k.key", "fp")
    links, spent = [], []
    for level in range(len(levels)):
        sizes = keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        keyed = cut(keyed.join(sizes, ["path", "key"]), "shards")
        spent.append(keyed)
        most = keyed.agg(F.max("n").alias("n")).first()["n"]
        if most is None:
            break
        last = most <= shard_limit or level == len(levels) - 1
        here = keyed if last else keyed.where(F.col("n") <= shard_limit)
        links.append(
            cut(
                here.select("path", "key", "fp").repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(flood, "u bigint, v bigint"),
                "links",
            )
        )
        if last:
            break
        below = [F.when(F.col("path") == parent, F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))) for i, (m, parent) in enumerate(levels[level + 1])]
        keyed = (
            keyed.where(F.col("n") > shard_limit)
            .select(F.explode(F.array_compact(F.array(*below))).alias("k"), "fp")
            .select("k.path", "k.key", "fp")
        )
    release(*spent)
    if not links:
        return fps.sparkSession.createDataFrame([], "u bigint, v bigint")
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per document."""
    rows = cut(fingerprints(docs, width), "fps")
    parts = star_components(near_links(rows, radius, shard_limit))
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    named = reps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "n", F.coalesce("component", "fp").alias("component"), "least"
    )
    named = cut(named, "classes")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = cut(named.join(ids, "component").select("fp", "n", "component_id"), "names")
    return hot_join(rows, names, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- similarity of 0.8 and more

#: One text in so many is looked at for shingles that many texts hold, and so many are kept.
#: Both bear on the order of shingles only, thus on speed: any one order finds the same pairs.
ORDER_SHARE, ORDER_MOST = 16, 1 << 18
_EPS = 1e-9
#: Nodes of a bucket up to which all its pairs are compared at once.
DENSE = 64
#: Centres a large bucket's nodes are compared with before the rest of its pairs.
CENTRES = 8
#: Nodes of a large bucket that one cell of its pairs holds on either side.
CELL = 2048
#: Shingles that one cell of pairs to verify holds, about.
BIN = 1 << 19
#: Longs of a parity sketch.
SKETCH = 8
#: Nodes to verify up to which their list is broadcast to the reading of the texts.
FEW_NODES = 1 << 20

_SKETCH = [f"b{i}" for i in range(SKETCH)]
_ROWS = [*LOCATOR, "doc_id", "node", "fp", "size", "prefix", "sketch"]


def shingles(words: list[bytes], width: int = 5) -> np.ndarray:
    """Hashes of the ``width``-word shingles, repeats included."""
    if not words:
        return np.empty(0, "<u8")
    text = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    last = max(len(words) - width, 0)
    starts = (ends - sizes)[: last + 1].tolist()
    ends = ends[len(words) - 1 - last :].tolist()
    return np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts, ends)], "<u8")


def shingle_set(raw: bytes, width: int = 5) -> tuple[int, np.ndarray]:
    """The distinct shingle hashes in signed order, and a hash that names the set."""
    held = np.unique(shingles(raw.lower().split(), width).view("<i8"))
    return xxhash.xxh64_intdigest(held.tobytes(), SEED), held


def parity_sketch(held: np.ndarray) -> np.ndarray:
    """Of each of ``64 * SKETCH`` groups of hashes, whether the set holds an odd number.

    Two sketches differ in at most as many bits as the sets differ in elements.
    """
    odd = np.bincount((held.view("<u8") >> np.uint64(32)) % np.uint64(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *map(len, values)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, "<i8"), *values])))


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(node, held)``: the name of each text's shingle set and the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None, lambda: None)
        for batch in slices(batches):
            nodes, held = zip(*[shingle_set(x, width) for x in raw_texts(batch)])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), _lists(held)], names=["node", "held"])

    return docs.select("text").mapInArrow(run, "node bigint, held array<bigint>")


def shared_shingles(docs: DataFrame, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, in signed order, and in how many of the counted texts."""
    some = docs.where(F.pmod(F.xxhash64(*LOCATOR), F.lit(ORDER_SHARE)) == 0)
    counts = shingle_sets(some, width).select(F.explode("held").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    most = counts.where("n > 2").orderBy(F.desc("n"), "key").limit(ORDER_MOST).toArrow()
    keys, n = most.column("key").to_numpy(), most.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefixes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The columns ``_ROWS`` of each text; its prefix is its rarest shingles, so many that two
    texts of that similarity share one of them."""
    shared = docs.sparkSession.sparkContext.broadcast(shared_shingles(docs, width))

    def prefix(held: np.ndarray) -> np.ndarray:
        keys, n = shared.value
        most = len(held) - int(np.ceil(similarity * len(held) - _EPS)) + 1 if len(held) else 0
        if len(keys):
            at = np.minimum(np.searchsorted(keys, held), len(keys) - 1)
            held = held[np.lexsort((held, np.where(keys[at] == held, n[at], 0)))]
        return held[:most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None, lambda: None)
        for batch in slices(batches):
            raws = raw_texts(batch)
            nodes, held = zip(*[shingle_set(x, width) for x in raws])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in LOCATOR],
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.array(np.array([fingerprint(x) for x in raws], np.uint64).view(np.int64)),
                    pa.array([len(x) for x in held], pa.int32()),
                    _lists([prefix(x) for x in held]),
                    _lists([parity_sketch(x) for x in held]),
                ],
                names=_ROWS,
            )

    shape = "_dedup_file string, _dedup_row bigint, doc_id bigint, node bigint, fp bigint, size int, prefix array<bigint>, sketch array<bigint>"
    return docs.select(*LOCATOR, "doc_id", "text").mapInArrow(run, shape)


def _room(a, b, similarity: float):
    """How many elements sets of these sizes may differ in."""
    return (1 - similarity) / (1 + similarity) * (a + b) + _EPS


def deal(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``cell, u, v``: the pairs dealt into cells that hold about ``BIN`` shingles of texts, so that a
    text travels once to each cell that needs it and not once a pair.

    ``sizes`` has ``node, size``. A pair lies with the end that has fewer partners. Pairs of small
    components share cells, a large component has several cells of its own; a cell whose texts
    still come to over ``4 * BIN`` shingles is cut into a grid of both ends.
    """
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ends = cut(ends.join(sizes, "node"), "ends")
    total = ends.agg(F.sum("size").alias("size")).first()["size"] or 0
    if total <= BIN:
        return pairs.select(F.lit(0).cast("long").alias("cell"), "u", "v")
    cells = 1 + total // BIN
    ends = cut(ends.join(_components(pairs), "node"), "ends")
    parts = cut(ends.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")), "parts")
    ends = cut(hot_join(ends, parts, "component").drop("n"), "ends")
    known = ends.withColumnRenamed("degree", "n")
    left = known.select(F.col("node").alias("u"), "n", F.col("size").alias("u_size"), "component", F.ceil(F.col("weight") / BIN).alias("slots"))
    right = known.select(F.col("node").alias("v"), "n", F.col("size").alias("v_size"))
    met = cut(hot_join(pairs, left, "u").withColumnRenamed("n", "u_n"), "met")
    own = F.when(F.col("u_n") <= F.col("n"), F.col("u")).otherwise(F.col("v"))
    home = F.xxhash64("component", F.pmod(F.xxhash64("own", F.lit(1)), F.greatest("slots", F.lit(1))))
    dealt = hot_join(met, right, "v").withColumn("own", own).withColumn("cell", F.pmod(home, F.lit(cells)))
    dealt = cut(dealt.select("cell", "u", "v", "own", "u_size", "v_size"), "dealt")
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("u_size").alias("size")), F.struct(F.col("v").alias("node"), F.col("v_size").alias("size"))))
    loads = dealt.select("cell", ends.alias("end")).distinct().groupBy("cell").agg(F.sum("end.size").alias("load"))
    over = cut(loads.where(F.col("load") > 4 * BIN).select("cell", F.ceil(F.col("load") / BIN).alias("grid")), "over")
    if not over.isEmpty():
        other = F.when(F.col("own") == F.col("u"), F.col("v")).otherwise(F.col("u"))
        finer = F.xxhash64("cell", F.pmod(F.xxhash64("own", F.lit(2)), F.col("grid")), F.pmod(F.xxhash64(other, F.lit(3)), F.col("grid")))
        dealt = cut(dealt.join(over, "cell", "left").withColumn("cell", F.when(F.col("grid").isNull(), F.col("cell")).otherwise(finer)), "finer")
    return dealt.select("cell", "u", "v")


def _packed(texts: DataFrame) -> DataFrame:
    """``cell, node, raw``: the texts in compressed form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress
        for batch in slices(batches):
            raw = pa.array([pack(x) for x in raw_texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("node"), raw], names=["cell", "node", "raw"])

    return texts.select("cell", "node", "text").mapInArrow(run, "cell bigint, node bigint, raw binary")


def similar_pairs(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, nodes: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Those of the written pairs ``u, v`` whose whole shingle sets have that Jaccard similarity or more.

    ``nodes`` says where a text of each node stands in ``docs``; whole texts travel to the cells
    of :func:`deal` and become sets there.
    """

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        held = {n: shingle_set(unpack(x), width)[1] for n, x in zip(right["node"].to_pylist(), right["raw"].to_pylist())}
        out = []
        for u, v in zip(left["u"].to_pylist(), left["v"].to_pylist()):
            a, b = held[u], held[v]
            met = len(np.intersect1d(a, b, assume_unique=True))
            if met >= similarity * (len(a) + len(b) - met) - _EPS:
                out.append((u, v))
        u, v = zip(*out) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    dealt = deal(pairs, sizes)
    need = dealt.select("cell", F.explode(F.array("u", "v")).alias("node")).distinct()
    need = cut(need.join(nodes.select("node", *LOCATOR), "node"), "need")
    texts = _packed(known_by(docs.select(*LOCATOR, "text"), need, LOCATOR, "inner", FEW_NODES))
    return dealt.groupBy("cell").cogroup(texts.groupBy("cell")).applyInArrow(run, "u bigint, v bigint")


def _fits(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes, and what follows the shared shingle in both, leave room for the similarity.

    At the first shingle that a pair shares this holds for every pair of that similarity.
    """
    a, b = rows["size"][i], rows["size"][j]
    after = np.minimum(a - rows["pos"][i], b - rows["pos"][j])
    return (np.minimum(a, b) >= similarity * np.maximum(a, b) - _EPS) & (after >= similarity / (1 + similarity) * (a + b) - _EPS)


def bucket_pairs(rows: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of each bucket ``[start, end)`` that :func:`_fits` leaves."""
    us, vs = [], []
    here = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)]) if len(starts) else np.empty(0, np.int64)
    left = np.repeat(ends, ends - starts) - here - 1
    for step in range(1, int((ends - starts).max(initial=1))):
        live = left >= step
        here, left = here[live], left[live]
        ok = _fits(rows, here, here + step, similarity)
        us.append(here[ok])
        vs.append(here[ok] + step)
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return cat(us), cat(vs)


def by_key(buckets: DataFrame, found, schema: str, most: int | None = None, over=None) -> DataFrame:
    """``found(rows, starts, ends)`` on the keys with two rows or more, whole keys at a time.

    With ``most``, rows of a key that has more than that are passed to ``over`` as they come.
    """
    names = buckets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            key = rows["key"]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.append(starts[1:], len(key))
            more = ends - starts > 1
            if most is not None:
                large = ends - starts > most
                for a, b in zip(starts[large], ends[large]):
                    yield over({n: x[a:b] for n, x in rows.items()})
                more &= ~large
            if more.any():
                yield from found(rows, starts[more], ends[more])

        held: list[dict[str, np.ndarray]] = []
        flowing = None  # the key whose rows go to ``over`` as they come
        for batch in batches:
            rows = {n: batch.column(n).to_numpy() for n in names}
            if not len(rows["key"]):
                continue
            if flowing is not None and not held:
                end = int(np.searchsorted(rows["key"], flowing, "right"))
                if end:
                    yield over({n: x[:end] for n, x in rows.items()})
                    rows = {n: x[end:] for n, x in rows.items()}
                    if not len(rows["key"]):
                        continue
                flowing = None
            held.append(rows)
            rows = {n: np.concatenate([x[n] for x in held]) for n in names}
            last = int(np.searchsorted(rows["key"], rows["key"][-1]))  # the last key may go on
            if last:
                yield from whole({n: x[:last] for n, x in rows.items()})
            rest = {n: x[last:] for n, x in rows.items()}
            if most is not None and len(rest["key"]) > most:
                flowing = rest["key"][0]
                yield over(rest)
                held = []
            else:
                held = [rest]
        if held:
            yield from whole(held[0])

    return buckets.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, schema)


def _pairs(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)


def close_pairs(buckets: DataFrame, similarity: float) -> DataFrame:
    """``key, u, v``: ``u < v`` is a pair of nodes that shares a shingle of both prefixes
    and may be similar; nodes of buckets over ``DENSE`` come singly, as ``u`` without ``v``."""
    names = ["key", "u", "v"]

    def found(rows: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v = bucket_pairs(rows, starts, ends, similarity)
        pairs = _pairs(rows["node"][u], rows["node"][v])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=names)

    def over(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(rows["key"])
        return pa.RecordBatch.from_arrays([pa.array(rows["key"]), pa.array(rows["node"]), pa.nulls(n, pa.int64())], names=names)

    return by_key(buckets, found, "key bigint, u bigint, v bigint", DENSE, over)


def _near_in_sketch(a: str, b: str, similarity: float) -> Column:
    """Whether sizes and parity sketches of two structs leave room for the similarity."""
    x, y = F.col(a), F.col(b)
    bits = sum((F.bit_count(x[c].bitwiseXOR(y[c])) for c in _SKETCH[1:]), F.bit_count(x[_SKETCH[0]].bitwiseXOR(y[_SKETCH[0]])))
    small, large = F.least(x["size"], y["size"]), F.greatest(x["size"], y["size"])
    return (small >= similarity * large - _EPS) & (bits <= _room(small, large, similarity))


def in_sketch(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``u, v`` that sizes and sketches leave room for."""
    held = F.struct("size", *_SKETCH)
    both = pairs.join(sketches.select(F.col("node").alias("u"), held.alias("x")), "u").join(sketches.select(F.col("node").alias("v"), held.alias("y")), "v")
    return both.where(_near_in_sketch("x", "y", similarity)).select("u", "v")


def star_pairs(dense: DataFrame, similarity: float) -> DataFrame:
    """Pairs of the nodes of each large bucket and its centres: a linear number."""
    held = ["node", "size", *_SKETCH]
    centre = [F.max_by(F.struct(*held), F.struct("shared", "node"))]
    centre += [F.min_by(F.struct(*held), F.xxhash64("node", F.lit(i))) for i in range(1, CENTRES)]
    centres = cut(dense.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array(*centre).alias("centres")), "centres")
    return (
        hot_join(dense, centres, "key")
        .select(F.struct(*held).alias("x"), F.explode("centres").alias("y"))
        .where((F.col("x.node") != F.col("y.node")) & _near_in_sketch("x", "y", similarity))
        .select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v"))
        .distinct()
    )


def rest_pairs(dense: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different ``class`` in one large bucket that may be similar.

    A bucket's pairs are dealt out in cells of at most twice ``CELL`` nodes; buckets of one
    class have no such pairs and drop out.
    """
    names = ["u", "v"]

    def found(rows: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        sketch = np.stack([rows[c].view(np.uint64) for c in _SKETCH], axis=1)
        node, known, size, side = (rows[c] for c in ("node", "class", "size", "side"))
        for a, b in zip(starts.tolist(), ends.tolist()):
            for x in range(a, b, 256):
                i, j = np.arange(x, min(x + 256, b))[:, None], np.arange(x, b)[None]
                ok = (i < j) & (known[i] != known[j]) & ((side[i] != side[j]) | (side[i] == 2))
                ok &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - _EPS
                at, to = np.nonzero(ok)
                at, to = i[at, 0], j[0, to]
                bits = np.zeros(len(at), np.int64)
                for k in range(SKETCH):
                    bits += np.bitwise_count(sketch[at, k] ^ sketch[to, k])
                live = bits <= _room(size[at], size[to], similarity)
                if live.any():
                    pairs = _pairs(node[at[live]], node[to[live]])
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=names)

    mixed = cut(dense.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("class") != F.max("class")).alias("mixed")).where("mixed"), "mixed")
    grid = F.ceil(F.col("n") / CELL).cast("int")
    own, other = F.col("own"), F.col("other")
    cells = (
        hot_join(dense, mixed.select("key", "n", grid.alias("grid")), "key")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("grid")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
        .select(
            F.xxhash64("key", F.least(own, other), F.greatest(own, other)).alias("key"),
            "node", "class", "size", *_SKETCH, F.when(own == other, 2).otherwise((own > other).cast("int")).alias("side"),
        )
    )
    return by_key(cells, found, "u bigint, v bigint").distinct()


def dense_links(dense: DataFrame, links: DataFrame, similar, similarity: float) -> DataFrame:
    """``links`` and what large buckets (``key, node, size, shared, b0..``) add, so that all
    similar nodes are connected.

    Stars around a few nodes a bucket come first; they join a dense family by a linear number
    of pairs. Then what is still in different classes is compared whole.
    """
    links = links.unionByName(similar(cut(star_pairs(dense, similarity), "stars")))
    parts = _components(links).select("node", F.col("component").alias("class"))
    known = cut(dense.join(parts, "node", "left").withColumn("class", F.coalesce("class", "node")), "known")
    return links.unionByName(similar(cut(rest_pairs(known, similarity), "rest")))


def _components(links: DataFrame) -> DataFrame:
    """Components, each of whose rounds leaves plans and shuffles to the driver's garbage."""
    out = star_components(links)
    forget_shuffles(links.sparkSession)
    return out


def simhash_pairs(once: DataFrame) -> DataFrame:
    """``u, v``: the star of each set of nodes whose fingerprints (``node, fp``) are linked through the BK-trees."""
    linked = _components(near_links(once)).withColumnRenamed("node", "fp")
    named = once.join(linked, "fp", "left").select("node", F.coalesce("component", "fp").alias("class"))
    named = cut(named, "linked")
    least = named.groupBy("class").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return hot_join(named, cut(least, "least"), "class").where("u <> node").select("u", F.col("node").alias("v"))


def apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose ends ``links`` don't connect yet."""
    known = _components(links)
    a, b = known.select(F.col("node").alias("u"), F.col("component").alias("cu")), known.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    return pairs.join(a, "u", "left").join(b, "v", "left").where("cu IS NULL OR cv IS NULL OR cu <> cv").select("u", "v")


def similar_links(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(rows, links)``: the rows of :func:`prefixes`; links ``u, v`` of nodes that connect all
    similar texts. ``docs`` has the columns ``LOCATOR``.

    SimHash comes first: texts whose fingerprints the BK-trees link are compared with one of
    their set. What it misses is completed: candidates share one of their rarest shingles, as
    all similar texts do (prefix filter), and lie in different classes yet. The similarity of
    the whole shingle sets decides in both. Texts with the same set are one node.
    """
    rows = cut(prefixes(docs, width, similarity), "prefixes")
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*LOCATOR)).alias("of"))
    nodes = cut(nodes.select("node", "n", "of.*"), "nodes")
    firsts = nodes.where("n > 1").select("node", "n", *[F.col(c).alias(f"first{c}") for c in LOCATOR])
    again = hot_join(rows.select(*LOCATOR, "node"), firsts, "node")
    extra = cut(again.where(" OR ".join(f"{c} <> first{c}" for c in LOCATOR)).select(*LOCATOR), "extra")
    once = known_by(rows, extra, LOCATOR, "left_anti")
    sketches = cut(once.select("node", "size", *[F.col("sketch")[i].alias(c) for i, c in enumerate(_SKETCH)]), "sketches")
    prints = cut(once.select("node", "fp"), "fps")
    buckets = once.select("node", "size", F.posexplode("prefix").alias("pos", "key")).select("key", "node", "size", "pos")
    found = cut(close_pairs(buckets, similarity), "pairs")

    def similar(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        out = cut(similar_pairs(pairs, sketches.select("node", "size"), docs, nodes, width, similarity), "similar")
        forget_shuffles(docs.sparkSession)
        return out

    linked = similar(cut(in_sketch(simhash_pairs(prints), sketches, similarity), "linked"))
    close = in_sketch(found.where("v IS NOT NULL").select("u", "v").distinct(), sketches, similarity)
    links = linked.unionByName(similar(cut(apart(close, linked), "close")))
    dense = found.where("v IS NULL").select("key", F.col("u").alias("node"))
    if not dense.isEmpty():
        shared = dense.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
        dense = cut(dense.join(sketches.join(shared, "node"), "node"), "dense")
        links = dense_links(dense, links, similar, similarity)
        release(dense)
    release(found, sketches, extra, prints)
    return rows, links


def similar_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of ``docs`` (with ``LOCATOR``): its id, locator and those of the row that
    names its class, ``stays``: the smallest doc_id, then locator; nulls last."""
    rows, links = similar_links(docs, width, similarity)
    parts = _components(links)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *LOCATOR)
    named = rows.groupBy("node").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")).join(parts, "node", "left")
    named = cut(named.select("node", "n", F.coalesce("component", "node").alias("component"), "least"), "classes")
    stays = named.groupBy("component").agg(F.min("least").alias("stays"))
    names = cut(named.join(stays, "component").select("node", "n", "stays"), "names")
    return hot_join(rows.select("node", "doc_id", *LOCATOR), names, "node")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of similar texts: that of the smallest doc_id, then the first in its
    file. Rows are told apart by their place, so repeated ids harm nothing; a row without an id
    stays only where its class has no other; texts without words are one class."""
    located = with_locator(docs)
    found = similar_classes(located, width, similarity)
    gone = cut(found.where(" OR ".join(f"stays.{c} <> {c}" for c in LOCATOR)).select(*LOCATOR), "gone")
    return known_by(located, gone, LOCATOR, "left_anti").select(*docs.columns)
