"""Aggregates of groups kept up to date over batches of changes: count, distinct, sum, least,
greatest and median.

A change adds or takes rows of a group that carry a whole number (or null).  Changes of equal
(group, batch, value) are summed up before anything is shuffled by group, and a group is
split into shards of ``width`` consecutive values: a shard has at most ``width`` rows a batch
however many rows its group has, and shards of a hot group spread over all tasks.

Each shard holds hash multiplicities (their number gives distinct), running count and sum, a
min and a max heap, and two heaps that meet at a rank.  All heaps are lazily deleted: a value
whose multiplicity fell to zero stays until it comes to the top, and a heap is built again
once the dead outnumber the living.  The two heaps are rebalanced on live sizes, that is by
multiplicities.  In a group of one shard that rank is its median's; else the live counts of
the shards, summed up in the order of their values, tell for each batch which shard holds the
group's median and at which rank within, and that shard balances its heaps there.  Shards'
figures then add up (count, distinct, sum) or meet (least, greatest) by group and batch.

The median of ``n`` values is that at position ``floor((n + 1) / 2)`` in ascending order.

Changes may come in several calls: :func:`state` gives the multiplicities after the last batch,
and :func:`maintain` starts from such a table.

Defined cases: null values count as rows only; null keys are a group of their own; taking more
rows of a value than there are raises an error; a batch without changes, or whose changes
cancel out, makes no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from metaweave.plans.scratch import cut

WIDTH = 32
#: The columns of a state, in the order of the result.
FIGURES = ["n_rows", "n_distinct", "total", "least", "greatest", "median"]
#: Rows of an Arrow batch that is handed on.
ROWS = 1 << 14


class LazyHeap:
    """Values in ascending (or descending) order; those for which ``alive`` is false go when met."""

    def __init__(self, alive, descending: bool = False):
        self.alive, self.sign, self.heap = alive, -1 if descending else 1, []

    def push(self, value: int) -> None:
        heapq.heappush(self.heap, self.sign * value)

    def top(self) -> int | None:
        while self.heap:
            value = self.sign * self.heap[0]
            if self.alive(value):
                return value
            heapq.heappop(self.heap)
        return None

    def pop(self) -> int | None:
        value = self.top()
        if value is not None:
            heapq.heappop(self.heap)
        return value

    def rebuild(self) -> None:
        self.heap = sorted({x for x in self.heap if self.alive(self.sign * x)})


class Shard:
    """The aggregates of one multiset of whole numbers."""

    def __init__(self):
        self.many: dict[int, int] = {}
        self.n = self.total = self.low_n = 0
        self.in_low: dict[int, bool] = {}
        self.least = LazyHeap(self.many.__contains__)
        self.greatest = LazyHeap(self.many.__contains__, descending=True)
        self.low = LazyHeap(lambda x: self.in_low.get(x) is True, descending=True)
        self.high = LazyHeap(lambda x: self.in_low.get(x) is False)

    @property
    def distinct(self) -> int:
        return len(self.many)

    def change(self, value: int, by: int) -> None:
        """Add (or take) ``by`` rows of ``value``."""
        now = self.many.get(value, 0) + by
        if now < 0:
            raise ValueError(f"{-now} more rows of value {value} were taken than there are")
        if not by:
            return
        if value not in self.many:
            for heap in (self.least, self.greatest):
                heap.push(value)
            top = self.low.top()
            self._put(value, top is not None and value <= top)
        self.n, self.total = self.n + by, self.total + by * value
        self.low_n += by * self.in_low[value]
        if now:
            self.many[value] = now
        else:
            del self.many[value], self.in_low[value]
            for heap in (self.least, self.greatest, self.low, self.high):
                if len(heap.heap) > 2 * len(self.many) + 16:
                    heap.rebuild()

    def _put(self, value: int, low: bool) -> None:
        self.in_low[value] = low
        (self.low if low else self.high).push(value)

    def at(self, rank: int) -> int:
        """The value at ``rank`` (from 1) in ascending order: the low heap is balanced to hold just
        so many live rows that its top is that value."""
        if not 1 <= rank <= self.n:
            raise IndexError(rank)
        while self.low_n < rank:
            value = self.high.pop()
            self._put(value, True)
            self.low_n += self.many[value]
        while self.low_n - self.many[top := self.low.top()] >= rank:
            self.low.pop()
            self._put(top, False)
            self.low_n -= self.many[top]
        return top

    def median(self) -> int | None:
        return self.at((self.n + 1) // 2) if self.n else None


def net_changes(changes: DataFrame, keys: Sequence[str], batch: str, value: str, by: str, width: int = WIDTH) -> DataFrame:
    """``*keys, _batch, _shard, _value, _by``, one row each with what doesn't cancel out."""
    rows = changes.select(*keys, F.col(batch).cast("bigint").alias("_batch"), F.col(value).cast("bigint").alias("_value"), F.col(by).cast("bigint").alias("_by"))
    summed = rows.groupBy(*keys, "_batch", "_value").agg(F.sum("_by").alias("_by")).where("_by <> 0")
    return summed.withColumn("_shard", F.expr(f"(_value - pmod(_value, {width}L)) div {width}L"))


def state(changes: DataFrame, keys: Sequence[str], value: str, by: str) -> DataFrame:
    """``*keys, value, by``: the rows left of each value after all changes."""
    return changes.groupBy(*keys, value).agg(F.sum(by).alias(by)).where(F.col(by) != 0)


def _ranks(net: DataFrame, keys: Sequence[str], last: int) -> DataFrame:
    """``*keys, _shard, _batch, _rank``: for each group and batch with values, the shard that
    holds the median and its rank there."""
    shards = net.where("_value is not null").groupBy(*keys, "_shard", "_batch").agg(F.sum("_by").alias("_by"))
    by_shard = W.partitionBy(*keys, "_shard").orderBy("_batch")
    spans = shards.withColumns({"_live": F.sum("_by").over(by_shard), "_next": F.lead("_batch", 1, last + 1).over(by_shard)})
    live = spans.select(*keys, "_shard", "_live", F.explode(F.sequence("_batch", F.col("_next") - 1)).alias("_batch"))
    group = W.partitionBy(*keys, "_batch")
    before = F.coalesce(F.sum("_live").over(group.orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = live.withColumns({"_n": F.sum("_live").over(group), "_before": before}).withColumn("_rank", F.expr("(_n + 1) div 2 - _before"))
    return ranked.where("_rank between 1 and _live").select(*keys, "_shard", "_batch", "_rank")


def _walk(keys: Sequence[str], schema: pa.Schema, last: int):
    """Over rows in the order (keys, _shard, _batch): a shard's figures after each batch from its
    first on."""
    names = [*keys, "_shard", "_batch", "_value", "_by", "_rank"]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, shard, nulls, at, rank = None, Shard(), 0, None, None

        def until(end: int) -> Iterator[tuple]:
            """The figures after the present batch and the ones without changes before ``end``; only
            the present one may have asked for a rank."""
            for b in range(at, end):
                median = shard.at(rank) if rank is not None and b == at else None
                yield (*now[0], b, shard.n + nulls, shard.distinct, shard.total, shard.least.top(), shard.greatest.top(), median)

        for batch in batches:
            for *key, number, k, value, by, wanted in zip(*(batch.column(x).to_pylist() for x in names)):
                if now != (key, number):
                    if now:
                        yield from until(last + 1)
                    now, shard, nulls, at, rank = (key, number), Shard(), 0, k, None
                elif k != at:
                    yield from until(k)
                    at, rank = k, None
                if wanted is not None:
                    rank = wanted
                elif number is None:
                    nulls += by
                    if nulls < 0:
                        raise ValueError("more rows without a value were taken than there are")
                else:
                    shard.change(value, by)
        if now:
            yield from until(last + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in shards(batches):
            rows.append(row)
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def maintain(
    changes: DataFrame,
    keys: Sequence[str],
    batch: str,
    value: str,
    by: str,
    last: int,
    before: DataFrame | None = None,
    first: int = 0,
    width: int = WIDTH,
) -> DataFrame:
    """``batch, *keys, old_n_rows, new_n_rows, ...`` for each batch in ``first`` to ``last`` and group
    in which one of ``FIGURES`` changes.

    ``changes`` has one row for each row that enters (``by`` positive) or leaves (negative) in a
    batch; what lies beyond ``last`` is ignored.  ``before`` is a :func:`state` to start from.
    """
    keys = list(keys)
    wanted = changes.where(F.col(batch).between(first, last)).select(*keys, F.col(batch).alias("_at"), value, by)
    if before is not None:
        wanted = wanted.unionByName(before.select(*keys, F.lit(first - 1).alias("_at"), value, by))
    net = cut(net_changes(wanted, keys, "_at", value, by, width), "net-changes")
    nothing = F.lit(None).cast("bigint")
    rows = net.withColumn("_rank", nothing).unionByName(_ranks(net, keys, last).withColumns({"_value": nothing, "_by": nothing}))
    kinds = {f.name: f.dataType.simpleString() for f in net.schema}
    shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_batch bigint", *(f"{x} bigint" for x in FIGURES)])
    arrow = to_arrow_schema(StructType.fromDDL(shape))
    walked = rows.repartition(*keys, "_shard").sortWithinPartitions(*keys, "_shard", "_batch").mapInArrow(_walk(keys, arrow, last), shape)
    adds, meets = FIGURES[:3], {"least": F.min, "greatest": F.max, "median": F.max}
    now = walked.groupBy(*keys, "_batch").agg(*[F.sum(x).alias(x) for x in adds], *[f(x).alias(x) for x, f in meets.items()])
    group = W.partitionBy(*keys).orderBy("_batch")
    old = {f"old_{x}": F.coalesce(F.lag(x).over(group), F.lit(0)) if x in adds else F.lag(x).over(group) for x in FIGURES}
    changed = F.lit(False)
    for x in FIGURES:
        changed = changed | ~F.col(f"old_{x}").eqNullSafe(F.col(x))
    both = [F.col(y).alias(z) for x in FIGURES for y, z in ((f"old_{x}", f"old_{x}"), (x, f"new_{x}"))]
    found = now.withColumns(old).where(changed & (F.col("_batch") >= first))
    return found.select(F.col("_batch").cast("int").alias("batch"), *keys, *both)


#: Batches of the registered query.
BATCHES = 20


def document_changes(docs: DataFrame) -> DataFrame:
    """``source, lang, batch, n_chars, by``: documents come, go and come back by the crc32 of their id.

    A document enters in batch ``crc32 mod 20`` and leaves ``q = floor(crc32 / 20) mod 4`` batches
    later; if 3 divides ``q`` it comes back in that batch for good, ``n_chars`` raised by ``q``.  A
    null id counts as the empty text, null source and lang as ''.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")],
        F.col("n_chars").cast("bigint").alias("n_chars"),
        (h % BATCHES).alias("b"),
        (F.floor(h / BATCHES) % 4).alias("q"),
    )
    change = lambda at, n, by: F.struct(at.alias("batch"), n.alias("n_chars"), F.lit(by).alias("by"))
    b, q, n = F.col("b"), F.col("q"), F.col("n_chars")
    moves = F.array(change(b, n, 1), change(b + q, n, -1), F.when(q % 3 == 0, change(b + q, n + q, 1)))
    return rows.select("source", "lang", F.explode(moves).alias("m")).where("m is not null").select("source", "lang", "m.*")
