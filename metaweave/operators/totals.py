"""Sums over the walks a - m - b by starts, where a walk never is a row.

Like :mod:`product`, blocks of starts get their rows and the lists of the middles that they meet,
once each, as packed numbers.  A task then adds up its walks with numpy, a few starts at a time,
and gives rows in the order of start and end.  So blocks can be large and lists are shipped to few
of them, also where near starts share no middles; what is held is the lists of a block, not its
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaweave.operators.ordered import running_sums
from metaweave.plans.scratch import cut

#: Walks of a block, and how few are worth a task of their own.
BLOCK, LEAST = 1 << 25, 1 << 20
#: Starts with more blocks than this are joined plainly: their walks meet few starts.
HEAVY = 4
#: Walks, and cells of start and end, that a task adds up at once.
PIECE = 1 << 21
#: Cells a walk up to which sums lie in an array of all cells instead of sorted keys.
DENSE = 32
#: Walks a row below which the plain join ships little.
FEW = 4
#: Rows of a table of ends up to which it is broadcast.
NAMES = 1 << 21

FOLDS = {"sum": (F.sum, np.add), "max": (F.max, np.maximum), "min": (F.min, np.fmin)}
WHOLE = ("tinyint", "smallint", "int", "bigint")
#: How the columns of a third factor meet.
MEETS = {"greatest": (F.greatest, np.maximum), "least": (F.least, np.minimum)}
#: name -> how, column of the left, column of the right; None counts as 1.  A third factor may follow:
#: the ``greatest`` or ``least`` of a column of the left and one of the right.
Folds = Mapping[str, tuple[str, str | None, str | None] | tuple[str, str | None, str | None, str, str, str]]


def small(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows, broadcast where it is small."""
    return F.broadcast(df) if rows <= NAMES else df


def _kept(start: Column, end: Column, pairs: str | None):
    return {None: None, "different": start != end, "ascending": start < end}[pairs]


def plain(left: DataFrame, right: DataFrame, middle: str, start: str, end: str, folds: Folds, kinds: Mapping[str, str], pairs: str | None = None) -> DataFrame:
    walks, kept = left.join(right, middle), _kept(F.col(start), F.col(end), pairs)
    one = lambda c: F.lit(1).cast("bigint") if c is None else F.col(c)
    third = lambda x: MEETS[x[0]][0](*x[1:]) if x else F.lit(1)
    made = [FOLDS[how][0](one(a) * one(b) * third(more)).cast(kinds[name]).alias(name) for name, (how, a, b, *more) in folds.items()]
    return (walks if kept is None else walks.where(kept)).groupBy(start, end).agg(*made)


def _facts(df: DataFrame, key: str, values: list[str]) -> dict:
    """Rows, null keys, range of whole keys, nulls in ``values`` and the narrowest kind of each: None where all are 1."""
    kinds = dict(df.dtypes)
    asked = {"n": F.count(F.lit(1)), "nulls": F.count_if(F.col(key).isNull())}
    if kinds[key] in WHOLE:
        asked |= {"low": F.min(key), "high": F.max(key)}
    for v in values:
        small_kind = "int" if kinds[v] in WHOLE else "float"
        fits = F.col(v).between(-(1 << 31) + 1, (1 << 31) - 1) if kinds[v] in WHOLE else F.col(v) == F.col(v).cast("float")
        asked |= {f"null {v}": F.count_if(F.col(v).isNull()), f"ones {v}": F.bool_and(F.col(v) == 1), f"{small_kind} {v}": F.bool_and(fits)}
    found = df.agg(*[c.alias(name) for name, c in asked.items()]).first().asDict()
    packed = {}
    for v in values:
        small_kind = "int" if kinds[v] in WHOLE else "float"
        packed[v] = None if found[f"ones {v}"] and kinds[v] in WHOLE else small_kind if found[f"{small_kind} {v}"] else "bigint" if kinds[v] in WHOLE else "double"
    return found | {"holes": sum(found[f"null {v}"] for v in values), "packed": packed}


def _lists(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the lists of a batch, and the flat values of each column."""
    columns = [batch.column(n) for n in names]
    return columns[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), [c.flatten().to_numpy(zero_copy_only=False) for c in columns]


def add_up(batches: Iterator[pa.RecordBatch], lefts: list[str], rights: list[str], folds: Folds, types: Mapping[str, str], pairs: str | None, piece: int, dense: int) -> Iterator[pa.RecordBatch]:
    """``_s, _e`` and the folds over the walks of all rows: lists of starts (with values ``lefts``) beside lists of ends (``rights``)."""
    rows, edges, lengths, lists, base = [], [], [], [], 0
    for batch in batches:
        n, mine = _lists(batch, ["_s", *lefts])
        m, theirs = _lists(batch, ["_e", *rights])
        rows.append(np.repeat(np.arange(base, base + len(n)), n))
        edges.append([x.copy() for x in mine])
        lengths.append(m)
        lists.append([x.copy() for x in theirs])
        base += len(n)
    if not base:
        return
    row, length = np.concatenate(rows), np.concatenate(lengths)
    start, *left = [np.concatenate(x) for x in zip(*edges)]
    end, *right = [np.concatenate(x) for x in zip(*lists)]
    del rows, edges, lengths, lists
    names, end = _compact(end)
    order = np.argsort(start, kind="stable")
    start, row, left = start[order], row[order], [x[order] for x in left]
    of_left, of_right = dict(zip(lefts, left)), dict(zip(rights, right))
    place = np.concatenate([[0], np.cumsum(length)])  # of each list
    walks = length[row]
    first = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]]))
    bounds = np.concatenate([first, [len(start)]])
    until = np.concatenate([[0], np.cumsum(walks)])[bounds]
    ids, cells = start[first], len(names)
    at = 0
    while at < len(ids):
        to = min(max(at + 1, int(np.searchsorted(until, until[at] + piece, "right")) - 1), at + max(1, piece // cells))
        lo, hi, total = bounds[at], bounds[to], until[to] - until[at]
        sums = None
        if total > piece or (to - at) * cells <= dense * total:
            sums = _Cells((to - at) * cells, folds, types)
        near = lo
        while near < hi:  # more than one turn only for a start of more walks than a piece
            upto = np.cumsum(walks[near:hi])
            far = hi if total <= piece else min(hi, near + max(1, int(np.searchsorted(upto, piece, "right"))))
            n = walks[near:far]
            pos = np.arange(n.sum()) + np.repeat(place[row[near:far]] - (np.cumsum(n) - n), n)
            local = np.searchsorted(ids[at:to], start[near:far])
            keys = np.repeat(local * cells, n) + end[pos]
            values = {}
            for name, (_, a, b, *more) in folds.items():
                x = None if a is None else np.repeat(of_left[a][near:far], n).astype(types[name])
                y = None if b is None else of_right[b][pos].astype(types[name])
                values[name] = y if x is None else x if y is None else x * y
                if more:
                    c = 1 if more[1] is None else np.repeat(of_left[more[1]][near:far], n).astype(types[name])
                    d = 1 if more[2] is None else of_right[more[2]][pos].astype(types[name])
                    z = np.broadcast_to(MEETS[more[0]][1](c, d), pos.shape)
                    values[name] = z if values[name] is None else values[name] * z
            if sums is None:
                found, made = _sorted_sums(keys, values, folds, types)
            else:
                sums.add(keys, values)
            near = far
        if sums is not None:
            found, made = sums.rows()
        u, v = ids[at + found // cells], names[found % cells]
        if pairs:
            kept = u != v if pairs == "different" else u < v
            u, v, made = u[kept], v[kept], {k: x[kept] for k, x in made.items()}
        out = pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, *made.values())], names=["_s", "_e", *made])
        for i in range(0, out.num_rows, 1 << 17):
            yield out.slice(i, 1 << 17)
        at = to


def _compact(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes ascending, and the place of each code among them."""
    low = int(codes.min())
    span = int(codes.max()) - low + 1
    if span > 8 * len(codes) + (1 << 16):
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(span, bool)
    seen[codes - low] = True
    return (np.flatnonzero(seen) + low).astype(codes.dtype), (np.cumsum(seen, dtype=np.int32) - 1)[codes - low]


class _Cells:
    """Folds of all cells of a few starts and the ends of the block."""

    def __init__(self, cells: int, folds: Folds, types: Mapping[str, str]):
        self.n, self.folds, self.types = cells, folds, types
        self.count = np.zeros(cells, np.int64)
        self.made: dict = {}

    def add(self, keys: np.ndarray, values: Mapping[str, np.ndarray | None]) -> None:
        self.count += np.bincount(keys, minlength=self.n)
        for name, (how, *_) in self.folds.items():
            x, fold = values[name], FOLDS[how][1]
            if x is None:
                continue
            if how == "sum":
                one = np.bincount(keys, x, self.n) if self.types[name] == "float64" else None
                if one is None:
                    one = np.zeros(self.n, np.int64)
                    np.add.at(one, keys, x)
                self.made[name] = self.made[name] + one if name in self.made else one
                continue
            if name not in self.made:
                whole = {"max": np.iinfo(np.int64).min, "min": np.iinfo(np.int64).max}
                self.made[name] = np.full(self.n, whole[how] if self.types[name] == "int64" else -np.inf if how == "max" else np.nan, self.types[name])
            fold.at(self.made[name], keys, x)

    def rows(self) -> tuple[np.ndarray, dict]:
        found = np.flatnonzero(self.count)
        count = self.count[found]
        made = {}
        for name, (how, *_) in self.folds.items():
            if name in self.made:
                made[name] = self.made[name][found]
            else:
                made[name] = (count if how == "sum" else np.ones_like(count)).astype(self.types[name])
        return found, made


def _sorted_sums(keys: np.ndarray, values: Mapping[str, np.ndarray | None], folds: Folds, types: Mapping[str, str]) -> tuple[np.ndarray, dict]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.concatenate([first, [len(keys)]]))
    made = {}
    for name, (how, *_) in folds.items():
        x = values[name]
        if x is None:
            made[name] = (count if how == "sum" else np.ones_like(count)).astype(types[name])
        else:
            made[name] = FOLDS[how][1].reduceat(x[order], first)
    return keys[first], made


def _packed(rows: DataFrame, keys: list[str], code: str, values: Mapping[str, str], to: str, ascending: bool = False) -> DataFrame:
    """One row a key with a list of codes and one of each value; packed, as lists of structs are several times as large."""
    listed = F.collect_list(F.struct(code, *values))
    listed = rows.groupBy(*keys).agg((F.sort_array(listed) if ascending else listed).alias(to))
    return listed.select(*keys, *[F.col(f"{to}.{c}").alias(c) for c in (code, *values)])


def totals(left: DataFrame, right: DataFrame, middle: str, start: str, end: str, folds: Folds, pairs: str | None = None) -> DataFrame:
    """``start``, ``end`` and ``folds`` over the join of ``left`` (with middle, start) and ``right`` (with middle, end).

    A fold is the sum, max or min of a column of the left times one of the right, and of a third factor (see ``Folds``).  ``pairs`` keeps all
    walks (None), those of ``different`` ends, or those whose start is below the end (``ascending``).
    Other columns differ in name.
    """
    a_names, b_names = [list(dict.fromkeys(f[j] for f in folds.values() for j in (i, i + 3) if j < len(f) and f[j])) for i in (1, 2)]
    left = cut(left.where(F.col(middle).isNotNull()).select(middle, start, *a_names), "left")
    right = cut(right.where(F.col(middle).isNotNull()).select(middle, end, *b_names), "right")
    spark, of = left.sparkSession, dict(left.dtypes) | dict(right.dtypes)
    whole = {name: all(c is None or of[c] in WHOLE for c in (*f[1:3], *f[4:])) for name, f in folds.items()}
    kinds = {name: "bigint" if x else "double" for name, x in whole.items()}
    a, b = _facts(left, start, a_names), _facts(right, end, b_names)
    degree = right.groupBy(middle).agg(F.count(F.lit(1)).alias("_walks"))
    starts = cut(left.where(F.col(start).isNotNull()).join(degree, middle).groupBy(start).agg(F.sum("_walks").alias("_walks")), "starts")
    n_starts, total, most = starts.agg(F.count(F.lit(1)), F.sum("_walks"), F.max("_walks")).first()
    if (total or 0) <= FEW * (a["n"] + b["n"]) or a["holes"] or b["holes"]:
        return plain(left, right, middle, start, end, folds, kinds, pairs)
    rest = []  # null ends differ from none and are below none
    if pairs is None and a["nulls"]:
        rest.append((left.where(F.col(start).isNull()), right))
    if pairs is None and b["nulls"]:
        rest.append((left.where(F.col(start).isNotNull()), right.where(F.col(end).isNull())))
    named = left.where(F.col(start).isNotNull()), right.where(F.col(end).isNotNull())

    size = max(LEAST, min(BLOCK, total // (2 * spark.sparkContext.defaultParallelism)))
    blocks = running_sums(starts, [], start, {"_until": "_walks"}).select(F.col(start).alias("_start"), "_walks", F.expr(f"int((_until - _walks) div {size})").alias("_block"))
    fits = all(x.get("low") is not None and -(1 << 31) < x["low"] and x["high"] < (1 << 31) for x in (a, b))
    if fits:  # whole numbers are their own codes
        blocks, coded = cut(blocks.withColumn("_s", F.col("_start").cast("int")), "blocks"), named[1].withColumn("_e", F.col(end).cast("int"))
    else:  # codes in the order of the names, so that they compare as these do
        both = named[0].select(F.col(start).alias("_name")).union(named[1].select(F.col(end).alias("_name"))).distinct()
        names = cut(running_sums(both.withColumn("_one", F.lit(1)), [], "_name", {"_no": "_one"}).select("_name", F.col("_no").cast("int").alias("_no")), "names")
        n_names = names.count()
        code = small(names, n_names)
        blocks = cut(blocks.join(code.withColumnsRenamed({"_name": "_start", "_no": "_s"}), "_start"), "blocks")
        coded = named[1].join(code.withColumnsRenamed({"_name": end, "_no": "_e"}), end)
    rows = named[0].join(small(blocks, n_starts).withColumnRenamed("_start", start), start)
    heavy = most > HEAVY * BLOCK
    if heavy:
        rest.append((rows.where(F.col("_walks") > HEAVY * BLOCK).select(*left.columns), named[1]))
        rows = rows.where(F.col("_walks") <= HEAVY * BLOCK)
    lefts, rights = [{c: k for c, k in x["packed"].items() if k} for x in (a, b)]
    thin = lambda df, packed: df.withColumns({c: F.col(c).cast(k) for c, k in packed.items()}) if packed else df
    mine = _packed(thin(rows, lefts), [middle, "_block"], "_s", lefts, "_mine")
    theirs = _packed(thin(coded, rights), [middle], "_e", rights, "_theirs", pairs == "ascending")
    dealt = mine.join(theirs, middle).drop(middle)
    if pairs == "ascending":  # a list goes to a block without the ends that are above none of its starts
        past = F.size(F.filter("_e", lambda x: x <= F.col("_low")))
        dealt = dealt.withColumn("_low", F.array_min("_s")).withColumn("_past", past).where(F.col("_past") < F.size("_e"))
        dealt = dealt.withColumns({c: F.slice(c, F.col("_past") + 1, F.size("_e") - F.col("_past")) for c in (*rights, "_e")}).drop("_low", "_past")
    # one block a partition: a task holds the lists of its block
    dealt = dealt.repartitionById(int(total // size) + 1, F.col("_block")).drop("_block")
    left_of, right_of = lambda x: x if x in lefts else None, lambda y: y if y in rights else None
    asked = {name: (how, left_of(x), right_of(y), *([more[0], left_of(more[1]), right_of(more[2])] if more else [])) for name, (how, x, y, *more) in folds.items()}
    types = {name: "int64" if x else "float64" for name, x in whole.items()}
    given = (list(lefts), list(rights), asked, types, pairs, PIECE, DENSE)

    def run(batches):
        return add_up(batches, *given)

    out = dealt.mapInArrow(run, "_s int, _e int, " + ", ".join(f"`{n}` {k}" for n, k in kinds.items()))
    if fits:
        out = out.select(F.col("_s").cast(of[start]).alias(start), F.col("_e").cast(of[end]).alias(end), *folds)
    else:
        out = out.join(code.withColumnsRenamed({"_name": start, "_no": "_s"}), "_s").join(code.withColumnsRenamed({"_name": end, "_no": "_e"}), "_e").select(start, end, *folds)
    for x, y in rest:
        out = out.unionByName(plain(x, y, middle, start, end, folds, kinds, pairs))
    return out
