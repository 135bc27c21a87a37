"""Audit of how far the sources of a language differ in their words, by sort-based streaming.

Map side: each task reads whole documents, sorts the occurrences of a block by (lang, term,
source, document) and scans the runs of that order: a run of one document counts once towards
the document frequency, its length towards the count.  So a task emits one partial run
``(lang, term, source, df, n)`` for all documents of the block, and the most frequent word of
the hottest source is a row a block, not a row a document.  Reduce side: partial runs are
repartitioned by (lang, term), sorted by source within them and merged by one scan that holds
the sources of the present term only; a term is kept when its run's document frequency
reaches ``least_docs``.  A second scan over the kept runs, headed by the totals of every
group, emits partial pair distances and the terms over the language's share.

Shares are ``p = 1 + floor(10**9 * (n + 5) / (N + 5 * V))`` in whole numbers: the quotient is
taken three decimal digits at a time, exact for totals below 2**53.

Defined cases: null text, lang and source count as ''; a document is a row, so repeated rows
(and repeated or null doc_ids) count one by one; a group whose texts hold no term still has
its shares; a language without kept terms has pairs of value 0; a lone source has no pairs; an
empty table gives an empty result; other columns are ignored.  Equal values rank by item in
the order of UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaweave.llm.common import raw_texts, slices
from metaweave.plans.scratch import cut

LEAST_DOCS = 30
TOP_TERMS = 50
#: Partial runs and distinct words that a map task holds before it hands them on.
BLOCK = 1 << 20
#: Cells of a dense block of shares.
CELLS = 1 << 20
#: Rows of an Arrow batch that is handed on.
ROWS = 1 << 14

#: Every byte but ASCII letters and those of non-ASCII characters ends a term; A-Z are lowered.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RUN = "lang string, term string, source string, df bigint, n bigint"
KEPT = "lang string, term string, source string, n bigint, head int"
PART = "lang string, source string, part string, item string, value bigint"


class _Codes(dict):
    """Keys by number, in the order in which they were first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def _run_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """The places at which a run of equal keys starts."""
    changed = np.ones(len(sorted_keys[0]), bool)
    if len(changed):
        changed[1:] = False
        for k in sorted_keys:
            changed[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(changed)


class Block:
    """The partial runs of a map task, one for each (lang, source) group and term."""

    def __init__(self):
        self.groups, self.terms = _Codes(), _Codes()
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = self.least = 0

    def add(self, groups: list[tuple[str, str]], texts: list[bytes]) -> None:
        split = [t.translate(LETTERS).split() for t in texts]
        sizes = [len(x) for x in split]
        terms = np.fromiter(map(self.terms.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
        doc = np.repeat(np.arange(len(texts)), sizes)
        group = np.array([self.groups[g] for g in groups], np.int64)
        # rows of one group are neighbours, so that documents in this order are ordered by group, too
        place = np.argsort(np.argsort(group, kind="stable"), kind="stable")
        key = np.sort(terms * len(texts) + place[doc])
        starts = _run_starts(key)  # a run: one term in one document
        n = np.diff(starts, append=len(key))
        key = key[starts]
        term, of = key // max(len(texts), 1), np.sort(group)[key % max(len(texts), 1)] if len(key) else key
        starts = _run_starts(term, of)  # a run: one term in one group
        if len(starts):
            self.held.append((term[starts] << 32 | of[starts], np.diff(starts, append=len(term)), np.add.reduceat(n, starts)))
            self.rows += len(starts)
        if self.rows > BLOCK and self.rows > 2 * self.least:
            self._merge()

    def _merge(self) -> None:
        if self.held:
            key, df, n = map(np.concatenate, zip(*self.held))
            order = np.argsort(key, kind="stable")
            key, df, n = key[order], df[order], n[order]
            starts = _run_starts(key)
            self.held = [(key[starts], np.add.reduceat(df, starts), np.add.reduceat(n, starts))]
            self.rows = self.least = len(starts)

    @property
    def full(self) -> bool:
        return self.least > BLOCK or len(self.terms) > BLOCK

    def drain(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        if self.held:
            key, df, n = self.held[0]
            words = pa.array(list(self.terms), pa.binary())
            groups = list(self.groups)
            langs, sources = pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string())
            for i in range(0, len(key), ROWS):
                part = key[i : i + ROWS]
                term, group = pa.array(part >> 32), pa.array(part & 0xFFFFFFFF)
                columns = [langs.take(group), words.take(term).cast(pa.string()), sources.take(group), df[i : i + ROWS], n[i : i + ROWS]]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["lang", "term", "source", "df", "n"])
        self.__init__()


def _partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = Block()
    for batch in slices(batches):
        block.add(list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())), raw_texts(batch))
        if block.full:
            yield from block.drain()
    yield from block.drain()


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(x).to_pylist() for x in names))


def _merged(least_docs: int):
    """The scan of partial runs in the order (lang, term, source): whole runs of kept terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, docs, sources = None, 0, []

        def close() -> None:
            if docs >= least_docs:
                out.extend((*now, source, n, int(i == 0)) for i, (source, n) in enumerate(sources))

        def take(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()))], names=["lang", "term", "source", "n", "head"]
            )

        for batch in batches:
            for lang, term, source, df, n in _columns(batch, "lang", "term", "source", "df", "n"):
                if now != (lang, term):
                    close()
                    now, docs, sources = (lang, term), 0, []
                docs += df
                if sources and sources[-1][0] == source:
                    sources[-1][1] += n
                else:
                    sources.append([source, n])
            while len(out) >= ROWS:
                yield take(out[:ROWS])
                del out[:ROWS]
        close()
        for i in range(0, len(out), ROWS):
            yield take(out[i : i + ROWS])

    return run


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, source, n, head`` of every kept term and source that has it; ``head`` is 1
    in the first row of a (lang, term)."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    runs = texts.mapInArrow(_partial_runs, RUN)
    return runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_merged(least_docs), KEPT)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, n, all_n, v``: for every group that occurs, the count of its kept terms, that
    of its language, and the language's kept terms."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counted = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("head").alias("v"))
    whole = counted.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("v").alias("v"))
    zero = F.lit(0).cast("bigint")
    joined = groups.join(counted.drop("v"), ["lang", "source"], "left").join(whole, "lang", "left")
    return joined.select("lang", "source", *[F.coalesce(F.col(c), zero).alias(c) for c in ("n", "all_n", "v")])


def shares(n: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """``1 + floor(10**9 * (n + 5) / (total + 5 * v))`` without a product beyond 64 bits."""
    over = np.maximum(np.asarray(total, np.int64) + 5 * v, 1)
    left = np.asarray(n, np.int64) + 5
    out = left // over
    for _ in range(3):
        left = left % over * 1000
        out = out * 1000 + left // over
    return out + 1


@dataclass
class _Lang:
    """The header of a language in one bucket, and the rows of shares that wait."""

    name: str
    sources: list[str]
    n: np.ndarray
    all_n: int
    v: int

    def __post_init__(self):
        self.at = {s: i for i, s in enumerate(self.sources)}
        self.most = max(1, CELLS // len(self.sources))
        self.terms: list[tuple[str, list[tuple[int, int]]]] = []
        many = len(self.sources)
        self.sums = np.zeros((many, many), np.int64) if many * many <= 4 * CELLS else None

    def flush(self) -> Iterator[tuple]:
        if not self.terms:
            return
        where = [(t, s, n) for t, (_, held) in enumerate(self.terms) for s, n in held]
        t, s, n = np.array(where, np.int64).T
        p = np.repeat(shares(0, self.n, self.v)[None, :], len(self.terms), 0)
        p[t, s] = own = shares(n, self.n[s], self.v)
        over = own - shares(np.bincount(t, n).astype(np.int64), np.int64(self.all_n), self.v)[t]
        for i in np.flatnonzero(over > 0).tolist():
            yield self.name, self.sources[s[i]], "term", self.terms[t[i]][0], int(over[i])
        for i in range(len(self.sources) - 1):
            row = np.abs(p[:, i + 1 :] - p[:, i : i + 1]).sum(0)
            if self.sums is None:
                yield from self._pairs(i, row)
            else:
                self.sums[i, i + 1 :] += row
        self.terms = []

    def _pairs(self, i: int, row: np.ndarray) -> Iterator[tuple]:
        for j, value in enumerate(row.tolist(), i + 1):
            yield self.name, self.sources[i], "pair", self.sources[j], value

    def end(self, first: bool) -> Iterator[tuple]:
        """``first``: list every pair, also those of a language without terms."""
        yield from self.flush()
        if self.sums is not None:
            if first or self.sums.any():
                for i in range(len(self.sources) - 1):
                    yield from self._pairs(i, self.sums[i, i + 1 :])
        elif first:
            for i in range(len(self.sources) - 1):
                yield from self._pairs(i, np.zeros(len(self.sources) - 1 - i, np.int64))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scan over (bucket, kind, lang, term, source): kind 0 heads a bucket with all groups."""

    def parts() -> Iterator[tuple]:
        bucket, langs, now, headers, run = None, {}, None, [], []

        def close_run() -> Iterator[tuple]:
            if run:
                of = langs[now[0]]
                of.terms.append((now[1], list(run)))
                run.clear()
                if len(of.terms) >= of.most:
                    yield from of.flush()

        def close_headers() -> None:
            for lang, source, n, all_n, v in headers:
                langs.setdefault(lang, ([], [], all_n, v))
                langs[lang][0].append(source)
                langs[lang][1].append(n)
            for lang, (sources, n, all_n, v) in list(langs.items()):
                langs[lang] = _Lang(lang, sources, np.array(n, np.int64), all_n, v)
            headers.clear()

        def close_bucket() -> Iterator[tuple]:
            yield from close_run()
            if headers:
                close_headers()
            for of in langs.values():
                yield from of.end(bucket == 0)
            langs.clear()

        for batch in batches:
            for b, kind, lang, term, source, n, all_n, v in _columns(batch, "bucket", "kind", "lang", "term", "source", "n", "all_n", "v"):
                if b != bucket:
                    yield from close_bucket()
                    bucket, now = b, None
                if kind == 0:
                    headers.append((lang, source, n, all_n, v))
                    continue
                if headers:
                    close_headers()
                if now != (lang, term):
                    yield from close_run()
                    now = (lang, term)
                run.append((langs[lang].at[source], n))
        yield from close_bucket()

    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    rows: list[tuple] = []
    for part in parts():
        rows.append(part)
        if len(rows) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["lang", "source", "part", "item", "value"])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources of a language
    (part ``pair``, all ranks) and the terms over its share (part ``term``, ranks up to ``top``)."""
    spark = docs.sparkSession
    kept = cut(kept_terms(docs, least_docs), "kept-terms")
    groups = cut(group_totals(docs, kept), "group-totals")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    zero, none = F.lit(0).cast("bigint"), F.lit("")
    headers = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))  # each bucket gets its copy
    rows = kept.select(
        F.pmod(F.xxhash64("lang", "term"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).alias("kind"), "lang", "term", "source", "n", zero.alias("all_n"), zero.alias("v")
    ).unionByName(headers.withColumns({"kind": F.lit(0), "term": none}))
    found = rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind", "lang", "term", "source").mapInArrow(_compared, PART)
    found = cut(found, "compared")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return both.withColumn("rank", F.row_number().over(order)).unionByName(terms)
