"""Convolutional toxicity classifier in numpy.

A word's embedding is the sum of hashed rows for the word, its first four and five letters
and its last four (so unseen forms of a stem are known).  Filters of widths 1 to 3 run over
the words of the whole text, each is max-pooled, and a logistic layer gives the score.
Training is minibatch Adagrad on all labelled documents of the training fold: in each epoch
every task goes over its own rows, and the parameters are then averaged.  The first embedding
dimension starts from the feature's signed, damped chi statistic in all of them, which a
max-pooled filter can use at once; everything is then fitted together.  A fifth of the rows, by
their texts, is not fitted and calibrates a threshold per language; language picks the threshold
and is never an input of the score.

Texts stay on the executors; the driver holds the model and counts of the fixed number of
buckets.  Rows of a repeated doc_id count each.  Scoring covers every document and every word.

Defined cases: null and empty texts have no words and score what the bias says; null or
conflicting labels (several rows for an id: the largest counts); without positive or
without negative labels every score is the base rate (0 without labels); an empty table
gives an empty result; extra columns are ignored; a language without enough calibration
positives takes the threshold of all languages together.
"""

from __future__ import annotations

import copy
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from metaweave.llm.common import fold, forget_shuffles, give_back, kept, known_by, raw_texts, slices
from metaweave.operators.ordered import running_sums
from metaweave.plans.scratch import cut, release

BUCKETS = 1 << 18
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Labelled rows of a file, about, and those that a task holds at once.
SHARD_ROWS = 6000
CUTOFF = 0.3
#: Distinct words whose embeddings a worker keeps.
WORDS_KEPT = 1 << 16

_WORD = re.compile(r"[^\W\d_]+")


def words_of(raw: bytes) -> list[str]:
    return _WORD.findall(raw.decode().lower())


def features(word: str) -> tuple[int, int, int, int]:
    """Buckets of the word and of its start and end; the classes hash apart."""
    return tuple(
        zlib.crc32(part.encode()) % BUCKETS
        for part in ("w" + word, "4" + word[:4], "5" + word[:5], "e" + word[-4:])
    )


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    filters: dict[int, np.ndarray]  # width -> (width * DIM) x FILTERS
    offsets: dict[int, np.ndarray]
    out: np.ndarray  # len(WIDTHS) * FILTERS
    bias: float
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled activations of one text's embeddings and where each was found."""
        best = np.zeros((len(WIDTHS), FILTERS), np.float32)
        place = np.full((len(WIDTHS), FILTERS), -1, np.int64)
        for k, width in enumerate(WIDTHS):
            n = len(x) - width + 1
            if n < 1:
                continue
            w = self.filters[width]
            act = x[:n] @ w[:DIM]
            for j in range(1, width):
                act += x[j : j + n] @ w[j * DIM : (j + 1) * DIM]
            at = act.argmax(axis=0)
            top = act[at, np.arange(FILTERS)] + self.offsets[width]
            best[k] = np.maximum(top, 0)
            place[k] = np.where(top > 0, at, -1)
        return best, place

    def score(self, x: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        z = float(self.pooled(x)[0].ravel() @ self.out + self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Embedder:
    """Embeddings of words, looked up once per distinct word."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.empty((1 << 12, DIM), np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.at) > WORDS_KEPT:
            self.clear()
        fresh = [w for w in set(words) if w not in self.at]
        if fresh:
            start = len(self.at)
            need = start + len(fresh)
            if need > len(self.rows):
                grown = np.empty((max(need, 2 * len(self.rows)), DIM), np.float32)
                grown[:start] = self.rows[:start]
                self.rows = grown
            ids = np.array([features(w) for w in fresh])
            self.rows[start:need] = self.table[ids].sum(axis=1)
            self.at.update(zip(fresh, range(start, need)))
        at = self.at
        return self.rows[[at[w] for w in words]] if words else np.empty((0, DIM), np.float32)


@dataclass
class Fit:
    """A model in training with the sums of squares of Adagrad."""

    model: Model
    squares: dict[str, np.ndarray]

    def dense(self) -> list[np.ndarray]:
        """All parameters but the table, and their squares."""
        model, squares = self.model, self.squares
        held = [model.out, squares["out"], model.bias, squares["bias"]]
        for w in WIDTHS:
            held += [model.filters[w], squares[f"f{w}"], model.offsets[w], squares[f"o{w}"]]
        return held

    def rows(self, touched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and rows of ``DIM + 1`` numbers: buckets with their squares, then the dense parameters."""
        flat = np.concatenate([np.ravel(x) for x in self.dense()]).astype(np.float32)
        flat = np.pad(flat, (0, -len(flat) % (DIM + 1))).reshape(-1, DIM + 1)
        table = np.column_stack([self.model.table[touched], self.squares["table"][touched]])
        return np.concatenate([touched, BUCKETS + np.arange(len(flat))]), np.concatenate([table, flat])

    def take(self, ids: np.ndarray, values: np.ndarray) -> None:
        """Put back what :meth:`rows` gave."""
        table = ids < BUCKETS
        self.model.table[ids[table]] = values[table, :DIM]
        self.squares["table"][ids[table]] = values[table, DIM]
        flat = values[~table][np.argsort(ids[~table])].ravel()
        parts, at = [], 0
        for x in self.dense():
            n = np.size(x)
            parts.append(flat[at : at + n].reshape(np.shape(x)).astype(np.float32))
            at += n
        model, squares = self.model, self.squares
        model.out, squares["out"], model.bias, squares["bias"] = parts[0], parts[1], float(parts[2]), parts[3]
        for w, i in zip(WIDTHS, range(4, len(parts), 4)):
            model.filters[w], squares[f"f{w}"], model.offsets[w], squares[f"o{w}"] = parts[i : i + 4]


def begin(positive: np.ndarray, total: np.ndarray, rate: float, seed: int = 7) -> Fit:
    """Before the first epoch: ``positive`` and ``total`` training texts of each bucket, and their share of label 1."""
    rng = np.random.default_rng(seed)
    model = Model(
        table=np.zeros((BUCKETS, DIM), np.float32),
        filters={w: (rng.standard_normal((w * DIM, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS},
        offsets={w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        out=(rng.random(len(WIDTHS) * FILTERS) * 0.2).astype(np.float32),
        bias=float(np.log(rate / (1 - rate))),
    )
    chi = (positive - total * rate) / np.sqrt(total * rate * (1 - rate) + 1)
    model.table[:] = rng.standard_normal((BUCKETS, DIM)).astype(np.float32) * 0.01
    model.table[total == 0] = 0
    model.table[:, 0] = np.sign(chi) * np.log1p(np.maximum(np.abs(chi) - 1.5, 0))
    for w in WIDTHS:
        model.filters[w][:: DIM, : FILTERS // 2] += 1.0 / w
        model.offsets[w][: FILTERS // 2] = -1.0
    squares = {"out": np.full_like(model.out, 1e-6), "bias": np.float32(1e-6), "table": np.full(BUCKETS, 1e-6, np.float32)}
    for w in WIDTHS:
        squares[f"f{w}"] = np.full_like(model.filters[w], 1e-6)
        squares[f"o{w}"] = np.full_like(model.offsets[w], 1e-6)
    return Fit(model, squares)


def coded(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets of the distinct words, and each text as places among them."""
    known: dict[str, int] = {}
    feats: list[tuple[int, int, int, int]] = []
    docs = []
    for raw in texts:
        ids = []
        for w in words_of(raw):
            i = known.get(w)
            if i is None:
                i = known[w] = len(feats)
                feats.append(features(w))
            ids.append(i)
        docs.append(np.array(ids, np.int64))
    return np.array(feats, np.int64).reshape(-1, 4), docs


def one_epoch(fit: Fit, texts: list[bytes], y: np.ndarray, rate: float, epoch: int, rng: np.random.Generator) -> np.ndarray:
    """Minibatches over the texts in drawn order; the buckets that they hold."""
    model, squares = fit.model, fit.squares
    table_ids, docs = coded(texts)
    weight = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate))
    rate_now = 0.05 / (1 + epoch)
    order = rng.permutation(len(docs))
    for start in range(0, len(order), 32):
        batch = order[start : start + 32]
        g_out, g_bias = np.zeros_like(model.out), 0.0
        g_f = {w: np.zeros_like(model.filters[w]) for w in WIDTHS}
        g_o = {w: np.zeros_like(model.offsets[w]) for w in WIDTHS}
        rows, row_grads = [], []
        for i in batch:
            ids = table_ids[docs[i]]
            x = model.table[ids].sum(axis=1) if len(ids) else np.empty((0, DIM), np.float32)
            pooled, place = model.pooled(x)
            z = float(pooled.ravel() @ model.out + model.bias)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i]
            g_out += error * pooled.ravel()
            g_bias += error
            back = (error * model.out).reshape(len(WIDTHS), FILTERS)
            for k, w in enumerate(WIDTHS):
                for f in np.flatnonzero(place[k] >= 0):
                    at = place[k, f]
                    window = x[at : at + w].ravel()
                    g_f[w][:, f] += back[k, f] * window
                    g_o[w][f] += back[k, f]
                    gx = (back[k, f] * model.filters[w][:, f]).reshape(w, DIM)
                    rows.append(ids[at : at + w])
                    row_grads.append(np.repeat(gx[:, None, :], 4, axis=1))
        n = len(batch)

        def step(name: str, g):
            g = g / n
            squares[name] = squares[name] + g * g
            return rate_now * g / np.sqrt(squares[name])

        model.out -= step("out", g_out)
        model.bias -= float(step("bias", g_bias))
        for w in WIDTHS:
            model.filters[w] -= step(f"f{w}", g_f[w])
            model.offsets[w] -= step(f"o{w}", g_o[w])
        if rows:
            at = np.concatenate([r.ravel() for r in rows])
            g = np.concatenate([r.reshape(-1, DIM) for r in row_grads]) / n
            hit, where = np.unique(at, return_inverse=True)
            summed = np.zeros((len(hit), DIM), np.float32)
            np.add.at(summed, where, g)
            squares["table"][hit] += (summed * summed).mean(axis=1)
            model.table[hit] -= rate_now * 0.2 * summed / np.sqrt(squares["table"][hit])[:, None]
    return np.unique(table_ids)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts and labels, at most so many rows at a time."""
    texts, marks = [], []
    for batch in slices(batches):
        texts += raw_texts(batch)
        marks += batch.column("_y").to_pylist()
        while len(texts) >= rows:
            yield texts[:rows], np.asarray(marks[:rows], np.float32)
            texts, marks = texts[rows:], marks[rows:]
    if texts:
        yield texts, np.asarray(marks, np.float32)


def labelled(docs: DataFrame, labels: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """``text, lang, _y, calibrate`` of all labelled rows outside the held-out fold, written in files of about so many rows."""
    marks = labels.where(F.col("toxic").isNotNull() & (fold("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    marks = cut(marks, "marks")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    n = known_by(docs.select("doc_id"), marks, ["doc_id"], "inner").count()
    shards = -(-n // rows) or 1
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = known_by(docs.select("doc_id", text.alias("text"), F.coalesce(lang, F.lit("")).alias("lang")), marks, ["doc_id"], "inner")
    draw = F.xxhash64("doc_id")
    found = found.repartitionById(shards, F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")).sortWithinPartitions(draw, "doc_id", "text")
    return cut(found.select("text", "lang", F.col("_y").cast("int").alias("_y"), (F.crc32(F.col("text").cast("binary")) % 5 == 0).alias("calibrate")), "labelled")


def _bucket_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows with label 1 and rows that hold each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positive, total = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for texts, y in _chunks(batches, SHARD_ROWS):
            table_ids, docs = coded(texts)
            for ids, mark in zip(docs, y):
                held = np.unique(table_ids[np.unique(ids)])
                total[held] += 1
                positive[held] += int(mark > 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(positive[at]), pa.array(total[at])], names=["id", "positive", "total"])

    found = rows.select("text", "_y").mapInArrow(run, "id bigint, positive bigint, total bigint")
    summed = found.groupBy("id").agg(F.sum("positive").alias("positive"), F.sum("total").alias("total")).toArrow()
    positive, total = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = summed["id"].to_numpy()
    positive[at], total[at] = summed["positive"].to_numpy(), summed["total"].to_numpy()
    return positive, total


def _next_epoch(fit: Fit, rows: DataFrame, rate: float, epoch: int, seed: int) -> None:
    """Each task trains on its rows, some thousands at a time, from where all stand; parameters are
    averaged by rows, those of a bucket over the tasks that hold it."""
    shared = rows.sparkSession.sparkContext.broadcast(fit)
    names = [f"v{i}" for i in range(DIM + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, touched, n = None, np.zeros(BUCKETS, bool), 0
        rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
        for texts, y in _chunks(batches, SHARD_ROWS):
            mine = mine or copy.deepcopy(shared.value)
            touched[one_epoch(mine, texts, y, rate, epoch, rng)] = True
            n += len(texts)
        if n:
            ids, values = mine.rows(np.flatnonzero(touched))
            columns = [pa.array(ids), pa.array(np.full(len(ids), n, np.float64)), *[pa.array(np.ascontiguousarray(v)) for v in values.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", *names])

    made = rows.select("text", "_y").mapInArrow(run, "id bigint, n double, " + ", ".join(f"{v} float" for v in names))
    mean = made.groupBy("id").agg(*[(F.sum(F.col(v) * F.col("n")) / F.sum("n")).cast("float").alias(v) for v in names]).toArrow()
    fit.take(mean["id"].to_numpy(), np.column_stack([mean[v].to_numpy() for v in names]))
    shared.destroy()


def _calibrated(rows: DataFrame, model: Model, least: int = 5) -> dict[str, float]:
    """Per language, and under "" for all: the cut with the best F1, mid-way in its gap."""
    scored = _with_score(rows, model, "_s").select("lang", F.col("_s").alias("s"), (F.col("_y") > 0).cast("bigint").alias("y"))
    both = scored.where("lang <> ''").unionAll(scored.select(F.lit("").alias("lang"), "s", "y"))
    cuts = cut(both.groupBy("lang", (-F.col("s")).alias("less")).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")), "scores")
    reached = running_sums(cuts, ["lang"], "less", {"hits": "y", "place": "n"})
    sums = cuts.groupBy("lang").agg(F.sum("y").alias("all")).where(F.col("all") >= least)
    f1 = 2 * F.col("hits") / (F.col("place") + F.col("all"))
    best = reached.join(F.broadcast(sums), "lang").groupBy("lang").agg(F.max_by("less", F.struct(f1, -F.col("less"))).alias("at"))
    below = cuts.join(F.broadcast(best), "lang").groupBy("lang").agg(F.first("at").alias("at"), F.min(F.when(F.col("less") > F.col("at"), F.col("less"))).alias("next"))
    found = {r["lang"]: float(np.clip((-r["at"] - (r["next"] or 0.0)) / 2, 0.1, 0.9)) for r in below.collect()}  # a row a language
    return {"": 0.5} | found


def train(docs: DataFrame, labels: DataFrame, epochs: int = 4, seed: int = 7) -> Model:
    """Fit on all labelled rows outside the held-out fold."""
    rows = labelled(docs, labels)
    seen = {(r["calibrate"], r["_y"] > 0): r["n"] for r in rows.groupBy("calibrate", "_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = {y: seen.get((False, y), 0) + seen.get((True, y), 0) for y in (True, False)}
    if not (every[True] and every[False]):
        model = begin(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.5, seed).model
        model.constant = float(every[True] > 0)
        return model
    fitted, calibrate = rows.where("NOT calibrate"), rows.where("calibrate")
    if not (seen.get((False, True)) and seen.get((False, False))):
        fitted = calibrate = rows
    marks = {y: seen.get((False, y), 0) for y in (True, False)} if fitted is not rows else every
    rate = marks[True] / (marks[True] + marks[False])
    fit = begin(*_bucket_counts(fitted), rate, seed)
    for epoch in range(epochs):
        _next_epoch(fit, fitted, rate, epoch, seed)
    model = fit.model
    shift = np.log((0.5 / rate) / (0.5 / (1 - rate)))
    model.bias -= float(shift) * 0.5  # the classes were weighted; give part of the prior back
    model.thresholds = _calibrated(calibrate, model)
    release(rows)
    give_back()
    forget_shuffles(docs.sparkSession)
    return model


def _with_score(docs: DataFrame, model: Model, out: str) -> DataFrame:
    """``docs`` with a score in a column ``out``."""
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = kept(name, lambda: Embedder(shared.value.table))
        for batch in slices(batches):
            got = pa.array([float(shared.value.score(embed(words_of(raw)))) for raw in raw_texts(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def _with_scores(docs: DataFrame, model: Model) -> tuple[DataFrame, str, str]:
    """``docs`` with a score and the threshold of its language, in columns of fresh names."""
    name = uuid.uuid4().hex
    out, cut = f"score_{name}", f"threshold_{name}"
    found = _with_score(docs, model, out)
    limit = F.lit(model.thresholds.get("", 0.5))
    for one, value in model.thresholds.items():
        limit = F.when(F.col("lang").cast("string") == one, F.lit(value)).otherwise(limit) if one and "lang" in docs.columns else limit
    return found.withColumn(cut, limit), out, cut


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, threshold, toxic`` of every document."""
    found, score, cut = _with_scores(docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else [])), model)
    return found.select("doc_id", F.col(score).alias("score"), F.col(cut).alias("threshold"), (F.col(score) >= F.col(cut)).alias("toxic"))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, toxic`` for every document."""
    found = score(docs, train(docs, labels))
    return found.select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= CUTOFF).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the threshold of their language, with their columns unchanged."""
    found, score, cut = _with_scores(docs, train(docs, labels))
    return found.where(F.col(score) < F.col(cut)).select(*docs.columns)
