"""Connected components by alternating star contraction.

Every round replaces each vertex's links by links to the smallest vertex it knows
(large star), then points all smaller neighbours at the smallest one (small star).  The
edge list never grows, the number of rounds is logarithmic in practice even for long
chains, and the minimum per vertex is a partial aggregate. The joins ship every link of a hub;
adaptive execution splits such skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.plans.scratch import cut, release


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


#: Links that a task joins at once.
LINKS = 1 << 20


def _stars(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """A link from each node to one of its component: fewer links than nodes."""
    coded = pa.concat_arrays([u, v]).dictionary_encode()
    a, b = coded.indices.to_numpy()[: len(u)], coded.indices.to_numpy()[len(u) :]
    label = np.arange(len(coded.dictionary))
    while len(apart := np.flatnonzero(label[a] != label[b])):
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label != (up := label[label])).any():
            label = up
    far = np.flatnonzero(label != np.arange(len(label)))
    return coded.dictionary.take(pa.array(far)), coded.dictionary.take(pa.array(label[far]))


def thinned(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``u, v``: fewer links than nodes from each task, which join the same nodes."""
    kind = dict(links.dtypes)[u]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0), batch.column(1)))
            n += batch.num_rows
            if n >= LINKS + (len(held[0][0]) if len(held) > 1 else 0):
                held = [_stars(*[pa.concat_arrays(x) for x in zip(*held)])]
                n = len(held[0][0])
        if held:
            yield pa.RecordBatch.from_arrays(list(_stars(*[pa.concat_arrays(x) for x in zip(*held)])), names=["u", "v"])

    return links.select(u, v).where(F.col(u) != F.col(v)).mapInArrow(run, f"u {kind}, v {kind}")


def star_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for every endpoint of ``links``; component = smallest node.

    Nulls and self links are ignored; an endpoint that has only a self link is not listed.
    """
    raw = links.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a <> b")
    cur = cut(
        raw.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star"
    )
    seen = _fingerprint(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
            .where("u <> v")
            .distinct()
        )
        nxt = cut(small, "star")
        now = _fingerprint(nxt)
        release(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
