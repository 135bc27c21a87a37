"""Exact order statistics of a numeric column by histogram refinement.

No column is sorted and no buffer of values is kept.  Each round counts the rows of a few
intervals by equal buckets, narrows each asked place to the bucket that holds it, and takes that
bucket's own extremes as the next interval; a place is found when its interval is one value.
The driver sees at most ``BUCKETS`` rows for each interval, whatever the number of rows.  An
interval shrinks by that factor a round, so doubles need six rounds at most, often two.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def at_places(df: DataFrame, value: str, places: Iterable[int]) -> dict[int, float]:
    """The values at these places (from 0) of the sorted column; nulls and NaN are left out, and so
    is a place beyond the end.  The frame is read once a round: write it before if it is costly."""
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).where("v is not null and not isnan(v)")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}
    # interval -> places in it, and how many rows lie before it
    asked = {(low, high): ([p for p in sorted(set(places)) if 0 <= p < n], 0)} if n else {}
    while asked:
        for lo, hi in [x for x in asked if x[0] == x[1]]:
            found |= dict.fromkeys(asked.pop((lo, hi))[0], lo)
        asked = {k: x for k, x in asked.items() if x[0]}
        if not asked:
            break
        bucket = F.lit(None).cast("int")
        for i, (lo, hi) in enumerate(asked):
            part = F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * BUCKETS)  # halves: the width may be beyond a double
            part = F.greatest(part, F.lit(int(lo == -math.inf)))
            at = F.when(F.col("v") >= hi, BUCKETS - 1).when(F.col("v") <= lo, 0).otherwise(F.least(part, F.lit(BUCKETS - 1))).cast("int")
            bucket = F.when((F.col("v") >= lo) & (F.col("v") <= hi), at + i * BUCKETS).otherwise(bucket)
        counted = rows.withColumn("b", bucket).where("b is not null").groupBy("b").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        by: dict[int, list] = {}
        for r in sorted(counted.collect()):
            by.setdefault(r["b"] // BUCKETS, []).append(r)
        narrowed: dict[tuple[float, float], tuple[list[int], int]] = {}
        for i, (wanted, before) in enumerate(asked.values()):
            for r in by.get(i, []):
                here = [p for p in wanted if before <= p < before + r["c"]]
                if here:
                    narrowed[r["lo"], r["hi"]] = (here, before)
                before += r["c"]
        asked = narrowed
    return found


def interpolated(df: DataFrame, value: str, points: Sequence[float]) -> list[float | None]:
    """Percentiles with linear interpolation between the two places around ``p * (n - 1)``."""
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return [None] * len(points)
    at = [p * (n - 1) for p in points]
    held = at_places(df, value, [q for x in at for q in (int(x), min(int(x) + 1, n - 1))])
    out = []
    for x in at:
        lo, hi = int(x), min(int(x) + 1, n - 1)
        out.append(held[lo] if x == lo else (lo + 1 - x) * held[lo] + (x - lo) * held[hi])
    return out
