"""Sparse products: aggregates over the walks a - m - b, without a shuffle of the walks.

A join on the middle and a group by both ends ships every walk, and walks outnumber the rows by
far.  Here the starts are cut, in their order, into blocks of about equal numbers of walks.  A
block gets its own rows of each middle and, once, the whole list of the middle's ends.  So all
walks of a start lie in the block's task, and the group by both ends needs no exchange.  A list
goes at most once to a block; where near starts share middles hardly more than the input is
shipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaweave.operators.ordered import running_sums
from metaweave.plans.scratch import cut

#: Walks of a block, and how few are worth a task of their own.
BLOCK, LEAST = 1 << 22, 1 << 16
#: Starts with more blocks than this are joined plainly: their walks meet few starts, so that they
#: are added up before the shuffle.
HEAVY = 8
#: Walks a row below which the plain join ships little.
FEW = 4


def plain(left: DataFrame, right: DataFrame, middle: str, start: Sequence[str], end: str, aggregates: Sequence[Column], where: Column | None = None) -> DataFrame:
    walks = left.join(right, middle)
    return (walks if where is None else walks.where(where)).groupBy(*start, end).agg(*aggregates)


def product(left: DataFrame, right: DataFrame, middle: str, start: Sequence[str], end: str, aggregates: Sequence[Column], where: Column | None = None) -> DataFrame:
    """``start`` (one or more columns), ``end`` and ``aggregates`` over the join of ``left`` (with middle, start) and ``right``
    (with middle, end), of the walks that ``where`` keeps.  Other columns differ in name."""
    left, right = cut(left.where(F.col(middle).isNotNull()), "left"), cut(right.where(F.col(middle).isNotNull()), "right")
    spark = left.sparkSession
    degree = right.groupBy(middle).agg(F.count(F.lit(1)).alias("_walks"))
    named = F.struct(*start)  # a struct: a null start has an order and a place too
    starts = cut(left.join(degree, middle).groupBy(named.alias("_start")).agg(F.sum("_walks").alias("_walks")), "starts")
    total, most = starts.agg(F.sum("_walks"), F.max("_walks")).first()
    if (total or 0) <= FEW * (left.count() + right.count()):
        return plain(left, right, middle, start, end, aggregates, where)
    size = max(LEAST, min(BLOCK, total // (4 * spark.sparkContext.defaultParallelism)))
    blocks = running_sums(starts, [], "_start", {"_until": "_walks"})
    number = F.monotonically_increasing_id()  # written with its row, so it stays
    blocks = cut(blocks.select("_start", "_walks", F.expr(f"(_until - _walks) div {size}").alias("_block"), number.alias("_from")), "blocks")
    rows = left.withColumn("_start", named).join(blocks, "_start").drop("_start")
    heavy = most > HEAVY * BLOCK
    kinds = dict(left.dtypes) | dict(right.dtypes)
    coded = any(kinds[c] == "string" for c in [*start, end])
    names, keys, listed = None, [*start, end], right
    if coded:  # grouped by numbers, several times as fast as by strings
        names = cut(right.select(end).distinct().withColumn("_to", number), "names")
        listed = right.join(names.withColumnRenamed(end, "_end"), F.col(end).eqNullSafe(F.col("_end"))).drop("_end")
        keys = ["_from", "_to"]
    ends = [c for c in listed.columns if c != middle]
    begins = [*[c for c in left.columns if c != middle], *(["_from"] if coded else [])]
    light = rows.where(F.col("_walks") <= HEAVY * BLOCK) if heavy else rows
    mine = light.repartition(middle).groupBy(middle, "_block").agg(F.collect_list(F.struct(*begins)).alias("_mine"))
    theirs = listed.groupBy(middle).agg(F.collect_list(F.struct(*ends)).alias("_theirs"))
    # a number of partitions: by their bytes AQE would put blocks together, each of millions of walks
    dealt = mine.join(theirs, middle).repartition(total // size + 1, "_block")
    walks = dealt.select("_block", middle, F.explode("_mine").alias("_a"), "_theirs").select("_block", middle, "_a", F.explode("_theirs").alias("_b"))
    walks = walks.select("_block", middle, "_a.*", "_b.*")
    out = (walks if where is None else walks.where(where)).groupBy("_block", *keys).agg(*aggregates).drop("_block")
    if coded:
        made = [c for c in out.columns if c not in keys]
        out = out.join(blocks.select("_from", "_start.*"), "_from").join(names, "_to").select(*start, end, *made)
    if heavy:
        out = out.unionByName(plain(rows.where(F.col("_walks") > HEAVY * BLOCK).drop("_walks", "_block", "_from"), right, middle, start, end, aggregates, where))
    return out
