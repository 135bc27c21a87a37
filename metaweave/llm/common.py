"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.plans.scratch import cut

#: Names of the locator of a row, which no table uses for a column of its own.
LOCATOR = ["_dedup_file", "_dedup_row"]
#: Rows of a narrow table up to which it is broadcast; larger ones are joined by a shuffle.
FEW_ROWS = 1 << 17
#: A key with more than one in so many rows is hot, thus there are fewer hot keys than this.
HOT_SHARE = 1 << 12


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in each Arrow batch of this session, unless it has fewer already: some texts
    are long, and a batch is held whole on both sides of a Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a registered query."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id is in fold null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(name)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def with_locator(docs: DataFrame) -> DataFrame:
    """Adds the columns ``LOCATOR``; a frame that isn't a plain file scan is written first."""
    try:
        return docs.withColumns(dict(zip(LOCATOR, (F.col("_metadata.file_path"), F.col("_metadata.row_index")))))
    except Exception as error:
        if not re.search("UNRESOLVED|FIELD_NOT_FOUND", str(error)):
            raise
    return with_locator(cut(docs, "contents"))


def known_by(rows: DataFrame, narrow: DataFrame, on: list[str], how: str, few: int = FEW_ROWS) -> DataFrame:
    """``rows`` joined with a written narrow table of distinct ``on``, which is broadcast if it has at
    most ``few`` rows, so that texts are shuffled only where it is larger."""
    return rows.join(F.broadcast(narrow) if narrow.count() <= few else narrow, on, how)


def hot_join(rows: DataFrame, groups: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """``rows`` joined with ``groups`` (one row a key, ``n`` rows each), both written tables.

    Groups that hold more than one in ``share`` of all rows are fewer than ``share``: they are
    broadcast and their rows stay where they are. Only the rest is shuffled by key.
    """
    total = groups.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = groups.where(F.col("n") > total // share)
    few = F.broadcast(hot)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col("n") <= total // share), key)
    return rows.join(few, key).unionByName(rest)


_HELD: list[tuple[object, object]] = []


def kept(name: object, make: Callable[[], object]):
    """What ``make`` gives, kept in this worker until another name is asked for.

    Workers serve one operator after another; one slot for all of them bounds their memory.
    """
    if not _HELD or _HELD[0][0] != name:
        _HELD.clear()
        give_back()
        _HELD.append((name, make()))
    return _HELD[0][1]


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, as it does
    whenever the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Hand memory that this worker has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)
