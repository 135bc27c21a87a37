"""Exact deduplication as a stateful stream.

Arrivals ``(digest, doc_id, locator)`` stream through a keyed aggregation whose state lives
in RocksDB on the executors' disks, is snapshotted to the shared folder and never expires.
The state of a digest is the stable identifier that stays (smallest doc_id, then locator),
the locator of its content and the number of arrivals.  On a hit (more than one arrival)
the full normalised bytes are compared with those of the row that stays; digests whose
bytes differ are regrouped by the bytes themselves.  All of it is DataFrame operations.

Texts are equal when identical after each ``[\\x20\\x09-\\x0D]+`` is replaced by a space.

A hot text costs one state row per task before the shuffle (partial aggregation) and the
comparison is salted by group size, so its copies spread over many tasks.

Defined cases: null text counts as empty; a null doc_id stays only where its group has no
other; of rows with equal text and doc_id one stays, chosen by locator; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.llm.common import FEW_ROWS, LOCATOR, hot_join, known_by, with_locator
from metaweave.plans.scratch import cut, release, remove, scratch_path

#: Copies of one text that one task compares with the row that stays.
SALT_ROWS = 512

#: State on disk; without preallocated files, which cost megabytes in each of many partitions,
#: and with so much memory for all partitions of an executor.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
}


def normalised(text: str = "text") -> Column:
    """The text with each run of ASCII white space replaced by one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def arrivals(docs: DataFrame, digest=sha256) -> DataFrame:
    """What streams: one narrow row per document."""
    return docs.select("doc_id", "_dedup_file", "_dedup_row", digest(normalised()).alias("digest"))


def state_of(stream: DataFrame) -> DataFrame:
    """The streaming aggregation: per digest the row that stays and the number of arrivals.

    ``stream`` may be any streaming frame with the columns of :func:`arrivals`.
    """
    return stream.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_dedup_file", "_dedup_row")).alias("stays"),
        F.count(F.lit(1)).alias("n"),
    )


def run_stream(spark: SparkSession, path: str, schema, checkpoint: str, out: str) -> None:
    """Take in everything new below ``path``; ``out``/v=N holds the state after batch N.

    Restarting with the same checkpoint resumes with the retained state. The settings of the
    state store are those of a session of its own.
    """
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    for k, v in _STATE.items():
        own.conf.set(k, v)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v={number}")

    query = (
        state_of(own.readStream.schema(schema).parquet(path))
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@dataclass
class Deduplicated:
    #: one row per document: doc_id, _dedup_file, _dedup_row, digest, keep_id, n, kept
    rows: DataFrame
    #: the documents with their locators
    docs: DataFrame


def deduplicate(docs: DataFrame, digest=sha256) -> Deduplicated:
    spark = docs.sparkSession
    located = with_locator(docs)
    came = cut(arrivals(located, digest), "arrivals")
    states, checkpoint = scratch_path(spark, "state"), scratch_path(spark, "stream")
    run_stream(spark, came._metaweave_path, came.schema, checkpoint, states)
    shape = state_of(came).schema
    if any(True for _ in _versions(spark, states)):
        newest = max(_versions(spark, states), key=lambda v: int(v.rpartition("=")[2]))
        state = spark.read.schema(shape).parquet(newest)
    else:  # nothing arrived
        state = spark.createDataFrame([], shape)
    remove(spark, checkpoint)
    rows = cut(_rows(came, state), "decided")
    differ = _differing(located, rows)
    if differ is not None:
        own = located.select("doc_id", "_dedup_file", "_dedup_row", digest(normalised()).alias("digest"), normalised().alias("text"))
        again = cut(own.join(differ, "digest", "left_semi"), "differing")
        by_bytes = _rows(again.drop("digest").withColumnRenamed("text", "digest"), state_of(again.drop("digest").withColumnRenamed("text", "digest")))
        by_bytes = by_bytes.withColumn("digest", digest(F.col("digest")))
        rows = rows.join(differ, "digest", "left_anti").select(*by_bytes.columns).unionByName(by_bytes)
    return Deduplicated(rows, located)


def _versions(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(x.getPath().toString()) for x in fs.listStatus(target)] if fs.exists(target) else []


def _rows(came: DataFrame, state: DataFrame) -> DataFrame:
    """Both are written tables."""
    return hot_join(came, state, "digest").select(
        "doc_id",
        *LOCATOR,
        "digest",
        F.col("stays.doc_id").alias("keep_id"),
        "n",
        ((F.col("stays._dedup_file") == F.col("_dedup_file")) & (F.col("stays._dedup_row") == F.col("_dedup_row"))).alias("kept"),
    )


def _differing(located: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Digests under which not all bytes equal those of the row that stays, or None.

    The hits are known by their place before any text is read, so that texts without a copy
    don't move.
    """
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    hits = cut(rows.where("n > 1").select(*LOCATOR, "digest", "kept", salts.alias("salts")), "hits")
    few = hits.count() <= FEW_ROWS
    found = cut(located.select(*LOCATOR, normalised().alias("bytes")).join(F.broadcast(hits) if few else hits, LOCATOR), "hit_texts")
    own = found.where("kept").select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("bytes").alias("own"))
    others = found.where("not kept").select("digest", F.pmod(F.xxhash64(*LOCATOR), F.col("salts")).cast("int").alias("salt"), "bytes")
    differ = cut(others.join(own, ["digest", "salt"]).where("bytes <> own").select("digest").distinct(), "differ")
    empty = differ.isEmpty()
    release(found, hits)
    return None if empty else differ


def unique(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns unchanged."""
    found = deduplicate(docs)
    gone = cut(found.rows.where("not kept").select(*LOCATOR), "gone")
    return known_by(found.docs, gone, LOCATOR, "left_anti").select(*docs.columns)
