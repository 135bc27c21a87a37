"""Bottom-k sketches kept over a stream of edges.

State is one row a node and layer: the k smallest distinct hashes seen so far.  A hash that
comes twice, in one batch or in two, counts once, so any split of the edges into batches and
any repeat after a restart gives the same sketches.  Before the shuffle each Arrow batch is cut
to the k smallest hashes of its nodes, so a hot node ships at most k values a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from metaweave.plans.scratch import scratch_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _smallest(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.dropna().drop_duplicates().sort_values("hash")
            yield rows.groupby(["node", "layer"]).head(k)

    return run


class _BottomK(StatefulProcessor):
    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "hashes array<bigint>, version bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old, version = self.held.get() if self.held.exists() else ([], 0)
        old = [int(h) for h in old]
        new = sorted({*old, *(int(h) for part in rows for h in part["hash"])})[: self.k]
        if new != old:
            self.held.update((new, int(version) + 1))
            yield pd.DataFrame({"node": [key[0]], "layer": [key[1]], "hashes": [new], "version": [int(version) + 1]})

    def close(self) -> None:
        pass


def keep_sketches(stream: DataFrame, k: int) -> DataFrame:
    """``node, layer, hashes, version`` for each sketch that changed in a batch, of a stream of
    ``node, layer, hash``; rows with a null are skipped.  Needs the RocksDB state store."""
    kind = dict(stream.dtypes)["node"]
    few = stream.select("node", F.col("layer").cast("int").alias("layer"), F.col("hash").cast("bigint").alias("hash"))
    few = few.mapInPandas(_smallest(k), f"node {kind}, layer int, hash bigint")
    return few.groupBy("node", "layer").transformWithStateInPandas(
        _BottomK(k), f"node {kind}, layer int, hashes array<bigint>, version bigint", "Append", "None"
    )


def latest(changes: DataFrame) -> DataFrame:
    """``node, layer, hashes``: of the changes of a stream the last of each sketch."""
    return changes.groupBy("node", "layer").agg(F.max_by("hashes", "version").alias("hashes"))


def follow_folder(spark: SparkSession, folder: str, schema, rows_of, k: int, out: str, checkpoint: str, files: int = 1) -> DataFrame:
    """Read what is new in a folder of Parquet files, ``files`` a batch, and return the sketches.

    ``rows_of(stream)`` makes ``node, layer, hash``.  ``out`` gathers the changes and ``checkpoint``
    the state: a later call with the same two goes on where this one ended.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    writer = keep_sketches(rows_of(stream), k).writeStream.format("parquet").outputMode("append")
    writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.parquet(out))


def streamed_sketches(spark: SparkSession, edges: DataFrame, k: int, batches: int = 4) -> DataFrame:
    """The sketches of ``node, layer, hash`` by way of a stream of about ``batches`` batches."""
    folder = scratch_path(spark, "stream")
    edges.repartition(batches).write.parquet(folder)
    return follow_folder(spark, folder, edges.schema, lambda s: s, k, scratch_path(spark, "changes"), scratch_path(spark, "state"))
