"""Lineage cuts: intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder.  Iterative operators write a table there and
read it back instead of keeping blocks on executors, so a lost executor costs a re-read
and never a recomputation of the whole loop.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_LIVE: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; a private one is set only where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="metaweave-"))
        root = _OWN_DIR[0]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/metaweave/{uuid.uuid4().hex[:16]}-{tag}"
    _LIVE.append((spark, path))
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._metaweave_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_metaweave_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _LIVE[:] = [x for x in _LIVE if x[1] != path]


def _sweep() -> None:
    for spark, path in list(_LIVE):
        try:
            remove(spark, path)
        except Exception:  # the JVM may have gone already
            return


atexit.register(_sweep)
