"""Shared helpers: tables, the shared scratch folder, and words."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset, a temporary folder of this machine
    becomes the checkpoint folder, but only in local mode: on a cluster it is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="mrloom-"))
            held = context._jsc.sc().getCheckpointDir()
        root = held.get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: When on, Spark drops the shuffle files of an execution as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _WRITES = threading.Lock(), {}


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on while any thread writes in this session, and as before when the last one is done."""
    key = id(spark._jsparkSession)
    with _LOCK:
        n, before = _WRITES.get(key) or (0, spark.conf.get(CLEANUP))
        _WRITES[key] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITES.pop(key)
            if n > 1:
                _WRITES[key] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written once to the shared folder and read again: its lineage ends there.

    Nothing reads the shuffles behind it again, so their files go when the table is written.
    """
    spark = frame.sparkSession
    path = scratch(spark, name)
    with _cleanup(spark):
        frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes | None]:
    """The texts of a batch as UTF-8, one at a time, so that a worker never holds a batch twice."""
    return (x.as_py() for x in batch.column(column).cast(pa.binary()))


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text. bytes.split() parts at exactly the six characters of WORD."""
    return text.split() if text else []
