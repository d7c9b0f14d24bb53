"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``. Where that is unset a local master, as in tests, gets one below the
    warehouse; a cluster, whose machines may not share that, gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidelog_shared"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: While a table is written: shuffle files of the finished write are deleted at once, and batches
#: of texts given to Python are small enough for executors of a few gigabytes.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


_lock, _writers, _before = threading.Lock(), 0, {}


@contextlib.contextmanager
def _writing(spark: SparkSession):
    """The settings of _WRITING until the last of the threads that write is done."""
    global _writers
    with _lock:
        _writers += 1
        if _writers == 1:
            _before.update({k: spark.conf.get(k, None) for k in _WRITING})
            for k, v in _WRITING.items():
                spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                for k, v in _before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settle(df: DataFrame, tag: str = "t") -> DataFrame:
    """The rows of df, written to the shared folder and read again: a lost executor
    then costs the tasks it ran, never the work before the table."""
    spark = df.sparkSession
    path = f"{folder(spark)}-{tag}"
    with _writing(spark):
        df.write.option("compression", "zstd").parquet(path)  # a third less disk than the default for texts
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    made = _scratch.get()
    if made is not None:
        made.append(out)
    return out


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes settled tables that no later plan reads."""
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The tables settled in the innermost ``scratch`` of this thread.
_scratch: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables settled inside it at its end, but for those given to the function it yields."""
    made, kept = [], []
    token = _scratch.set(made)
    try:
        yield kept.append
    finally:
        _scratch.reset(token)
        drop(spark, *(t for t in made if not any(t is k for k in kept)))
        if (outer := _scratch.get()) is not None:
            outer += kept
