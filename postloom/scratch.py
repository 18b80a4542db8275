"""Intermediate tables in the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only where that is unset
(tests, a laptop) a folder below the warehouse is used instead.
"""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_OF_THREAD = threading.local()


def _written() -> list[str]:
    """What this thread of the driver has written; jobs of other threads release their own."""
    if not hasattr(_OF_THREAD, "paths"):
        _OF_THREAD.paths = []
    return _OF_THREAD.paths


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path, without a trailing slash.

    Where ``spark.checkpoint.dir`` is unset it is a folder below the warehouse, but only with a local master,
    which has one machine; on a cluster the folder must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/postloom-{label}-{uuid.uuid4().hex}"
    _written().append(path)
    return path


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in a folder for each value of ``by``, and return a reader of it.

    This cuts the lineage: losing executors later costs no recomputation of ``df``.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in what this thread has written, for ``release``."""
    return len(_written())


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete what this thread wrote between two marks; call it only when no live result needs it."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in _written()[since:until]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)
    del _written()[since:until]


def small_batches(spark: SparkSession, rows: int = 512, size: str = "32m") -> None:
    """Bound an Arrow batch's rows and bytes, so that a batch of very long texts fits a worker's memory.

    Spark reads these settings when a plan runs, so they stay set; smaller ones of the caller's stay too.
    """
    for name, least in (("maxRecordsPerBatch", str(rows)), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        told = spark.conf.get(name)
        if told.lstrip("-").isdigit() and 0 < int(told) <= (rows if least == str(rows) else 1 << 25):
            continue
        spark.conf.set(name, least)
