"""Materialised intermediate tables that survive the loss of an executor.

Tables are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``.  Only a local master without that setting (tests)
gets a folder of its own; anywhere else a missing setting is an error, because
a machine-local folder cannot be read by the other executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; see the module docstring."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="wordloom-")
    return "file://" + _own_dir


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`written`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # the JVM may be gone by now
        pass


def written_at(df: DataFrame, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """:func:`written`, and the path for :func:`remove` once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wordloom-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    atexit.register(_remove_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Lineage ends at the written files, so neither a lost executor nor a
    repeated action recomputes what came before.  The files go when the
    driver ends.
    """
    return written_at(df, partition_by)[0]
