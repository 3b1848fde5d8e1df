"""Session and table helpers shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder (one Parquet file or folder each)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, over all of them.

    One small file is one split, and heavy work on its rows would run in one
    task.  A scan with enough splits stays as it is, so large tables are never
    shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
