"""Frequency of every distinct term and the number of shards it occurs in (problem 4).

Recursive radix spilling.  Terms are partitioned by bits of their hash into
shuffle files on disk.  A histogram over the bits finds partitions above the
size of a leaf; these are split by further hash bits, and what is still too
large (one hot term cannot be split by its own hash) by bits of the record
key.  The number of leaves is bounded; where a leaf then holds more rows than
fit, its task writes them to disk by further hash bits and goes on with each
part, until a part fits or holds a single term.  DuckDB aggregates each part
out of core under a fixed memory limit.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a part that is aggregated at once, and the most leaves of one run.
LEAF_ROWS, MAX_LEAVES = 400_000, 20_000
#: Hash bits of one round of spilling.
SPILL_BITS = 4
_LEAF_SCHEMA = "term string, shard long, total long, n_shards long"
_RESULT = pa.schema([("term", pa.string()), ("shard", pa.int64()), ("total", pa.int64()), ("n_shards", pa.int64())])


def _scratch() -> str:
    """Task-scoped scratch inside the folders Spark gave to this executor; the
    files are spill space only and go with the task, like Spark's own spills."""
    local = os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS")
    if not local:
        raise RuntimeError("the engine names no local folder for spills")
    return tempfile.mkdtemp(prefix="leaf-", dir=local.split(",")[0])


def _results(con, source: str, split: bool) -> Iterator[pa.RecordBatch]:
    """Aggregate the rows of ``source``, each key once, each row without key for itself.

    Rows of record-split leaves (``partial``) come out per term and shard, since
    the same shard may turn up in another leaf; others come out per term.
    """
    once = f"""SELECT any_value(term) AS term, coalesce(any_value(weight), 0) AS weight, any_value(shard) AS shard, any_value(partial) AS partial
        FROM {source} WHERE key IS NOT NULL GROUP BY key, term
        UNION ALL SELECT term, coalesce(weight, 0), shard, partial FROM {source} WHERE key IS NULL"""
    whole = f"SELECT term, NULL::BIGINT AS shard, sum(weight)::BIGINT AS total, count(DISTINCT shard) AS n_shards FROM ({once}) WHERE NOT partial GROUP BY term"
    parts = f"SELECT term, shard, sum(weight)::BIGINT AS total, NULL::BIGINT AS n_shards FROM ({once}) WHERE partial GROUP BY term, shard"
    result = con.sql(f"{whole} UNION ALL {parts}" if split else whole)
    reader = result.to_arrow_reader(20_000) if hasattr(result, "to_arrow_reader") else result.fetch_arrow_reader(20_000)
    for batch in reader:
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, _RESULT)], schema=_RESULT)


def _spilled(con, source: str, folder: str, shift: int, fit_rows: int, split: bool) -> Iterator[pa.RecordBatch]:
    """Partition ``source`` to disk by hash bits from ``shift`` on and go on with each part."""
    con.sql(f"""COPY (SELECT key, term, weight, shard, partial, (hash(term) >> {shift}) & {(1 << SPILL_BITS) - 1} AS radix FROM {source})
        TO '{folder}' (FORMAT parquet, PARTITION_BY (radix))""")
    for part in sorted(Path(folder).glob("radix=*")):
        rows = f"read_parquet('{part}/*.parquet', hive_partitioning=false)"
        n, least, most = con.sql(f"SELECT count(*), min(hash(term)), max(hash(term)) FROM {rows}").fetchall()[0]
        if n > fit_rows and least != most and shift + SPILL_BITS < 64:
            yield from _spilled(con, rows, f"{part}-parts", shift + SPILL_BITS, fit_rows, split)
        else:
            yield from _results(con, rows, split)
        shutil.rmtree(part)


def _aggregate_leaf(split: bool, memory: str, fit_rows: int, oversized: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aggregate the rows of one shuffle partition with DuckDB."""
    import duckdb

    scratch = _scratch()
    try:
        con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": scratch, "preserve_insertion_order": False})
        if oversized:
            first = next(batches, None)
            if first is None:
                return

            def chained() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            con.register("stream", pa.RecordBatchReader.from_batches(first.schema, chained()))
            yield from _spilled(con, "stream", f"{scratch}/parts", 0, fit_rows, split)
        else:
            con.sql("CREATE TABLE rows(key BIGINT, term VARCHAR, weight BIGINT, shard BIGINT, partial BOOLEAN)")
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                con.sql("INSERT INTO rows SELECT key, term, weight, shard, partial FROM batch")
                con.unregister("batch")
            yield from _results(con, "rows", split)
        con.close()
    finally:
        shutil.rmtree(scratch, ignore_errors=True)


def term_statistics(
    df: DataFrame,
    term: str,
    weight: str,
    shard: str,
    key: str,
    leaf_rows: int = LEAF_ROWS,
    max_leaves: int = MAX_LEAVES,
    memory: str = "256MB",
) -> DataFrame:
    """``(term, total, n_shards)`` of every distinct term.

    ``total`` is the summed weight and ``n_shards`` the number of distinct
    shards over records, each ``key`` of a term taken once.  A null weight is 0, a null
    term takes no part, a null shard is no shard, and each row with a null key
    is a record of its own.  Terms compare as exact strings, the empty string is a
    term.  An empty table gives no rows; other columns take no part.
    """
    spark = df.sparkSession
    rows = df.where(F.col(term).isNotNull()).select(
        F.col(key).cast("long").alias("key"),
        F.col(term).alias("term"),
        F.col(weight).cast("long").alias("weight"),
        F.col(shard).cast("long").alias("shard"),
        F.xxhash64(term).alias("h"),
    )
    bits = 12
    radix = F.col("h").bitwiseAND((1 << bits) - 1)
    further = F.shiftrightunsigned("h", bits)
    # at most 2^bits rows
    histogram = {r["b"]: r["n"] for r in rows.groupBy(radix.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}

    fit_rows, leaf_rows = leaf_rows, max(leaf_rows, -(-sum(histogram.values()) // max_leaves))

    # level 1: neighbouring small buckets share a leaf, an oversized one gets several
    first, leaves, filled = [], 0, 0
    for bucket, n in sorted(histogram.items()):
        if n > leaf_rows:
            ways = -(-2 * n // leaf_rows)
            first.append((bucket, leaves + bool(filled), ways))
            leaves, filled = leaves + bool(filled) + ways, 0
            continue
        if filled + n > leaf_rows:
            leaves, filled = leaves + 1, 0
        first.append((bucket, leaves, 1))
        filled += n
    leaves += bool(filled)
    if not leaves:
        return spark.createDataFrame([], "term string, total long, n_shards long")
    # 2^bits rows at most
    level1 = F.broadcast(spark.createDataFrame(first, "b long, base int, ways int"))
    placed = (
        rows.withColumn("b", radix)
        .join(level1, "b")
        .withColumn("leaf", (F.col("base") + F.pmod(further, F.col("ways"))).cast("int"))
    )

    # level 2: leaves that further hash bits could not bring down are split by record
    second = []
    if any(ways > 1 for _, _, ways in first):
        sizes = placed.where("ways > 1").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows)
        for r in sizes.collect():  # at most rows / leaf_rows entries, so at most max_leaves
            ways = -(-r["n"] // leaf_rows)
            second.append((r["leaf"], leaves, ways))
            leaves += ways
    if second:
        level2 = F.broadcast(spark.createDataFrame(second, "leaf int, base2 int, ways2 int"))
        record = F.when(F.col("key").isNull(), F.xxhash64("weight", "shard")).otherwise(F.xxhash64("key"))
        placed = placed.join(level2, "leaf", "left").withColumn("partial", F.col("ways2").isNotNull()).withColumn(
            "leaf",
            F.when(F.col("partial"), F.col("base2") + F.pmod(record, F.col("ways2"))).otherwise(F.col("leaf")).cast("int"),
        )
    else:
        placed = placed.withColumn("partial", F.lit(False))

    split, oversized = bool(second), leaf_rows > fit_rows
    out = (
        placed.select("key", "term", "weight", "shard", "partial", "leaf")
        .repartitionById(leaves, F.col("leaf"))
        .mapInArrow(lambda batches: _aggregate_leaf(split, memory, fit_rows, oversized, batches), _LEAF_SCHEMA)
    )
    if not split:
        return out.select("term", "total", "n_shards")
    merged = out.repartition("term").groupBy("term", "shard").agg(F.sum("total").alias("total"), F.max("n_shards").alias("n_shards"))
    counted = F.when(F.col("n_shards").isNotNull(), F.col("n_shards")).when(F.col("shard").isNotNull(), 1).otherwise(0)
    return merged.groupBy("term").agg(F.sum("total").alias("total"), F.sum(counted).cast("long").alias("n_shards"))


def mark_terms(stats: DataFrame, shards: int, rare_below: int = 5, common_share: float = 0.5) -> DataFrame:
    """Add ``rare`` (total below ``rare_below``) and ``common`` (in at least
    ``common_share`` of ``shards``).  With no shards at all nothing is common."""
    return stats.withColumns(
        {
            "rare": F.col("total") < rare_below,
            "common": F.lit(shards > 0) & (F.col("n_shards") >= F.lit(common_share * shards)),
        }
    )
