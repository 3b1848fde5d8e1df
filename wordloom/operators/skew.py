"""Per-key aggregation that a few dominant keys cannot hold up (problem 3).

Two stages: rows of heavy keys get a salt, partial results are computed per
(key, salt), then partials are merged by the original key.  Which keys are
heavy comes from a frequent-items sketch of fixed size, so neither detection
nor the salted shuffle depends on the number of distinct keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial expression and merging function of each supported aggregate.
_PARTIAL = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class HeavyKeys:
    """Keys with at least ``share`` of ``rows`` rows (as the sketch sees it)."""

    rows: int
    keys: tuple


def heavy_keys(df: DataFrame, key: str, share: float, tracked: int = 8192) -> HeavyKeys:
    """Keys that hold ``share`` or more of all rows, by one sketched pass.

    The sketch keeps at most ``tracked`` items and its counts are off by at
    most ``3.5 / tracked`` of all rows, so every key above
    ``share`` is found as long as ``share`` exceeds that bound; at most
    ``2 / share`` keys come to the driver.  Null keys are counted in ``rows``
    but are never heavy (a null group is salted by :func:`salted_aggregate`
    on its own account).  An empty table gives ``rows == 0`` and no keys.
    """
    if share <= 7.0 / tracked:
        raise ValueError("share is too small for the number of tracked items")
    k = int(2 / share) + 1
    got = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {k}, {tracked})").alias("top")).first()
    floor = (share - 3.5 / tracked) * got["n"]
    return HeavyKeys(got["n"], tuple(x["item"] for x in got["top"] or () if x["item"] is not None and x["count"] >= floor))


def salted_aggregate(
    df: DataFrame,
    key: str,
    aggs: dict[str, tuple[str, Column]],
    salts: int = 32,
    heavy_share: float = 0.005,
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """``GROUP BY key`` by two salted stages.

    ``aggs`` maps an output name to (``count|sum|min|max``, column).  Rows of
    heavy keys, and of the null key, are spread over ``salts`` sub-groups by a
    hash of all their columns, which is deterministic, so a re-run task makes
    the same salts again.

    Defined results: the null key forms one group; ``sum``, ``min`` and
    ``max`` over only nulls are null and ``count`` over them is 0; an empty
    table gives no rows; repeated rows count as often as they occur; other
    columns of ``df``, whatever their names, take no part.
    """
    heavy = heavy or heavy_keys(df, key, heavy_share)
    hot = F.col(key).isNull()
    if heavy.keys:
        hot = hot | F.col(key).isin(*heavy.keys)
    # map<> columns cannot be hashed; they take no part in the salt
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = F.when(hot, F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    parts = df.select(
        F.col(f"`{key}`").alias("_key"),
        spread.alias("_salt"),
        *[column.alias(f"_in_{i}") for i, (_, column) in enumerate(aggs.values())],
    )
    partial = parts.groupBy("_key", "_salt").agg(
        *[_PARTIAL[kind](f"_in_{i}").alias(f"_part_{i}") for i, (kind, _) in enumerate(aggs.values())]
    )
    merged = partial.groupBy("_key").agg(
        *[_MERGE[kind](f"_part_{i}").alias(name) for i, (name, (kind, _)) in enumerate(aggs.items())]
    )
    return merged.withColumnRenamed("_key", key)
