"""Draws from weighted, Zipf and banded distributions, and negative samples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions.rand import uniform


#: Items that share a block of the two-step prefix sum.
BLOCK = 65_536


def cumulative(weights: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(item, low, high)`` of integer weights ``(item, weight)`` over items
    0, 1, ...: a draw v in 1..total hits the item with ``low < v <= high``.

    Prefix sums run within blocks of items and over the blocks, so no window
    holds more than ``block`` items or more than ``items / block`` sums.
    """
    blocked = weights.withColumn("_block", F.floor(F.col("item") / block))
    sums = blocked.groupBy("_block").agg(F.sum("weight").alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    run = F.sum("weight").over(Window.partitionBy("_block").orderBy("item").rowsBetween(Window.unboundedPreceding, 0))
    high = F.col("_before") + F.col("_run")
    return blocked.withColumn("_run", run).join(offsets, "_block").select("item", (high - F.col("weight")).alias("low"), high.alias("high"))


def weighted_draws(draws: DataFrame, u: Column, weights: DataFrame, cells: int = 4096) -> DataFrame:
    """Add ``item``, drawn in proportion to integer weights by ``u`` in [0, 1).

    The range of all weights is cut into ``cells`` of equal width; an item is
    entered in each cell it reaches into, so the search is an equi-join on the
    cell with the bounds as a filter.  No weights, or a total of 0, is an
    error.
    """
    bounds = cumulative(weights).where(F.col("high") > F.col("low"))
    total = bounds.agg(F.max("high")).first()[0]
    if not total:
        raise ValueError("there is nothing to draw from")
    width = -(-total // cells)
    cell = lambda v: F.floor((v - 1) / F.lit(width)).cast("long")
    entered = bounds.withColumn("_cell", F.explode(F.sequence(cell(F.col("low") + 1), cell(F.col("high")))))
    drawn = draws.withColumn("_v", F.lit(1) + F.floor(u * F.lit(total))).withColumn("_cell", cell(F.col("_v")))
    hit = (F.col("_v") > F.col("low")) & (F.col("_v") <= F.col("high"))
    return drawn.join(entered, "_cell").where(hit).drop("_cell", "_v", "low", "high")


def _antiderivative(x: float, s: float) -> float:
    return math.log(x) if s == 1 else (x ** (1 - s) - 1) / (1 - s)


def zipf_draw(u: Column, n: int, exponent: float = 0.5) -> Column:
    """A rank in [0, n) by the inverse of the integrated power law, truncated.

    This closed form has the frequencies that are observed of the sampler it
    stands for; :func:`zipf_weights` has the textbook probabilities.
    """
    if n < 1:
        raise ValueError("there is nothing to draw from")
    low = _antiderivative(1.5, exponent) - 1
    y = u * F.lit(_antiderivative(n + 0.5, exponent) - low) + F.lit(low)
    if exponent == 0.5:
        x = (F.lit(1.0) + y / 2) * (F.lit(1.0) + y / 2)
    elif exponent == 1:
        x = F.exp(y)
    else:
        x = F.pow(y * F.lit(1 - exponent) + 1, F.lit(1 / (1 - exponent)))
    return (F.greatest(F.lit(1), F.least(F.lit(n), F.floor(x))) - 1).cast("long")


def zipf_weights(spark, n: int, exponent: float = 0.5, unit: int = 10**9) -> DataFrame:
    """Integer weights ``(item, weight)`` of the textbook law ``1 / k^exponent``."""
    k = (F.col("id") + 1).cast("double")
    power = F.sqrt(k) if exponent == 0.5 else F.pow(k, F.lit(exponent))
    return spark.range(n).select(F.col("id").alias("item"), F.floor(F.lit(float(unit)) / power).cast("long").alias("weight"))


def banded(rank: Column, u: Column, size: int) -> Column:
    """A row of the band of ``rank``, uniform within the band."""
    return rank * size + F.floor(u * F.lit(size)) if size > 1 else rank


def negative_sample(positive: Column, key: list[Column], n: int, exponent: float = 0.5, band: int = 1, attempts: int = 8) -> Column:
    """An output row other than ``positive``: the first of the hashed attempts
    that differs.  After ``attempts`` equal draws the row after the positive
    one is taken, so a result always exists; a single output row is an error.
    """
    if n * band < 2:
        raise ValueError("negative samples need at least two output rows")
    draw = lambda a: banded(zipf_draw(uniform("z", a, *key), n, exponent), uniform("b", a, *key), band)
    tried = F.array(*[draw(a) for a in range(attempts)])
    return F.coalesce(F.get(F.filter(tried, lambda x: x != positive), F.lit(0)), F.pmod(positive + 1, F.lit(n * band)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring keys become unrelated numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) by the key of all parts, vectorised."""
    h, golden = np.full(1, 0x9E3779B97F4A7C15, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for part in parts:
        h = _mix(np.atleast_1d(np.asarray(part, np.int64)).astype(np.uint64) + h + golden)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def negative_draws(positive: np.ndarray, key: list[np.ndarray | int], n: int, exponent: float, band: int, attempts: int = 16) -> np.ndarray:
    """As :func:`negative_sample` for arrays, by the hash of :func:`hashed_uniform`."""
    if n * band < 2:
        raise ValueError("negative samples need at least two output rows")
    low = _antiderivative(1.5, exponent) - 1
    span = _antiderivative(n + 0.5, exponent) - low
    out = (positive + 1) % (n * band)
    open_ = np.arange(len(positive))
    for attempt in range(attempts):
        part = [k[open_] if isinstance(k, np.ndarray) else k for k in key]
        y = hashed_uniform(0, attempt, *part) * span + low
        x = np.exp(y) if exponent == 1 else (y * (1 - exponent) + 1) ** (1 / (1 - exponent))
        drawn = np.clip(np.floor(x), 1, n).astype(np.int64) - 1
        if band > 1:
            drawn = drawn * band + np.floor(hashed_uniform(1, attempt, *part) * band).astype(np.int64)
        good = drawn != positive[open_]
        out[open_[good]] = drawn[good]
        open_ = open_[~good]
        if not len(open_):
            break
    return out


def initial_vectors(spark, matrix: str, rows: int, dims: int, seed: int = 0) -> DataFrame:
    """``(row_id, vec)`` with components uniform in [-1/dims, 1/dims]."""
    component = lambda d: ((2 * uniform("i", seed, matrix, F.col("id"), d) - 1) / F.lit(float(dims))).cast("float")
    return spark.range(rows).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), component).alias("vec"))
