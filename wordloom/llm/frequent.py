"""Most frequent values and their counts in bounded memory (problem 5).

Lossy counting per partition, merged across partitions with guaranteed count
intervals.  A partition's summary holds at most about ``1/eps`` entries (times
the logarithm of its weight over the bucket width), whatever the number of
distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.durable import written

#: Entries of a summary up to which the count is refined.
MOST_ENTRIES = 4_000_000
_SUMMARY = pa.schema([("item", pa.string()), ("counted", pa.int64()), ("delta", pa.int64()), ("bound", pa.int64())])


class LossyCounter:
    """Weighted lossy counting over aggregated batches.

    An entry is ``[counted, delta]``: its true weight lies between ``counted``
    and ``counted + delta``.  The weight seen so far is cut into buckets of
    ``1/eps``; whenever a bucket boundary is passed, entries whose upper bound
    does not exceed the number of buckets passed are pruned.
    """

    def __init__(self, eps: float):
        self.width = max(1, round(1 / eps))
        self.weight = 0
        self.bound = 0
        self.entries: dict[str, list[int]] = {}

    def add(self, items: list[str], weights: list[int]) -> None:
        """Add distinct items of one batch with their summed positive weights."""
        entries, before = self.entries, self.bound
        for item, w in zip(items, weights):
            entry = entries.get(item)
            if entry is None:
                entries[item] = [w, before]
            else:
                entry[0] += w
            self.weight += w
        self.bound = self.weight // self.width
        if self.bound > before:
            self.entries = {k: e for k, e in entries.items() if e[0] + e[1] > self.bound}


def _first_of_each(batch: pa.RecordBatch, last: int | None) -> tuple[pa.RecordBatch, int | None]:
    """Rows of a batch sorted by key without those that repeat the key before
    them (``last`` before the first); rows without key all stay."""
    key = batch.column(0)
    known = np.asarray(key.is_valid())
    values = key.fill_null(0).to_numpy(zero_copy_only=False)
    again = np.zeros(len(values), bool)
    again[1:] = known[1:] & known[:-1] & (values[1:] == values[:-1])
    if len(values) and known[0] and last is not None:
        again[0] = values[0] == last
    if len(values) and known[-1]:
        last = int(values[-1])
    return (batch.filter(pa.array(~again)) if again.any() else batch), last


def _summarise(eps: float, keyed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter, last = LossyCounter(eps), None
    for batch in batches:
        if keyed:
            batch, last = _first_of_each(batch, last)
        sums = pa.Table.from_batches([batch]).group_by("item").aggregate([("weight", "sum")])
        sums = sums.filter(pc.and_(pc.greater(sums["weight_sum"], 0), pc.is_valid(sums["item"])))
        counter.add(sums["item"].to_pylist(), sums["weight_sum"].to_pylist())
    items = list(counter.entries)
    bound = counter.bound
    rows = [*items, None]  # the last row carries the partition's own bound and weight
    counted = [*(counter.entries[i][0] for i in items), counter.weight]
    delta = [*(counter.entries[i][1] for i in items), 0]
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.string()), pa.array(counted, pa.int64()), pa.array(delta, pa.int64()), pa.array([bound] * len(rows), pa.int64())],
        schema=_SUMMARY,
    )


def _records(records: DataFrame, key: str | None) -> DataFrame:
    """The rows that count.  With ``key`` they lie sorted by it; rows of one
    key are equal, so the first stands for all, whatever its weight."""
    weight = F.coalesce(F.col("weight"), F.lit(0)).cast("long").alias("weight")
    if key is None:
        return records.where(F.col("item").isNotNull() & (F.col("weight") > 0)).select(F.lit(None).cast("long").alias("key"), "item", weight)
    rows = records.where(F.col("item").isNotNull()).select(F.col(key).cast("long").alias("key"), "item", weight)
    # rows without key are spread by their content instead of sharing one task
    at = F.when(F.col("key").isNull(), F.xxhash64("item", "weight")).otherwise(F.xxhash64("key"))
    return rows.repartition(at).sortWithinPartitions("key")


def _summed(records: DataFrame, key: str | None) -> DataFrame:
    """``(item, total)``, exactly."""
    rows = _records(records, None if key is None else key)
    if key is not None:
        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                batch, last = _first_of_each(batch, last)
                yield batch

        rows = rows.mapInArrow(once, "key long, item string, weight long").where(F.col("weight") > 0)
    return rows.groupBy("item").agg(F.sum("weight").alias("total"))


@dataclass(frozen=True)
class Intervals:
    """``items`` has ``(item, lower, upper)``; ``bound`` is the most that a
    missing item can weigh and ``weight`` the sum of all weights."""

    items: DataFrame
    bound: int
    weight: int


def count_intervals(records: DataFrame, eps: float = 1e-4, key: str | None = None) -> Intervals:
    """Lossy counting of ``(item, weight)`` in one pass.

    The summed weight of an item lies in ``[lower, upper]``; any item that is
    missing weighs at most ``eps`` of the total.  With ``key``, rows of one
    key are one record, and each row with a null key is one of its own.  Null
    items and weights that are null or not positive take no part; an empty
    table gives no rows.
    """
    keyed = key is not None
    summary = _records(records, key).mapInArrow(lambda it: _summarise(eps, keyed, it), "item string, counted long, delta long, bound long")
    summary = written(summary)
    bound, weight = summary.where(F.col("item").isNull()).agg(F.sum("bound"), F.sum("counted")).first()
    merged = summary.where(F.col("item").isNotNull()).groupBy("item")
    # a partition without the item may have pruned up to its own bound
    items = merged.agg(F.sum("counted").alias("lower"), F.sum(F.col("delta") - F.col("bound")).alias("_gap")).select(
        "item", "lower", (F.col("lower") + F.lit(bound or 0) + F.col("_gap")).alias("upper")
    )
    return Intervals(written(items), bound or 0, weight or 0)


def frequent_items(records: DataFrame, eps: float = 1e-4, key: str | None = None) -> DataFrame:
    """``(item, lower, upper)`` for every item some summary kept (see :func:`count_intervals`)."""
    return count_intervals(records, eps, key).items


def _decided(found: Intervals, k: int) -> tuple[int, bool, bool]:
    """``(floor, complete, decided)``: the ``k``-th lower bound, whether no
    missing item can be in the top ``k``, and whether the intervals alone tell
    which items these are."""
    best = found.items.orderBy(F.desc("lower"), F.desc("upper"), "item").limit(k)
    floor, kept = best.agg(F.min("lower"), F.count(F.lit(1))).first()
    if floor is None:
        return 0, not found.bound, not found.bound
    complete = floor > found.bound if kept == k else not found.bound
    reach = found.items.where(F.col("upper") >= F.lit(floor)).limit(k + 1).count()
    return floor, complete, complete and reach <= k


def top_set(records: DataFrame, k: int, eps: float = 1e-4, key: str | None = None) -> DataFrame:
    """``(item)`` of the ``k`` greatest summed weights, ties to the smaller item.

    The count intervals decide where they can: when exactly ``k`` of them
    reach the ``k``-th lower bound.  Otherwise :func:`top_items` does.
    """
    found = count_intervals(records, eps, key)
    floor, _, decided = _decided(found, k)
    if decided:
        return found.items.where(F.col("upper") >= F.lit(floor)).select("item")
    return _refined(records, k, eps, key, found).select("item")


def top_items(records: DataFrame, k: int, eps: float = 1e-4, key: str | None = None) -> DataFrame:
    """The ``k`` items of greatest summed weight, ``(item, lower, upper, total)``.

    Every item whose interval reaches the ``k``-th greatest lower bound is a
    candidate; a recount of the candidates alone gives ``total`` and the final
    order, ties by item.  Where a missing item might weigh as much as that
    bound, the count is repeated with finer buckets, and on data too flat for
    ``MOST_ENTRIES`` all items are summed exactly.
    """
    return _refined(records, k, eps, key, count_intervals(records, eps, key))


def _refined(records: DataFrame, k: int, eps: float, key: str | None, found: Intervals) -> DataFrame:
    floor, complete, _ = _decided(found, k)
    while not complete and 16 / eps <= MOST_ENTRIES:
        eps /= 16
        found = count_intervals(records, eps, key)
        floor, complete, _ = _decided(found, k)
    best = [F.desc("total"), "item"]
    if not complete:
        total = F.col("total")
        return _summed(records, key).select("item", total.alias("lower"), total.alias("upper"), "total").orderBy(*best).limit(k)
    candidates = found.items.where(F.col("upper") >= F.lit(floor))
    exact = _summed(records.join(candidates.select("item"), "item", "left_semi"), key)
    return candidates.join(exact, "item").orderBy(*best).limit(k)
