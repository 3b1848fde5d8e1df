"""Counting, cutoffs, ranked vocabularies and keep probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.config import Cutoff, NGramConfig, SimpleVocabConfig, SubwordVocabConfig
from wordloom.durable import written
from wordloom.operators import subwords


def count_items(items: DataFrame, label: str = "token", weight: Column | None = None) -> DataFrame:
    """``(label, count)``; nulls take no part.  Partial counts are made before
    the shuffle, so a label that holds a third of all items costs one row a task."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return items.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(n.cast("long").alias("count"))


def apply_cutoff(counted: DataFrame, cutoff: Cutoff) -> DataFrame:
    """Items that survive the cutoff.

    For a target size the labels are first aggregated by count; the window
    runs over that small table (one row per distinct count).  When the items
    of one count do not all fit, none of them stays; a target of exactly the
    number of items keeps them all.
    """
    if cutoff.type == "MinCount":
        return counted.where(F.col("count") >= cutoff.value)
    sizes = counted.groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, 0))
    least = sizes.withColumn("running", running).where(F.col("running") <= cutoff.value).agg(F.min("count")).first()[0]
    return counted.where(F.col("count") >= F.lit(least)) if least is not None else counted.limit(0)


def dense_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Add the position 0, 1, ... in the total order ``order``.

    Rows are range-partitioned and sorted, so no task sees the whole table;
    positions are the row's place in its partition plus the sizes of the
    partitions before it (a table of one row per partition).
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(sorted_rows)
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))  # a row per partition
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("_part", part).join(offsets, "_part").withColumn(name, place.cast("long")).drop("_part", "_at", "_before")


def keep_probability(count: Column, total: int | Column, threshold: float) -> Column:
    """Probability of keeping an occurrence: ``min(1, t/p + sqrt(t/p))``."""
    p = count.cast("double") / (total if isinstance(total, Column) else F.lit(float(total)))
    ratio = F.lit(float(threshold)) / p
    return F.least(F.lit(1.0), ratio + F.sqrt(ratio))


@dataclass(frozen=True)
class Vocabulary:
    """A ranked vocabulary: ``table`` has ``idx, label, count, keep_prob`` and,
    with subwords, ``subwords`` (ids already offset by the number of words)."""

    table: DataFrame
    config: SimpleVocabConfig | SubwordVocabConfig
    n_tokens: int
    size: int
    n_subwords: int = 0
    ngrams: DataFrame | None = None

    @property
    def n_input_types(self) -> int:
        return self.size + self.n_subwords

    def lookup(self, labels: DataFrame, label: str = "label") -> DataFrame:
        """``labels`` with the entry of each that is in the vocabulary."""
        return labels.join(self.table.withColumnRenamed("label", label), label)


def ranked(counted: DataFrame, cutoff: Cutoff, threshold: float, total: int) -> DataFrame:
    """``(label, count, idx, keep_prob)``, by count and then label, both descending."""
    kept = apply_cutoff(counted, cutoff)
    indexed = dense_index(kept, [F.desc("count"), F.desc("label")])
    return indexed.withColumn("keep_prob", keep_probability(F.col("count"), total, threshold))


def build_vocabulary(items: DataFrame, config: SimpleVocabConfig | SubwordVocabConfig, label: str = "token") -> Vocabulary:
    """The vocabulary of counted items.  ``n_tokens`` counts every item before
    the cutoff; an empty corpus gives an empty vocabulary."""
    counted = written(count_items(items, label))
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    table = ranked(counted, config.cutoff, config.discard_threshold, total)
    if not isinstance(config, SubwordVocabConfig):
        table = written(table)
        return Vocabulary(table, config, total, table.count())
    table = written(table)
    size = table.count()
    if isinstance(config.indexer, NGramConfig):
        counts = subwords.ngram_counts(table, config.min_n, config.max_n)
        listed = written(dense_index(apply_cutoff(counts, config.indexer.cutoff), [F.desc("count"), F.desc("label")]))
        table = subwords.with_explicit_ids(table, listed, config.min_n, config.max_n, size)
        return Vocabulary(written(table), config, total, size, listed.count(), listed)
    table = subwords.with_bucket_ids(table, config.indexer, config.min_n, config.max_n, size)
    return Vocabulary(written(table), config, total, size, 1 << config.indexer.buckets_exp)


def context_vocabulary(contexts: DataFrame, cutoff: Cutoff, threshold: float) -> DataFrame:
    """Ranked dependency contexts ``(kind, direction, depth, dep_label, form,
    count, idx, keep_prob)``; every occurrence counts, without sampling."""
    from wordloom.operators.deps import CONTEXT

    counted = written(contexts.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("count")))
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    order = [F.desc("count"), *[F.desc(c) for c in CONTEXT]]
    kept = dense_index(apply_cutoff(counted, cutoff), order)
    return kept.withColumn("keep_prob", keep_probability(F.col("count"), total, threshold))
