"""Subword n-grams of a vocabulary: counts, bucket ids and explicit ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.config import BucketConfig, BucketIndexerType
from wordloom.functions.text import code_point_bucket, ngrams, utf8_bucket


def ngram_counts(vocab: DataFrame, min_n: int, max_n: int) -> DataFrame:
    """``(label, count)`` of n-grams, weighted by the count of their words;
    an n-gram that occurs twice in a word counts twice."""
    grams = vocab.select("count", F.explode(ngrams(F.col("label"), min_n, max_n)).alias("ngram"))
    return grams.groupBy(F.col("ngram").alias("label")).agg(F.sum("count").alias("count"))


def bucket(ngram: Column, config: BucketConfig) -> Column:
    hashed = utf8_bucket if config.indexer_type == BucketIndexerType.FASTTEXT else code_point_bucket
    return hashed(ngram, config.buckets_exp)


def with_bucket_ids(vocab: DataFrame, config: BucketConfig, min_n: int, max_n: int, offset: int) -> DataFrame:
    """Add ``subwords``: bucket ids of the word's n-grams plus ``offset``."""
    ids = F.transform(ngrams(F.col("label"), min_n, max_n), lambda g: bucket(g, config) + F.lit(offset))
    return vocab.withColumn("subwords", ids)


def with_explicit_ids(vocab: DataFrame, listed: DataFrame, min_n: int, max_n: int, offset: int) -> DataFrame:
    """Add ``subwords``: positions of the word's n-grams in ``listed`` plus
    ``offset``, in n-gram order; n-grams that are not listed are left out.

    A word's ids are bounded by its length; the join is on the n-gram, and
    the engine broadcasts the list only if its size allows."""
    grams = vocab.select("idx", F.posexplode(ngrams(F.col("label"), min_n, max_n)).alias("at", "ngram"))
    found = grams.join(listed.select(F.col("label").alias("ngram"), (F.col("idx") + F.lit(offset)).alias("id")), "ngram")
    ids = found.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("found"))
    joined = vocab.join(ids, "idx", "left")
    return joined.withColumn("subwords", F.coalesce(F.col("found.id"), F.array().cast("array<long>"))).drop("found")


def input_ids(vocab: DataFrame) -> Column:
    """All input rows of a word: its subwords, then the word itself."""
    own = F.array("idx")
    return F.concat("subwords", own) if "subwords" in vocab.columns else own
