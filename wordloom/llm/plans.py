"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import bpe, forms, frequent, mix, pii, terms, vectors
from wordloom.session import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of params, one of which is among the other's 5 most similar."""
    return vectors.as_pairs(vectors.most_similar(spread(table(spark, sf_dir, "params").select("row_id", "vec")), "row_id", "vec"))


def _written_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = table(spark, sf_dir, "vocab").select(F.lit("vocab").alias("src"), F.col("idx").alias("row_id"), F.col("label").alias("text"))
    deps = table(spark, sf_dir, "dependencies").select(F.lit("dependencies").alias("src"), F.col("dep_id").alias("row_id"), F.col("form").alias("text"))
    return vocab.unionByName(deps)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and forms that look like a lexicon word but are other strings."""
    found = forms.match_words(_written_forms(spark, sf_dir), table(spark, sf_dir, "lexicon"), ["src", "row_id"], "text")
    return found.where(F.col("word_id").isNotNull() & (F.col("text") != F.col("word_"))).select("src", "row_id", "word_id").distinct()


def p2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label and form with its consistent form, a lexicon word in its own."""
    found = forms.match_words(_written_forms(spark, sf_dir), table(spark, sf_dir, "lexicon"), ["src", "row_id"], "text")
    return found.select("src", "row_id", "text", F.coalesce("word_", "form_").alias("normal")).distinct()


def _term_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = terms.term_statistics(table(spark, sf_dir, "type_counts"), "label", "count", "shard_id", "count_id")
    shards = table(spark, sf_dir, "simple_vocab").select("shard_id").distinct().count()
    return terms.mark_terms(stats.withColumnRenamed("term", "label"), shards)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are too rare or too common, one row per label and mark."""
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return _term_marks(spark, sf_dir).select("label", F.explode(marks).alias("mark"))


def p4_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label with its summed count, its number of shards and its marks,
    beside the tokens that simple_vocab reports for all shards (null as 0)."""
    tokens = table(spark, sf_dir, "simple_vocab").agg(F.coalesce(F.sum("n_types"), F.lit(0))).first()[0]
    return _term_marks(spark, sf_dir).withColumn("n_types", F.lit(tokens).cast("long"))


def _weighted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "type_counts").select("count_id", F.col("label").alias("item"), F.col("count").alias("weight"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 labels of greatest summed count."""
    return frequent.top_set(_weighted_labels(spark, sf_dir), 20, key="count_id").select(F.col("item").alias("label"))


def p5_top_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 labels of greatest summed count with their total, whether it lies in
    the guaranteed interval, and whether that is no wider than 1e-4 of all counts."""
    top = frequent.top_items(_weighted_labels(spark, sf_dir), 20, 1e-4, "count_id")
    once = table(spark, sf_dir, "type_counts").where(F.col("label").isNotNull() & F.col("count_id").isNotNull())
    whole = once.groupBy("count_id").agg(F.max("count").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    inside = (F.col("lower") <= F.col("total")) & (F.col("total") <= F.col("upper"))
    return top.select(F.col("item").alias("label"), "total", inside.alias("inside"), (F.col("upper") - F.col("lower") <= F.lit(1e-4 * whole)).alias("narrow"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])


def _mix(spark: SparkSession, sf_dir: str, total=None) -> mix.Mix:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).where(F.col("source").isNotNull() & F.col("text").isNotNull())
    docs = docs.select("doc_id", "source", F.md5("text").alias("key"), "text")
    return mix.mix_sources(bpe.count_tokens(docs, ["doc_id", "source", "key"]), table(spark, sf_dir, "mix_targets"), total=total)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, each with its source and number of copies."""
    return _mix(spark, sf_dir).chosen


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source of the mix."""
    return _mix(spark, sf_dir).shares


def p8_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source is within 2 in 100 of its quota, or nearer than its smallest text is long."""
    off, near = F.abs(F.col("tokens") - F.col("quota_tokens")), F.greatest(F.col("quota_tokens") * 0.02, F.col("least_text"))
    return _mix(spark, sf_dir).shares.select("source", "target_share", "max_repeats", ((F.col("n_texts") > 0) & (off <= near)).alias("met"))


def p8_shares_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p8_shares for a mix of the size of all texts, where some targets cannot be met."""
    return _mix(spark, sf_dir, "all").shares


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of personal data in documents."""
    return pii.find_personal_data(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "name_list"))


def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by placeholders."""
    return pii.mask_personal_data(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "name_list"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_normalised": p2_normalised,
    "p4_found": p4_found,
    "p4_term_stats": p4_term_stats,
    "p5_found": p5_found,
    "p5_top_intervals": p5_top_intervals,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_met": p8_met,
    "p8_shares_of_all": p8_shares_of_all,
    "p9_found": p9_found,
    "p9_masked": p9_masked,
}

_ONCE = """
WITH once AS (SELECT count_id, label, coalesce(any_value("count"), 0) AS c, any_value(shard_id) AS s
              FROM type_counts WHERE label IS NOT NULL AND count_id IS NOT NULL GROUP BY count_id, label
              UNION ALL SELECT NULL, label, coalesce("count", 0), shard_id FROM type_counts WHERE label IS NOT NULL AND count_id IS NULL),
stats AS (SELECT label, CAST(sum(c) AS BIGINT) AS total, count(DISTINCT s) AS n_shards FROM once GROUP BY label),
shards AS (SELECT count(DISTINCT shard_id) AS n, CAST(coalesce(sum(n_types), 0) AS BIGINT) AS t FROM simple_vocab),
marked AS (SELECT label, total, n_shards, total < 5 AS rare, n > 0 AND n_shards * 2 >= n AS common, t AS n_types FROM stats, shards)
"""
SQL = {
    "p4_found": _ONCE + "SELECT label, 'rare' AS mark FROM marked WHERE rare UNION ALL SELECT label, 'common' FROM marked WHERE common",
    "p4_term_stats": _ONCE + "SELECT * FROM marked",
    "p8_met": """SELECT source, target_share, max_repeats, coalesce(source IN (SELECT source FROM documents WHERE text <> '' AND source IS NOT NULL), FALSE) AS met FROM mix_targets""",
    "p5_found": _ONCE + "SELECT label FROM stats ORDER BY total DESC, label LIMIT 20",
    "p5_top_intervals": _ONCE + "SELECT label, total, TRUE AS inside, TRUE AS narrow FROM stats ORDER BY total DESC, label LIMIT 20",
}
