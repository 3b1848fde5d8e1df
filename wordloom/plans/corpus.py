"""Queries over tokens, vocabularies, subwords and window pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.config import BucketConfig, BucketIndexerType, Cutoff, ModelType, NGramConfig, SimpleVocabConfig, SubwordVocabConfig
from wordloom.durable import written
from wordloom.functions.text import FNV32_BASIS, FNV32_PRIME, FNV64_BASIS, FNV64_PRIME, WHITE, ngrams
from wordloom.operators import pairs, subwords, vocab
from wordloom.session import spread, table
from wordloom.operators.train import learning_rate
from wordloom.sources.corpus import document_sentences, document_trees, parse_trees, read_parts, tokenised
from wordloom.streaming.token_counts import streaming_token_counts

CONTEXT = 5
EPOCHS, LR = 15, 0.05
TARGET, TARGET_TIES = 1000, 1237


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.explode_tokens(sentences(spark, sf_dir))


def simple_vocab(spark: SparkSession, sf_dir: str, cutoff: Cutoff = Cutoff(), threshold: float = 1e-4) -> vocab.Vocabulary:
    return vocab.build_vocabulary(tokens(spark, sf_dir), SimpleVocabConfig(cutoff, threshold))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("idx", "label", "count", F.round("keep_prob", 6).alias("keep_prob"))


def _ids(df: DataFrame, column: str = "subwords") -> DataFrame:
    return df.select("idx", "label", F.array_join(F.col(column).cast("array<string>"), " ").alias("ids"))


def tokenize_lines(spark, d):
    return sentences(spark, d).select("sent_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def token_counts(spark, d):
    return vocab.count_items(tokens(spark, d))


def corpus_totals(spark, d):
    first = F.sum(F.when(F.col("pos") == 0, 1).otherwise(0))  # every sentence has one first token
    per_token = tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"), first.alias("s"))
    return per_token.agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_types"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_sentences"))


def vocab_mincount(spark, d):
    return _rounded(simple_vocab(spark, d).table)


def vocab_targetsize(spark, d):
    return _rounded(simple_vocab(spark, d, Cutoff("TargetSize", TARGET)).table)


def vocab_targetsize_ties(spark, d):
    return _rounded(simple_vocab(spark, d, Cutoff("TargetSize", TARGET_TIES)).table)


def vocab_discard(spark, d):
    return _rounded(simple_vocab(spark, d, Cutoff("MinCount", 2), 1e-3).table)


def ngrams_bracketed(spark, d):
    words = simple_vocab(spark, d).table
    return words.select("idx", F.posexplode(ngrams(F.col("label"), 3, 6)).alias("at", "ngram"))


def ngram_counts_weighted(spark, d):
    return subwords.ngram_counts(simple_vocab(spark, d).table, 3, 6).select(F.col("label").alias("ngram"), "count")


def _subword_vocab(spark, d, indexer):
    return vocab.build_vocabulary(tokens(spark, d), SubwordVocabConfig(indexer=indexer)).table


def ngram_vocab_explicit(spark, d):
    return _ids(_subword_vocab(spark, d, NGramConfig()))


def subword_buckets(spark, d):
    return _ids(_subword_vocab(spark, d, BucketConfig()))


def subword_buckets_fasttext(spark, d):
    return _ids(_subword_vocab(spark, d, BucketConfig(indexer_type=BucketIndexerType.FASTTEXT)))


def word_input_indices(spark, d):
    table_ = _subword_vocab(spark, d, BucketConfig())
    return _ids(table_.withColumn("all_ids", subwords.input_ids(table_)), "all_ids")


def input_lengths(spark, d):
    """The number of input rows of every word, and all rows of the input matrix."""
    built = vocab.build_vocabulary(tokens(spark, d), SubwordVocabConfig())
    return built.table.select("idx", F.size(subwords.input_ids(built.table)).alias("n_ids"), F.lit(built.n_input_types).alias("n_input_types"), F.lit(built.n_tokens).alias("n_tokens"))


def vocab_lookup(spark, d):
    """The entries of lexicon words in the vocabulary of documents."""
    words = table(spark, d, "lexicon").select("word_id", F.col("word").alias("label"))
    return simple_vocab(spark, d).lookup(words).select("word_id", "label", "idx", "count")


def subsample_tokens(spark, d):
    t = written(tokens(spark, d))
    return pairs.kept_tokens(t, vocab.build_vocabulary(t, SimpleVocabConfig()).table)


def context_window_sizes(spark, d):
    kept = subsample_tokens(spark, d)
    return kept.select("sent_id", "pos", pairs.window_size(F.col("sent_id"), F.col("pos"), CONTEXT).alias("width"))


def _pairs(model):
    def query(spark, d):
        source = sentences(spark, d)
        words = vocab.build_vocabulary(pairs.explode_tokens(source), SimpleVocabConfig()).table
        return pairs.window_pairs(pairs.kept_sentences(pairs.known_tokens(source, words)), model, CONTEXT)

    return query


def pair_counts_topk(spark, d):
    counted = _pairs(ModelType.SKIPGRAM)(spark, d).groupBy("focus_idx", "output_idx").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "focus_idx", "output_idx").limit(100)


def _text_files(spark, d) -> str:
    """The texts of documents as files of lines."""
    return sinks_path(spark, lambda path: table(spark, d, "documents").where(F.col("text").isNotNull()).select("text").write.text(path))


def sinks_path(spark, write) -> str:
    """A new path in the shared folder, after ``write`` was called with it."""
    import uuid

    from wordloom.durable import shared_dir

    path = f"{shared_dir(spark)}/wordloom-{uuid.uuid4().hex}"
    write(path)
    return path


def partitioned_token_counts(spark, d):
    """Token counts of files that are read in five byte ranges each."""
    lines = tokenised(read_parts(spark, _text_files(spark, d), 5))
    return vocab.count_items(lines.select(F.explode("tokens").alias("token")))


def partitioned_trees(spark, d):
    """Nodes of the tree blocks in files that are read in three byte ranges each, counted."""
    separated = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.concat("text", F.lit("\n")))
    path = sinks_path(spark, lambda p: separated.write.text(p))
    nodes = parse_trees(read_parts(spark, path, 3, "\n\n")).select(F.explode("nodes").alias("n"))
    return nodes.groupBy("n.id", "n.form", "n.head", "n.rel").agg(F.count(F.lit(1)).alias("n_nodes"))


def lr_schedule(spark, d):
    """The learning rate before each thousand of documents, by running token count."""
    from pyspark.sql.window import Window

    block = F.floor(F.col("sent_id") / F.lit(100_000 * 1000)).cast("long").alias("block")
    sums = written(tokens(spark, d).groupBy(block).agg(F.count(F.lit(1)).alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    done = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rate = learning_rate(done, EPOCHS, total, LR)
    return sums.select("block", done.alias("processed"), F.round(rate, 9).alias("lr"))


def conllu_trees(spark, d):
    node = F.explode("nodes").alias("node")
    return document_trees(spread(table(spark, d, "documents").select("doc_id", "text"))).select("sent_id", node).select("sent_id", "node.id", "node.form", "node.head", "node.rel")


def streamed_token_counts(spark, d):
    """The token counts of documents read as a stream, after all of it."""
    import uuid

    from wordloom.durable import shared_dir

    schema = table(spark, d, "documents").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    target = f"{shared_dir(spark)}/wordloom-stream-{uuid.uuid4().hex}"
    sink = lambda batch, _: batch.write.mode("overwrite").parquet(f"{target}/counts")
    query = streaming_token_counts(source).writeStream.outputMode("complete").trigger(availableNow=True)
    query = query.option("checkpointLocation", f"{target}/state").foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.parquet(f"{target}/counts")


QUERIES = {
    "tokenize_lines": tokenize_lines,
    "token_counts": token_counts,
    "corpus_totals": corpus_totals,
    "vocab_mincount": vocab_mincount,
    "vocab_targetsize": vocab_targetsize,
    "vocab_targetsize_ties": vocab_targetsize_ties,
    "vocab_discard": vocab_discard,
    "ngrams_bracketed": ngrams_bracketed,
    "ngram_counts_weighted": ngram_counts_weighted,
    "ngram_vocab_explicit": ngram_vocab_explicit,
    "subword_buckets": subword_buckets,
    "subword_buckets_fasttext": subword_buckets_fasttext,
    "word_input_indices": word_input_indices,
    "subsample_tokens": subsample_tokens,
    "context_window_sizes": context_window_sizes,
    "skipgram_pairs": _pairs(ModelType.SKIPGRAM),
    "structgram_pairs": _pairs(ModelType.STRUCTGRAM),
    "dirgram_pairs": _pairs(ModelType.DIRGRAM),
    "pair_counts_topk": pair_counts_topk,
    "partitioned_token_counts": partitioned_token_counts,
    "partitioned_trees": partitioned_trees,
    "vocab_lookup": vocab_lookup,
    "input_lengths": input_lengths,
    "lr_schedule": lr_schedule,
    "conllu_trees": conllu_trees,
    "streamed_token_counts": streamed_token_counts,
}

# ---------------------------------------------------------------- SQL

U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296::DOUBLE)"
SENTS = f"""
lines AS (SELECT doc_id * 100000 + i - 1 AS sent_id, regexp_replace(v, '\\A{WHITE}+|{WHITE}+\\z', '', 'g') AS line
    FROM (SELECT doc_id, unnest(s) AS v, generate_subscripts(s, 1) AS i
          FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
sents AS (SELECT sent_id, regexp_split_to_array(line, '{WHITE}+') AS tokens FROM lines WHERE line <> ''),
toks AS (SELECT sent_id, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS token FROM sents),
counts AS (SELECT token AS label, count(*) AS "count" FROM toks GROUP BY 1)
"""


def _vocab(cut: str = '"count" >= 5', t: str = "1e-4") -> str:
    return f"""{SENTS},
total AS (SELECT count(*)::DOUBLE AS t FROM toks),
ranks AS (SELECT *, count(*) OVER (ORDER BY "count" DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM counts),
vocab AS (SELECT row_number() OVER (ORDER BY "count" DESC, label DESC) - 1 AS idx, label, "count",
    least(1.0::DOUBLE, {t}::DOUBLE / ("count"::DOUBLE / t) + sqrt({t}::DOUBLE / ("count"::DOUBLE / t))) AS keep_prob
    FROM ranks, total WHERE {cut})"""


VOCAB = _vocab()
_RANKED = 'SELECT idx, label, "count", round(keep_prob, 6) AS keep_prob FROM vocab'
_GRAMS = f"""{VOCAB},
words AS (SELECT idx, label, "count", '<' || label || '>' AS w FROM vocab),
grams AS (SELECT idx, label, "count", row_number() OVER (PARTITION BY idx ORDER BY p, n DESC) - 1 AS "at", substr(w, p, n) AS ngram
    FROM (SELECT *, unnest(range(1, length(w) + 1)) AS p FROM words) a CROSS JOIN (SELECT unnest([3, 4, 5, 6]) AS n) b
    WHERE p + n - 1 <= length(w))"""
_M = (1 << 21) - 1
_P, _P8, _H = FNV64_PRIME & _M, pow(FNV64_PRIME, 8, 1 << 21), FNV64_BASIS & _M


def _fold(values: str, start: str, step: str) -> str:
    return f"list_reduce({values}, lambda a, x: {step}, {start})"


_BYTES = "flatten(list_transform(range(1, length(ngram) + 1), lambda i: [unicode(substr(ngram, i, 1)) & 255, (unicode(substr(ngram, i, 1)) >> 8) & 255, (unicode(substr(ngram, i, 1)) >> 16) & 255, 0]))"
_LENGTH = "[length(ngram), 0, 0, 0, 0, 0, 0, 0]"
_BUCKET = _fold(f"list_transform(list_concat({_LENGTH}, {_BYTES}), lambda y: y::BIGINT)", f"{_H}::BIGINT", f"(xor(a, x) * {_P}) & {_M}")
_HEX = "list_transform(range(1, length(hex(encode(ngram))), 2), lambda i: ('0x' || substr(hex(encode(ngram)), i, 2))::BIGINT)"


def bucket32(mask: int) -> str:
    """SQL of the 32-bit bucket of ``ngram``."""
    signed = f"list_transform({_HEX}, lambda b: (CASE WHEN b >= 128 THEN b + 4294967040 ELSE b END) & {mask})"
    return _fold(signed, f"{FNV32_BASIS & mask}::BIGINT", f"(xor(a, x) * {FNV32_PRIME & mask}) & {mask}")


def _bucket_ids(expr: str, tail: str = "") -> str:
    return f"""WITH {_GRAMS}, size AS (SELECT count(*) AS n FROM vocab),
hashed AS (SELECT ngram, {expr} AS b FROM (SELECT DISTINCT ngram FROM grams)),
ids AS (SELECT idx, string_agg((b + size.n)::VARCHAR, ' ' ORDER BY "at") AS ids FROM grams JOIN hashed USING (ngram), size GROUP BY idx)
SELECT idx, label, coalesce(ids, '') {tail} AS ids FROM vocab LEFT JOIN ids USING (idx)"""


_KEPT = f"""{VOCAB},
kept AS (SELECT sent_id, pos, idx FROM toks JOIN vocab ON token = label
    WHERE {U.format("'s|0|' || sent_id || '|' || pos")} < keep_prob)"""


def _pairs_sql(output: str) -> str:
    return f"""WITH {_KEPT},
seq AS (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY pos) - 1 AS f,
    1 + floor({U.format("'w|0|' || sent_id || '|' || pos")} * {CONTEXT})::INTEGER AS b FROM kept),
reach AS (SELECT *, f + o AS other FROM seq, (SELECT unnest(range(-{CONTEXT}, {CONTEXT} + 1)) AS o) WHERE o <> 0 AND abs(o) <= b),
pairs AS (SELECT x.sent_id, x.pos, x.idx AS focus_idx, ({output})::BIGINT AS output_idx
    FROM reach x JOIN seq y ON x.sent_id = y.sent_id AND y.f = x.other)
"""


TREES = """b AS (SELECT doc_id * 100000 + i - 1 AS sent_id, v FROM (SELECT doc_id, unnest(s) AS v, generate_subscripts(s, 1) AS i
            FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
        r AS (SELECT sent_id, i, string_split(CASE WHEN ends_with(v, chr(13)) THEN substr(v, 1, length(v) - 1) ELSE v END, chr(9)) AS f
            FROM (SELECT sent_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT sent_id, string_split(v, chr(10)) AS l FROM b))
            WHERE regexp_matches(v, '\\A[0-9]+\\t')),
        parsed AS (SELECT sent_id, i, TRY_CAST(f[1] AS INTEGER) AS id, f[2] AS form,
            CASE WHEN regexp_matches(coalesce(f[7], ''), '\\A[0-9]{1,9}\\z') THEN f[7]::INTEGER ELSE 0 END AS head, coalesce(f[8], '') AS rel FROM r)"""
_SLOT = f"CASE WHEN y.f < x.f THEN y.f - x.f + {CONTEXT} ELSE y.f - x.f - 1 + {CONTEXT} END"
SQL = {
    "tokenize_lines": f"WITH {SENTS} SELECT sent_id, len(tokens)::INTEGER AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM sents",
    "token_counts": f"WITH {SENTS} SELECT * FROM counts",
    "streamed_token_counts": f"WITH {SENTS} SELECT * FROM counts",
    "corpus_totals": f"""WITH {SENTS} SELECT (SELECT count(*) FROM sents) AS n_sentences,
        CAST(sum("count") AS BIGINT) AS n_tokens, count(*) AS n_types FROM counts""",
    "vocab_mincount": f"WITH {VOCAB} {_RANKED}",
    "vocab_targetsize": f"WITH {_vocab(f'last <= {TARGET}')} {_RANKED}",
    "vocab_targetsize_ties": f"WITH {_vocab(f'last <= {TARGET_TIES}')} {_RANKED}",
    "vocab_discard": f"""WITH {_vocab('"count" >= 2', "1e-3")} {_RANKED}""",
    "ngrams_bracketed": f'WITH {_GRAMS} SELECT idx, "at"::INTEGER AS "at", ngram FROM grams',
    "ngram_counts_weighted": f"""WITH {_GRAMS} SELECT ngram, CAST(sum("count") AS BIGINT) AS "count" FROM grams GROUP BY ngram""",
    "ngram_vocab_explicit": f"""WITH {_GRAMS}, size AS (SELECT count(*) AS n FROM vocab),
        listed AS (SELECT ngram, row_number() OVER (ORDER BY c DESC, ngram DESC) - 1 AS id
                   FROM (SELECT ngram, sum("count") AS c FROM grams GROUP BY ngram) WHERE c >= 5),
        ids AS (SELECT idx, string_agg((id + size.n)::VARCHAR, ' ' ORDER BY "at") AS ids FROM grams JOIN listed USING (ngram), size GROUP BY idx)
        SELECT idx, label, coalesce(ids, '') AS ids FROM vocab LEFT JOIN ids USING (idx)""",
    "subword_buckets": _bucket_ids(_BUCKET),
    "subword_buckets_fasttext": _bucket_ids(bucket32(_M)),
    "word_input_indices": _bucket_ids(_BUCKET, "|| CASE WHEN ids IS NULL THEN '' ELSE ' ' END || idx"),
    "subsample_tokens": f"WITH {_KEPT} SELECT sent_id, pos::INTEGER AS pos, idx FROM kept",
    "context_window_sizes": f"""WITH {_KEPT} SELECT sent_id, pos::INTEGER AS pos,
        1 + floor({U.format("'w|0|' || sent_id || '|' || pos")} * {CONTEXT})::INTEGER AS width FROM kept""",
    "skipgram_pairs": _pairs_sql("y.idx") + "SELECT * FROM pairs",
    "structgram_pairs": _pairs_sql(f"y.idx * {2 * CONTEXT} + {_SLOT}") + "SELECT * FROM pairs",
    "dirgram_pairs": _pairs_sql("y.idx * 2 + CASE WHEN y.f < x.f THEN 0 ELSE 1 END") + "SELECT * FROM pairs",
    "pair_counts_topk": _pairs_sql("y.idx")
    + "SELECT focus_idx, output_idx, count(*) AS n FROM pairs GROUP BY ALL ORDER BY n DESC, focus_idx, output_idx LIMIT 100",
    "partitioned_token_counts": f"WITH {SENTS} SELECT * FROM counts",
    "vocab_lookup": f'WITH {VOCAB} SELECT word_id, label, idx, "count" FROM lexicon JOIN vocab ON word = label',
    "input_lengths": f"""WITH {VOCAB}, g AS (SELECT idx, unnest([3, 4, 5, 6]) AS n, length(label) + 2 AS l FROM vocab)
        SELECT idx, (1 + sum(greatest(l - n + 1, 0)))::INTEGER AS n_ids, 2097152 + (SELECT count(*) FROM vocab) AS n_input_types,
            (SELECT t::BIGINT FROM total) AS n_tokens FROM g GROUP BY idx""",
    "lr_schedule": f"""WITH {SENTS}, b AS (SELECT sent_id // 100000000 AS block, count(*) AS n FROM toks GROUP BY 1),
        r AS (SELECT block, CAST(coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS processed,
              sum(n) OVER () AS total FROM b)
        SELECT block, processed, round(greatest(0, (1 - processed::DOUBLE / ({EPOCHS} * total)::DOUBLE) * {LR}::DOUBLE), 9) AS lr FROM r""",
    "conllu_trees": f"WITH {TREES} SELECT sent_id, id, form, head, rel FROM parsed",
    "partitioned_trees": f"WITH {TREES} SELECT id, form, head, rel, count(*) AS n_nodes FROM parsed GROUP BY ALL",
}
