import pytest
from pyspark.sql import functions as F

from wordloom.config import BucketConfig, BucketIndexerType, Cutoff, NGramConfig, SimpleVocabConfig, SubwordVocabConfig
from wordloom.functions.text import ngrams, utf8_bucket, whitespace_tokens
from wordloom.operators.subwords import input_ids
from wordloom.operators.vocab import apply_cutoff, build_vocabulary, dense_index


def items(spark, text):
    rows = [(x[0], int(x[1:]), 5) for x in text.split()]
    return spark.createDataFrame(rows, "label string, count long, idx long")


@pytest.mark.parametrize(
    "target, given, kept",
    [
        (3, "a10 b3 c12 d5", "c12 a10 d5"),
        (3, "a10 b3 c12 e12 d10", "e12 c12"),
        (0, "a10 b3 c12 e12 d10", ""),
        (10, "a10 b3 c12 e12 d10", "e12 c12 d10 a10 b3"),
        (3, "a10 b10 c10 e10 d10", ""),
        (4, "a10 b3 c12 d5", "c12 a10 d5 b3"),
        (0, "", ""),
    ],
)
def test_target_size(spark, target, given, kept):
    got = apply_cutoff(items(spark, given), Cutoff("TargetSize", target)).orderBy(F.desc("count"), F.desc("label")).collect()
    assert [f"{r['label']}{r['count']}" for r in got] == kept.split()


def test_simple_vocabulary(spark):
    df = spark.createDataFrame([(t, 0) for t in ["a"] * 5 + ["b"] * 2 + ["d"] * 10 + ["c", None]], "token string, count long")
    v = build_vocabulary(df, SimpleVocabConfig(Cutoff("MinCount", 2), 1e-4))
    rows = v.table.orderBy("idx").collect()
    assert [(r["label"], r["count"]) for r in rows] == [("d", 10), ("a", 5), ("b", 2)]
    assert v.n_tokens == 18 and v.size == v.n_input_types == 3
    assert rows[1]["keep_prob"] == pytest.approx(0.019334, abs=1e-5)


@pytest.fixture
def phrase(spark):
    return spark.createDataFrame([(w,) for w in "to be or not to be </s>".split()], "token string")


@pytest.mark.parametrize(
    "indexer, expected",
    [
        (BucketConfig(), [[1141946, 215571, 1324229, 0], [277350, 1105487, 1482881, 1]]),
        (NGramConfig(Cutoff("MinCount", 2)), [[4, 5, 2, 0], [6, 7, 3, 1]]),
    ],
)
def test_subword_vocabulary(spark, phrase, indexer, expected):
    v = build_vocabulary(phrase, SubwordVocabConfig(Cutoff("MinCount", 2), indexer=indexer))
    rows = v.table.withColumn("ids", input_ids(v.table)).orderBy("idx").collect()
    assert [r["label"] for r in rows] == ["to", "be"] and [r["ids"] for r in rows] == expected
    assert v.n_tokens == 7 and rows[0]["keep_prob"] == pytest.approx(0.019058, abs=1e-5)
    if v.ngrams is not None:
        assert [r["label"] for r in v.ngrams.orderBy("idx").collect()] == ["to>", "be>", "<to>", "<to", "<be>", "<be"]


def test_utf8_buckets_follow_the_plain_loop(spark):
    def plain(text):
        h = 2166136261
        for b in text.encode():
            h = ((h ^ (b if b < 128 else b | 0xFFFFFF00)) * 16777619) & 0xFFFFFFFF
        return h % (1 << 21)

    texts = ["<to", "é", "文字", "🙂a", "<straße>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(utf8_bucket(F.col("t"), 21)).collect()] == [plain(t) for t in texts]


def test_ngrams_count_code_points(spark):
    df = spark.createDataFrame([("🙂",), ("",)], "w string")
    assert [r[0] for r in df.select(ngrams(F.col("w"), 1, 3)).collect()] == [["<🙂>", "<🙂", "<", "🙂>", "🙂", ">"], ["<>", "<", ">"]]


def test_tokens_split_on_all_white_space(spark):
    df = spark.createDataFrame([(" a b　c\r",), (" \t",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(whitespace_tokens(F.col("t"))).collect()] == [["a", "b", "c"], [], [], None]


def test_dense_index_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = dense_index(df, [F.desc("x")]).collect()
    assert sorted((r["idx"], r["x"]) for r in got) == [(i, 999 - i) for i in range(1000)]
    assert dense_index(df.limit(0), [F.asc("x")]).count() == 0


def test_an_empty_corpus_gives_an_empty_vocabulary(spark):
    v = build_vocabulary(spark.createDataFrame([], "token string"), SubwordVocabConfig(indexer=BucketConfig(10, BucketIndexerType.FASTTEXT)))
    assert v.size == v.n_tokens == v.table.count() == 0
