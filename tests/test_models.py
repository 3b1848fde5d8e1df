import json
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom import cli
from wordloom.config import BucketIndexerType, CommonConfig, Cutoff, EmbeddingFormat, ModelType, RunConfig, SimpleVocabConfig, SkipGramConfig
from wordloom.functions import vectors as vec
from wordloom.functions.rand import uniform
from wordloom.operators import sampling, train, trainers
from wordloom.sources import sinks
from wordloom.streaming.token_counts import streaming_token_counts


def frequencies(df, column):
    rows = Counter(r[0] for r in df.select(column).collect())
    total = sum(rows.values())
    return [rows[k] / total for k in sorted(rows)]


def test_weighted_draws(spark):
    weights = spark.createDataFrame([(0, 4), (1, 1), (2, 3), (3, 2)], "item long, weight long")
    draws = spark.range(10_000)
    got = frequencies(sampling.weighted_draws(draws, uniform("t", F.col("id")), weights, cells=7), "item")
    assert got == pytest.approx([0.4, 0.1, 0.3, 0.2], abs=1.5e-2)
    with pytest.raises(ValueError):
        sampling.weighted_draws(draws, uniform("t", F.col("id")), weights.limit(0))


def test_prefix_sums_over_blocks(spark):
    weights = spark.range(50).select(F.col("id").alias("item"), (F.col("id") % 4).alias("weight"))
    got = sampling.cumulative(weights, block=8).orderBy("item").collect()
    sums = np.cumsum([i % 4 for i in range(50)])
    assert [(r["low"], r["high"]) for r in got] == [(s - i % 4, s) for i, s in enumerate(sums)]


def test_zipf_and_banded_draws(spark):
    draws = spark.range(20_000)
    rank = sampling.zipf_draw(uniform("z", F.col("id")), 4)
    observed = [0.4958, 0.2302, 0.1912, 0.0828]
    assert frequencies(draws.select(rank.alias("r")), "r") == pytest.approx(observed, abs=1.2e-2)
    both = sampling.banded(rank, uniform("b", F.col("id")), 4)
    assert frequencies(draws.select(both.alias("r")), "r") == pytest.approx([p / 4 for p in observed for _ in range(4)], abs=1.2e-2)
    textbook = sampling.weighted_draws(draws, uniform("y", F.col("id")), sampling.zipf_weights(spark, 4))
    assert frequencies(textbook, "item") == pytest.approx([0.3591, 0.2539, 0.2073, 0.1796], abs=1.2e-2)


def test_negatives_differ_from_the_positive(spark):
    df = spark.range(2000).select((F.col("id") % 6).alias("p"), sampling.negative_sample(F.col("id") % 6, [F.col("id")], 3, 0.5, 2).alias("n"))
    rows = df.collect()
    assert all(r["n"] != r["p"] and 0 <= r["n"] < 6 for r in rows)
    drawn = sampling.negative_draws(np.arange(5000) % 6, [0, np.arange(5000)], 3, 0.5, 2)
    assert (drawn != np.arange(5000) % 6).all() and set(drawn) == set(range(6))
    with pytest.raises(ValueError):
        sampling.negative_sample(F.lit(0), [], 1)


def test_numpy_draws_follow_the_observed_law():
    drawn = sampling.negative_draws(np.full(20_000, -1), [3, np.arange(20_000)], 4, 0.5, 1)
    assert np.bincount(drawn) / 20_000 == pytest.approx([0.4958, 0.2302, 0.1912, 0.0828], abs=1.2e-2)


A = [1.0, 1.0, 1.0, 0.0, 0.0, 0.0]
ORTHOGONAL, OPPOSITE = A[::-1], [-x for x in A]


def test_logistic_and_loss(spark):
    points = {-11: 0, -5: 0.00669, -2: 0.1192, -1: 0.26894, 0: 0.5, 1: 0.73106, 4: 0.982014, 5: 0.99331, 11: 1}
    df = spark.createDataFrame([(float(a),) for a in points], "a double")
    assert [r[0] for r in df.select(vec.logistic(F.col("a"))).collect()] == pytest.approx(list(points.values()), abs=1e-5)
    cases = [(A, ORTHOGONAL, 1, 0.69312, 0.5), (A, ORTHOGONAL, 0, 0.69312, -0.5), (A, A, 1, 0.04858, 0.04742), (A, OPPOSITE, 0, 0.04858, -0.04743), (A, OPPOSITE, 1, 3.04838, 0.95257)]
    df = spark.createDataFrame([c[:3] for c in cases], "u array<double>, v array<double>, y int")
    got = df.select(vec.logistic_loss(vec.dot(F.col("u"), F.col("v")), F.col("y")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [pytest.approx(c[3:], abs=1e-5) for c in cases]


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, -2.0, -1.0, 3.0, -3.0, 1.0], [0.0] * 6, [1.0])], "u array<double>, z array<double>, s array<double>")
    r = df.select(
        vec.l2_norm(F.col("u")).alias("n"), vec.l2_normalize(F.col("u")).alias("x"), vec.l2_normalize(F.col("z")).alias("nan"),
        vec.scale(F.col("u"), 0.5).alias("h"), vec.scaled_add(F.col("u"), F.col("u"), 0.5).alias("a"),
    ).first()
    assert r["n"] == 5 and r["x"] == pytest.approx([0.2, -0.4, -0.2, 0.6, -0.6, 0.2]) and all(np.isnan(r["nan"]))
    assert r["h"] == [0.5, -1, -0.5, 1.5, -1.5, 0.5] and r["a"] == [1.5, -3, -1.5, 4.5, -4.5, 1.5]
    with pytest.raises(Exception, match="different length"):
        df.select(vec.dot(F.col("u"), F.col("s"))).collect()


def test_mean_of_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (0, [4.0, 5.0, 6.0]), (1, [7.0, 8.0, 9.0])], "k long, vec array<float>")
    got = {r["k"]: r["mean"] for r in train.mean_vectors(df, ["k"]).collect()}
    assert got == {0: [2.5, 3.5, 4.5], 1: [7, 8, 9]}


def plain_step(ids, outputs, rows_in, rows_out, lr):
    """The sequential order written out one output at a time."""
    u, total = rows_in[ids].mean(axis=0), 0.0
    for row in outputs:
        delta = np.zeros_like(u)
        for k, o in enumerate(row):
            y = 1 / (1 + np.exp(-(u @ rows_out[o])))
            g = lr * ((k == 0) - y)
            total -= np.log((y if k == 0 else 1 - y) + 1e-5)
            delta += g * rows_out[o]
            rows_out[o] = rows_out[o] + g * u
        for i in ids:
            rows_in[i] += delta
    return total


def test_sequential_pass_equals_the_plain_loop():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 12, 8))
    work = [(rng.integers(0, 12, size=rng.integers(1, 4)), rng.integers(0, 12, size=(rng.integers(0, 4), 3))) for _ in range(40)]
    c, d = a.copy(), b.copy()
    want = sum(plain_step(ids, outputs, c, d, 0.1) for ids, outputs in work)
    assert train.sequential_pass(work, a, b, 0.1) == pytest.approx(want)
    assert np.allclose(a, c) and np.allclose(b, d)


def test_relational_step_equals_one_sequential_focus(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 6, 4)).astype(np.float32)
    rows = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "row_id long, vec array<float>")
    outputs = [[0, 3, 5], [1, 2, 4]]
    flat = [(7, k, [0, 2, 5], o, int(k % 3 == 0)) for k, o in enumerate(outputs[0] + outputs[1])]
    ex = spark.createDataFrame(flat, "ex_id long, k int, ids array<long>, output long, label int")
    c, d = a.astype(float), b.astype(float)
    loss = plain_step([0, 2, 5], outputs, c, d, 0.05)
    got = {(r["kind"], r["id"], r["dim"]): r["value"] for r in train.relational_step(ex, rows(a), rows(b), 0.05).collect()}
    assert got["loss", 7, -1] == pytest.approx(loss, abs=1e-5)
    for i in (0, 2, 5):
        assert [got["in", i, k] for k in range(4)] == pytest.approx(list(c[i] - a[i]), abs=1e-5)
    for o in range(6):
        assert [got["out", o, k] for k in range(4)] == pytest.approx(list(d[o] - b[o]), abs=1e-5)


def test_rate_and_loss(spark):
    assert train.learning_rate(0, 2, 100, 0.05) == 0.05 and train.learning_rate(150, 2, 100, 0.05) == pytest.approx(0.0125)
    assert train.learning_rate(500, 2, 100, 0.05) == 0
    df = spark.createDataFrame([(1.0, 1), (0.5, 0), (0.5, 0), (2.0, 1)], "loss double, label int")
    assert train.train_loss(df).first()[0] == 2.0


def test_training_brings_planted_pairs_together(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [f"a{w}", f"b{w}"] * 3) for i, w in enumerate(rng.integers(4, size=500).tolist())]
    sentences = spark.createDataFrame(rows, "sent_id long, tokens array<string>")
    config = RunConfig("x", "y", CommonConfig(dims=8, epochs=8, negative_samples=3, lr=0.3), SimpleVocabConfig(Cutoff("MinCount", 1), 1e9), SkipGramConfig(context_size=2))
    vocab, final, trained = cli.fit(spark, config, sentences)
    assert trained.losses[-1] < trained.losses[0] * 0.8 and trained.tokens >= 8 * vocab.n_tokens
    v = {r["label"]: np.array(r["vec"]) for r in final.collect()}
    assert all(np.linalg.norm(x) == pytest.approx(1, abs=1e-5) for x in v.values())
    for w in range(4):
        near = max((x for x in v if x != f"a{w}"), key=lambda x: v[f"a{w}"] @ v[x])
        assert near == f"b{w}"


@pytest.mark.parametrize("model", ["skipgram", "deps"])
def test_command_line_run_writes_a_model(spark, tmp_path, model):
    corpus = tmp_path / "corpus"
    if model == "deps":
        corpus.write_text("\n\n".join(f"1\tthe\t_\t_\t_\t_\t2\tdet\n2\tw{i % 3}\t_\t_\t_\t_\t0\troot" for i in range(60)) + "\n")
    else:
        corpus.write_text("\n".join(f"the w{i % 3} runs" for i in range(60)))
    args = [model, str(corpus), str(tmp_path / "out"), "--dims", "4", "--epochs", "1", "--mincount", "1", "--discard", "1000000", "--buckets", "6", "--ns", "2"]
    args += ["--use-root", "--context-discard", "1000000"] if model == "deps" else ["--context", "2", "--model", "structgram"]
    cli.run(spark, cli.configure(cli.parser().parse_args(args)))
    words = spark.read.parquet(f"{tmp_path}/out/words").collect()
    assert {r["label"] for r in words} == {"the", "w0", "w1", "w2"} | ({"runs"} if model == "skipgram" else set())
    document = json.loads(spark.read.text(f"{tmp_path}/out/metadata").first()[0])
    assert document["common_config"]["dims"] == 4 and document["training_info"]["end_datetime"]


def test_text_and_word2vec_files(spark, tmp_path):
    final = spark.createDataFrame([(1, "b", [0.5, 1.0]), (0, "a", [2.0, -1.0])], "idx long, label string, mean array<double>")
    sinks.write_text(final, str(tmp_path / "t"), header=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["2 2", "a 2.0 -1.0", "b 0.5 1.0"]
    sinks.write_word2vec(final, str(tmp_path / "w"))
    assert (tmp_path / "w").read_bytes() == b"2 2\na " + struct.pack("<2f", 2, -1) + b"\nb " + struct.pack("<2f", 0.5, 1) + b"\n"


def test_configuration_rules():
    with pytest.raises(ValueError):
        Cutoff.of(5, 10)
    for kind in (ModelType, EmbeddingFormat, BucketIndexerType):
        with pytest.raises(ValueError):
            kind.parse("nonesuch")
    assert ModelType.parse(2) == ModelType.DIRGRAM and ModelType.DIRGRAM.band(5) == 2 and ModelType.parse("structgram").band(5) == 10
    with pytest.raises(ValueError):
        cli.configure(cli.parser().parse_args(["skipgram", "a", "b", "-f", "fasttext"]))
    fine = cli.configure(cli.parser().parse_args(["skipgram", "a", "b", "-f", "fasttext", "--hash-indexer", "fasttext"]))
    assert fine.common.dims == 300 and fine.model.context_size == 10 and fine.vocab.cutoff == Cutoff("MinCount", 5)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["skipgram", "a", "b", "--mincount", "1", "--target-size", "2"])


def test_streamed_counts(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "state"
    spark.createDataFrame([("a b a",), (None,), (" ",)], "text string").write.parquet(str(source))
    stream = streaming_token_counts(spark.readStream.schema("text string").parquet(str(source)))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(state)).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("counted").collect()} == {("a", 2), ("b", 1)}


def test_registered_training_reaches_its_epochs(spark, monkeypatch):
    from wordloom.plans import models

    seen, fit = [], models.fit
    monkeypatch.setattr(models, "fit", lambda *a, **k: seen.append(fit(*a, **k)) or seen[-1])
    models.trained_model(spark, "/root/testdata/sf0.001")
    vocab, _, trained = seen[0]
    assert trained.tokens >= vocab.n_tokens and len(trained.losses) > 1


def test_many_parts_train_like_one(spark, monkeypatch):
    """The loss over one and the same pass after training in 1, 16 and 64 parts an epoch."""
    rng = np.random.default_rng(3)
    rows = [(i, [f"a{w}", f"b{w}", f"c{n}"] * 3) for i, (w, n) in enumerate(rng.integers(12, size=(1500, 2)).tolist())]
    sentences = spark.createDataFrame(rows, "sent_id long, tokens array<string>")
    config = RunConfig("x", "y", CommonConfig(dims=16, epochs=2, negative_samples=3, lr=0.2), SimpleVocabConfig(Cutoff("MinCount", 1), 1e9), SkipGramConfig(context_size=2))
    judge = trainers.trainer_for(sentences, config)
    layout = train.plan_layout(9, 0, judge.kept, 13_500, 13_500)
    loss, most = {}, {}
    for parts in (1, 16, 64):
        monkeypatch.setattr(train, "PART_TOKENS", 13_500 // parts)
        trained = cli.fit(spark, config, sentences)[2]
        stats = train.super_step(judge.blocks(layout).drop("step"), trained.params, judge.words, judge.expand(9), (0.0, 0.0))[2]
        loss[parts], most[parts] = stats.loss / stats.positives, max(p for _, p in trained.steps)
        assert trained.tokens >= 27_000
    assert most[64] >= 16 and loss[1] < 0.75 * 4 * np.log(2)
    assert loss[16] == pytest.approx(loss[1], rel=0.05) and loss[64] == pytest.approx(loss[1], rel=0.05), loss


def test_changes_of_parts_never_overshoot(spark):
    params = spark.createDataFrame([(1, 5, [1.0, 0.0]), (0, 5, [0.5, 0.5]), (0, 6, [2.0, 2.0])], train.PARAMS)
    rare = [(0, 5, [0.25, 0.0], 1e-9, 0.0, 0, 0)] * 4
    settled = [(1, 5, [-1.0, 1.0], 50.0, 0.0, 0, 0)] * 40
    changes = spark.createDataFrame([*rare, *settled, (-1, -1, [], 0.0, 1.0, 1, 1)], train._CHANGES)
    got = {(r["matrix"], r["row_id"]): r["vec"] for r in train.merge_changes(params, changes).collect()}
    assert got[0, 6] == [2.0, 2.0] and got[0, 5] == pytest.approx([1.5, 0.5]) and got[1, 5] == pytest.approx([0.0, 1.0])
