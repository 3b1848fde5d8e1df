import numpy as np
import pytest

from wordloom import cli
from wordloom.config import CommonConfig, Cutoff, NGramConfig, RunConfig, SimpleVocabConfig, SkipGramConfig, SubwordVocabConfig
from wordloom.operators import lockstep, train, trainers


@pytest.mark.parametrize("several", [False, True])
def test_lockstep_equals_each_part_alone(monkeypatch, several):
    """Parts of different lengths, focus tokens without outputs, outputs that repeat within a focus."""
    monkeypatch.setattr(lockstep, "CHUNK_TOKENS", 50)
    rng, rows, parts = np.random.default_rng(4), 9, []
    for p, n in enumerate((40, 71, 0, 3, 71)):
        sizes = rng.integers(0, 6, n)
        n_ids = rng.integers(1, 4, n) if several else np.ones(n, int)
        draw = lambda k: rng.integers(0, rows, k) + p * rows
        parts.append(lockstep.Part(draw(n_ids.sum()), n_ids, draw(3 * sizes.sum()).reshape(-1, 3), sizes, np.linspace(0.3, 0.1, n)))
    start = rng.normal(size=(2, 5 * rows, 8))
    start[1, :9] *= 20  # activations beyond 10
    alone, together = [(*start.copy(), *np.zeros((2, 5 * rows))) for _ in range(2)]
    want = sum(train.sequential_pass(p.examples(), *alone[:2], p.rates, *alone[2:]) for p in parts)
    assert lockstep.lockstep_pass(parts, *together) == pytest.approx(want, rel=1e-9)
    for a, b in zip(alone, together):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)


def corpus(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [f"a{w}", f"b{w}", f"c{n}"] * 3) for i, (w, n) in enumerate(rng.integers(12, size=(1500, 2)).tolist())]
    return spark.createDataFrame(rows, "sent_id long, tokens array<string>")


@pytest.mark.parametrize("vocab", [SimpleVocabConfig(Cutoff("MinCount", 1), 1e9), SubwordVocabConfig(Cutoff("MinCount", 1), 1e9, indexer=NGramConfig(Cutoff("MinCount", 1)))])
def test_held_parameters_train_as_joined_ones(spark, monkeypatch, vocab):
    config = RunConfig("x", "y", CommonConfig(dims=8, epochs=1, negative_samples=3, lr=0.2), vocab, SkipGramConfig(context_size=2))
    monkeypatch.setattr(train, "PART_TOKENS", 500)
    monkeypatch.setattr(train, "GROUP_PARTS", 3)
    got = {}
    for held in (train.HELD_BYTES, 0):
        monkeypatch.setattr(train, "HELD_BYTES", held)
        trained = cli.fit(spark, config, corpus(spark))[2]
        got[held] = {(r["matrix"], r["row_id"]): r["vec"] for r in trained.params.collect()}, trained
    (a, x), (b, y) = got.values()
    assert a.keys() == b.keys() and max(p for _, p in x.steps) >= 4
    assert (x.tokens, x.positives, x.steps) == (y.tokens, y.positives, y.steps) and x.losses == pytest.approx(y.losses, rel=1e-5)
    assert max(abs(p - q) for k in a for p, q in zip(a[k], b[k])) < 1e-4


def test_a_step_takes_few_jobs(spark):
    """The steps of a small model are mostly start-up: one query each, of at most three jobs."""
    config = RunConfig("x", "y", CommonConfig(dims=8, epochs=3, negative_samples=3), SimpleVocabConfig(Cutoff("MinCount", 1), 1e9), SkipGramConfig(context_size=2))
    trainer = trainers.trainer_for(corpus(spark), config)
    start = cli.initial_params(spark, trainer.vocab.table, trainer.n_output_types, 8)
    context = spark.sparkContext
    context.setJobGroup("steps", "")
    try:
        trained = train.train(trainer, start, trainer.vocab.n_tokens, config.common)
        jobs = len(context.statusTracker().getJobIdsForGroup("steps"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 3 * len(trained.steps) + 10 * 3, (jobs, len(trained.steps))


def test_training_totals_take_few_jobs(spark, monkeypatch):
    """The registered query at its own step sizes; what it counts is compared with SQL elsewhere."""
    from wordloom.plans import runs

    context, trained, run = spark.sparkContext, [], train.train
    monkeypatch.setattr(train, "train", lambda *a, **k: trained.append(run(*a, **k)) or trained[-1])
    monkeypatch.setattr(train, "PART_TOKENS", 500)
    monkeypatch.setattr(train, "LEFT_BYTES", 0)  # shuffle files of past steps are collected after every step
    context.setJobGroup("totals", "")
    try:
        row = runs.training_totals(spark, "/root/testdata/sf0.001").first()
        jobs = len(context.statusTracker().getJobIdsForGroup("totals"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert row["losses_sound"] and (row["tokens"], row["positives"]) == (trained[0].tokens, trained[0].positives)
    assert len(trained[0].steps) >= 8 and jobs <= 3 * len(trained[0].steps) + 15 * 3, (jobs, len(trained[0].steps))
