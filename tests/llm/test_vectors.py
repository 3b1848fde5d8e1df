from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wordloom.llm import vectors

SCHEMA = "row_id long, vec array<float>, other long, cosine double"


def frame(spark, ids, x):
    rows = [(int(i), [float(a) for a in v], 0, 0.0) for i, v in zip(ids, x)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(ids, x, k=5, least=0.8):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        order = np.lexsort((ids, -np.round(s[i], 9)))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if s[i, j] >= least}
    return out


def clusters(rng, n, dims=64, spread=0.5):
    centres = rng.normal(size=(n // 8, dims))
    x = np.concatenate([centres[rng.integers(0, len(centres), n // 2)] + spread * rng.normal(size=(n // 2, dims)), rng.normal(size=(n - n // 2, dims))])
    return x * rng.uniform(0.1, 9, size=(n, 1))


@pytest.mark.parametrize("cell_rows", [vectors.CELL_ROWS, 60])
def test_recall_against_brute_force(spark, cell_rows):
    rng = np.random.default_rng(4)
    x = clusters(rng, 1200)
    ids = rng.permutation(1200) * 3
    got = vectors.as_pairs(vectors.most_similar(frame(spark, ids, x), "row_id", "vec", cell_rows=cell_rows)).collect()
    got, want = {tuple(r) for r in got}, brute(ids, x)
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.06 * len(got)


def test_near_copies_of_one_vector_are_divided(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=64) + 0.02 * rng.normal(size=(900, 64))
    ids = np.arange(900)
    df = frame(spark, ids, x)
    v = vectors.packed(vectors.stepped(x))
    codes = spark.createDataFrame([(int(i), b) for i, b in zip(ids, v.to_pylist())], "id long, v binary")
    plan = vectors.plan_cells(codes, 64, 200)
    assert plan.divided and plan.divided[0]
    # no task holds more than two groups of a cell, and cells at the limit stay whole
    batch = pa.RecordBatch.from_arrays([pa.array(ids), v], names=["id", "v"])
    tiles = Counter()
    for b in vectors._place_batches(plan, 64, iter([batch])):
        tiles.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    assert max(tiles.values()) <= 2 * 200 * 1.2
    # all rows are about equally near, so what counts is how near the ones found are
    got = vectors.most_similar(df, "row_id", "vec", cell_rows=200).toPandas()
    assert (got.groupby("id").size() == 5).all() and got["id"].nunique() == 900
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = np.sort(s, axis=1)[:, -5:].mean()
    assert abs(got["cosine"] - s[got["id"], got["other"]]).max() < 2e-4
    assert best - got["cosine"].mean() < 0.002


def test_blocks_are_exact_where_nothing_divides(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 64)), 60, 0), np.repeat(rng.normal(size=(1, 64)), 50, 0)])
    ids = np.arange(len(x))
    got = {tuple(r) for r in vectors.as_pairs(vectors.most_similar(frame(spark, ids, x), "row_id", "vec", cell_rows=20)).collect()}
    assert got == brute(ids, x)


def test_many_exact_copies(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 64)), 300, 0), rng.normal(size=(20, 64))])
    ids = rng.permutation(len(x))
    got = {tuple(r) for r in vectors.as_pairs(vectors.most_similar(frame(spark, ids, x), "row_id", "vec")).collect()}
    assert got == brute(ids, x)


def test_steps_keep_a_cosine():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64)) * rng.uniform(0.01, 50, size=(500, 1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = vectors.unpacked(vectors.packed(vectors.stepped(u.astype(np.float32))), 64)
    assert abs((got.astype(float) @ got.T.astype(float)) - u @ u.T).max() < 3e-5


def test_invalid_rows_repeats_and_empty_tables(spark):
    a, nan, inf = [1.0] * 64, float("nan"), float("inf")
    rows = [(1, a), (2, [2.0] * 64), (2, [2.0] * 64), (3, None), (4, a[:63]), (5, [0.0] * 64), (6, [nan, *a[1:]]), (7, [inf, *a[1:]]), (8, [None, *a[1:]]), (None, a), (9, [-1.0] * 64)]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], SCHEMA)
    assert [tuple(r) for r in vectors.as_pairs(vectors.most_similar(df, "row_id", "vec")).collect()] == [(1, 2)]
    assert vectors.most_similar(df.limit(0), "row_id", "vec").count() == 0
    assert vectors.most_similar(df.where("row_id in (3, 4, 5)"), "row_id", "vec").count() == 0


def test_estimates_stay_within_their_bound():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    codes = vectors.BitCodes(x)
    off = np.abs(codes.estimate(slice(0, 400)) - x @ x.T)
    off[np.arange(400), np.arange(400)] = 0
    assert (off <= codes.error).mean() > 0.97


@pytest.mark.parametrize("s", [0.05, 0.01])
def test_near_copies_that_fill_cells_are_found(spark, s):
    # a third of the rows are near-copies; all their cells are over-full
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64))
    x[::3] = x[0] + s * rng.normal(size=(1000, 64))
    x = x.astype(np.float32).astype(np.float64)
    ids = np.arange(3000) * 4
    got = {tuple(r) for r in vectors.as_pairs(vectors.most_similar(frame(spark, ids, x), "row_id", "vec", cell_rows=300)).collect()}
    want = brute(ids, x)
    assert len(want) > 2500 and len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(got)
