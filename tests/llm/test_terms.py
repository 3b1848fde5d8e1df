import random
from collections import defaultdict

import pytest

from wordloom.llm.frequent import LossyCounter, frequent_items, top_items, top_set
from wordloom.llm.terms import mark_terms, term_statistics

SCHEMA = "id long, term string, w long, shard long, total long, leaf int, h long"


def rows_for(seed, n, hot=0.3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        term = "hot" if rng.random() < hot else rng.choice([None, "", *(f"t{j}" for j in range(200))])
        out.append((i if rng.random() < 0.9 else None, term, rng.choice([None, 1, 2, 30]), rng.choice([None, *range(12)]), 9, 9, 9))
    return out + rng.sample([r for r in out if r[0] is not None], n // 10)


def brute(rows):
    seen, total, shards = set(), defaultdict(int), defaultdict(set)
    for key, term, w, shard, *_ in rows:
        if term is None or key in seen:
            continue
        if key is not None:
            seen.add(key)
        total[term] += w or 0
        shards[term] |= {shard} - {None}
    return {t: (total[t], len(shards[t])) for t in total}


@pytest.mark.parametrize("leaf_rows, max_leaves", [(100, 1000), (700, 1000), (100_000, 1000), (50, 3), (100, 1)])
def test_term_statistics_equal_brute_force_at_every_leaf_size(spark, leaf_rows, max_leaves):
    rows = rows_for(3, 3000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = term_statistics(df, "term", "w", "shard", "id", leaf_rows=leaf_rows, max_leaves=max_leaves).collect()
    assert {r["term"]: (r["total"], r["n_shards"]) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_marks_and_empty_tables(spark):
    empty = term_statistics(spark.createDataFrame([], SCHEMA), "term", "w", "shard", "id")
    assert empty.count() == 0
    stats = spark.createDataFrame([("a", 4, 6), ("b", 5, 5), ("c", 50, 1)], "term string, total long, n_shards long")
    marks = {r["term"]: (r["rare"], r["common"]) for r in mark_terms(stats, 11).collect()}
    assert marks == {"a": (True, True), "b": (False, False), "c": (False, False)}
    assert not any(r["common"] for r in mark_terms(stats, 0).collect())


def test_lossy_counter_keeps_its_guarantee():
    rng = random.Random(11)
    truth, counter = defaultdict(int), LossyCounter(0.01)
    for _ in range(300):
        batch = defaultdict(int)
        for _ in range(50):
            item = f"k{int(rng.paretovariate(0.8))}"
            batch[item] += rng.randrange(1, 4)
        for k, v in batch.items():
            truth[k] += v
        counter.add(list(batch), list(batch.values()))
    assert counter.weight == sum(truth.values())
    for k, v in truth.items():
        low, delta = counter.entries.get(k, (0, counter.bound))
        assert low <= v <= low + delta
    assert len(counter.entries) < len(truth)


def test_intervals_and_top_items(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abcdefg") if rng.random() < 0.5 else f"r{i}", rng.randrange(1, 5)) for i in range(6000)]
    rows += [(None, 5), ("a", None), ("b", 0), ("c", -1)]
    truth = defaultdict(int)
    for k, v in rows:
        if k is not None and v and v > 0:
            truth[k] += v
    df = spark.createDataFrame(rows, "item string, weight long").repartition(5)
    for r in frequent_items(df, eps=0.01).collect():
        assert r["lower"] <= truth[r["item"]] <= r["upper"]
    positive = df.where("weight > 0")
    top = top_items(positive, 5, eps=0.005).collect()
    want = sorted(truth.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r["item"], r["total"]) for r in top] == want


def test_records_count_once_and_rows_without_key_for_themselves(spark):
    rows = [(i, "abcdefgh"[i % 7 % 4], i % 5) for i in range(900)]
    rows += [rows[3]] * 40 + [(None, "h", 50)] * 20 + [(None, "h", None), (5000, None, 9)]
    truth, seen = defaultdict(int), set()
    for key, item, w in rows:
        if item is not None and (key is None or key not in seen):
            truth[item] += w or 0
            seen.add(key)
    df = spark.createDataFrame(rows, "id long, item string, weight long").repartition(3)
    top = top_items(df, 3, 0.01, "id").collect()
    want = sorted(truth.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert [(r["item"], r["total"]) for r in top] == want
    assert all(r["lower"] <= r["total"] <= r["upper"] for r in top)
    assert {r["item"] for r in top_set(df, 3, 0.01, "id").collect()} == {k for k, _ in want}


@pytest.mark.parametrize("heavy", [0, 1, 3, 20])
def test_top_of_flat_and_nearly_flat_columns_is_whole(spark, heavy):
    rows = [(f"i{i}", 2 + (i < heavy) * (i + 1)) for i in range(5000)]
    df = spark.createDataFrame(rows, "item string, weight long").repartition(4)
    want = sorted(rows, key=lambda x: (-x[1], x[0]))[:20]
    for eps in (0.1, 1e-4):
        assert [(r["item"], r["total"]) for r in top_items(df, 20, eps).collect()] == want
        assert sorted(r["item"] for r in top_set(df, 20, eps).collect()) == sorted(k for k, _ in want)


def test_no_items_at_all(spark):
    empty = spark.createDataFrame([], "item string, weight long")
    assert frequent_items(empty).count() == 0 and top_items(empty, 3).count() == 0


def test_top_items_of_a_flat_column(spark):
    # every item weighs less than the pruning bound, and the heaviest come first
    rows = spark.range(0, 6000, 1, 2).selectExpr("cast(id % 3000 as string) item", "if(id % 3000 < 5, 2L, 1L) weight")
    got = [(r["item"], r["total"]) for r in top_items(rows, 5, 0.05).collect()]
    assert got == [(str(i), 4) for i in range(5)]
