import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.operators.rejects import load_strict, rejected
from wordloom.operators.skew import heavy_keys, salted_aggregate

SCHEMA = "id long, key string, n long, _salt int, _key string"


def test_salted_aggregate_equals_plain_counts(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", rng.choice([None, 1, 2]), 7, "x") for i in range(5000)]
    rows += [(i, None, 3, 7, "x") for i in range(300)] + [rows[0]] * 20
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["key"]: (r["records"], r["total"]) for r in salted_aggregate(
        df, "key", {"records": ("count", F.lit(1)), "total": ("sum", F.col("n"))}, salts=8, heavy_share=0.05).collect()}
    records = Counter(r[1] for r in rows)
    assert {k: v[0] for k, v in got.items()} == records
    for k in records:
        values = [r[2] for r in rows if r[1] == k and r[2] is not None]
        assert got[k][1] == (sum(values) if values else None)


def test_heavy_keys_finds_the_hot_one_and_counts_all_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}", 1, 0, "") for i in range(3000)] + [(1, None, 1, 0, "")]
    found = heavy_keys(spark.createDataFrame(rows, SCHEMA), "key", 0.05)
    assert found.rows == 3001 and found.keys == ("hot",)


def test_salted_aggregate_of_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert heavy_keys(df, "key", 0.05).rows == 0
    assert salted_aggregate(df, "key", {"n": ("max", F.col("n"))}).count() == 0


def test_sketch_bound_is_checked(spark):
    with pytest.raises(ValueError):
        heavy_keys(spark.createDataFrame([], SCHEMA), "key", 1e-6)


GOOD = "12,3,regular,1,nsubj,word"
LINES = {
    GOOD: None,
    GOOD + "\r": None,
    GOOD + "\r\r": "value",
    '12,3,regular,1,acl:relcl,"a ""b"", c"': None,
    '12,3,regular,1,nsubj,"two\nlines"': None,
    '"12","3","inverse","9","x","y"': None,
    "": "columns",
    "12,3,regular,1,nsubj": "columns",
    GOOD + ",": "columns",
    '"12,3,regular,1,nsubj,word"': "columns",
    '12,3,regular,1,nsubj,wo"rd': "quoting",
    '12,3,regular,1,nsubj,"word': "quoting",
    '12,3,regular,1,nsubj,"word"x': "quoting",
    '12,3,wo"rd': "quoting",
    "12,3,regular,0,nsubj,word": "value",
    "12,3,Regular,1,nsubj,word": "value",
    "12, 3,regular,1,nsubj,word": "value",
    "١,3,regular,1,nsubj,word": "value",
    "12,3,regular,1,nsubj:,word": "value",
    "12,3,regular,1,nsubj,": "value",
    '12,3,regular,1,nsubj,""': "value",
    "12,3,regular,1,nsubj,a\x01b": "value",
    "12,3,regular,1,nsubj,a�b": "value",
    "12,3,regular,1,nsubj,a\x85b": "value",
    '12,3,regular,1,nsubj,"' + '""' * 50_000 + '"': None,
    "12,3,regular,1,nsubj," + "x" * 200_000: None,
    "99999999999999999999,3,regular,1,nsubj,word": None,
}


def test_every_line_is_loaded_or_has_its_reason(spark):
    rows = [(i, raw, "f", i) for i, raw in enumerate(LINES)] + [(900, None, "f", 0)]
    df = spark.createDataFrame(rows, "line_id long, raw string, form string, sent_id long")
    bad = {r["line_id"]: r["reason"] for r in rejected(df).collect()}
    good = {r["line_id"]: r for r in load_strict(df).collect()}
    assert bad == {900: "columns"} | {i: reason for i, reason in enumerate(LINES.values()) if reason}
    assert set(good) == {i for i, reason in enumerate(LINES.values()) if reason is None}
    quoted = good[list(LINES).index('12,3,regular,1,acl:relcl,"a ""b"", c"')]
    assert (quoted["form"], quoted["direction"], quoted["depth"], quoted["kind"]) == ('a "b", c', 1, 1, 0)
    assert good[list(LINES).index("99999999999999999999,3,regular,1,nsubj,word")]["sent_id"] is None


def test_empty_raw_table(spark):
    df = spark.createDataFrame([], "line_id long, raw string")
    assert rejected(df).count() == 0 and load_strict(df).count() == 0
