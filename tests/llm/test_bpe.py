import random

import pytest

from wordloom.llm import bpe


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks("byte_bpe_50k", bpe.TOKENIZER_DIR)
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(8)
    alphabet = "aabcdeinrst   \n\t.,'-019éßñ中文🙂‍ "
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    return [*made, "", None, "<|endoftext|> it's we'll", "   \n\n  x", "a" * 5000, "ab" * 3000 + "é" * 2000, " " * 3000, "\x00\r\n"]


def test_ids_equal_an_independent_encoder(spark, reference):
    rows = [(i, t, [9], "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, lang string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df, ["doc_id"]).collect()}
    assert got == {i: (reference.encode_ordinary(t) if t else []) for i, t, *_ in rows}
    lengths = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df, ["doc_id"]).collect()}
    assert lengths == {i: len(x) for i, x in got.items()}


def test_queue_pops_by_rank_then_position():
    rng = random.Random(1)
    queue, want = bpe.RankQueue(50_000), []
    for _ in range(2000):
        item = (rng.randrange(50_001), rng.randrange(100))
        want.append(item)
        queue.push(*item)
    assert [queue.pop() for _ in want] == sorted(want) and not queue.top


def test_no_rows(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
