import random
import unicodedata

import pyarrow as pa

from wordloom.llm import forms


def fold(texts):
    a, b = forms.fold(pa.array(texts, pa.string()))
    return a.to_pylist(), b.to_pylist()


def test_composition_equals_the_standard_on_random_marks():
    rng = random.Random(1)
    alphabet = "aeouAEsSzZ" + "".join(chr(c) for c in range(0x300, 0x330)) + "ệớặḉṩ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(9))) for _ in range(4000)]
    assert fold(texts)[0] == [unicodedata.normalize("NFC", t) for t in texts]


def test_what_is_and_is_not_seen():
    same = {"ｗｏrd": "word", "ﬁsh": "fish", "wo​rd": "word", " word﻿": "word", "é": "é",
            "peut‑être": "peut-être", "10 000": "10 000", "wоrd": "word", "ѕtафf": "stафf", "ꓪord": "Word"}
    assert fold(list(same))[1] == fold(list(same.values()))[1]
    different = [("m²", "m2"), ("x₃", "x3"), ("cafe", "café"), ("Word", "word"), ("o", "0"), ("l", "1"), ("ſ", "s"), ("ı", "i")]
    for a, b in different:
        x, y = fold([a, b])[1]
        assert x != y


def test_nulls_blanks_and_long_texts():
    long = "é" * 100_000 + "ｗ" * 100_000
    assert fold([None, "", " ​ ", long])[0] == [None, "", "", "é" * 100_000 + "w" * 100_000]
    sliced = pa.array(["x", None, "ｙ", "ﬁ"]).slice(1, 3)
    assert forms.fold(sliced)[0].to_pylist() == [None, "y", "fi"]
    assert forms.fold(pa.array([], pa.string()))[0].to_pylist() == []


def test_matching_keeps_rows_and_finds_words(spark):
    words = spark.createDataFrame([(1, "café"), (2, "окно"), (3, "New Harbour")], "word_id long, word string")
    rows = [(1, "café"), (2, "café"), (3, "oкнo"), (4, "New Harbour "), (5, "cafe"), (6, None), (7, ""), (1, "café")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "row_id long, label string, word_id long")
    got = [(r["row_id"], r["word_id"]) for r in forms.match_words(df, words, ["row_id"], "label").collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 2), (4, 3), (5, None), (6, None), (7, None), (1, 1)], key=str)
    assert forms.match_words(df.limit(0), words, ["row_id"], "label").count() == 0


def test_korean_letters_join_to_syllables():
    import unicodedata

    words = ["한국어", "가", "각", "값이 없다", "a각b"]
    nfd = [unicodedata.normalize("NFD", w) for w in words]
    assert forms.fold(pa.array(nfd))[0].to_pylist() == words == forms.fold(pa.array(words))[0].to_pylist()
    alone = forms.fold(pa.array(["ㄱㅏ", "ﾡﾢ", "ᄀ", "ᅡᆨ"]))[0].to_pylist()
    assert alone == ["ㄱㅏ", "ㄱㄲ", "ᄀ", "ᅡᆨ"]
