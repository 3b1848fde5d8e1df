import time

import numpy as np
import pytest

from wordloom.config import Cutoff, DepembedsConfig, SimpleVocabConfig
from wordloom.operators import deps
from wordloom.operators.vocab import build_vocabulary, context_vocabulary
from wordloom.sources import corpus
from pyspark.sql import functions as F

# A small parsed text with two roots; the last row is short.
BLOCK = "# comment\n" + "\n".join(
    "\t".join(r)
    for r in [
        ("1", "Er", "_", "_", "_", "_", "2", "SUBJ", "_", "_"),
        ("2", "geht", "_", "_", "_", "_", "0", "ROOT", "_", "_"),
        ("2-3", "x", "_", "_", "_", "_", "_", "_", "_", "_"),
        ("3", "ins", "_", "_", "_", "_", "2", "PP", "_", "_"),
        ("4", "Kino", "_", "_", "_", "_", "3", "PN", "_", "_"),
        ("5", "root2", "_", "_", "_", "_", "0", "ROOT", "_", "_"),
        ("6", "dep", "_", "_", "_", "_", "5", "DEP"),
    ]
)


@pytest.fixture
def tree(spark):
    return corpus.parse_trees(spark.createDataFrame([(1, BLOCK)], "sent_id long, value string"))


def shown(df):
    mark = {0: "i", 1: "r"}
    return [
        f"{r['focus']} {r['form']}" if r["kind"] else f"{r['focus']} {mark[r['direction']]}{r['depth']} {r['dep_label']} {r['form']}"
        for r in df.orderBy("seq").collect()
    ]


def test_paths(tree):
    got = {}
    for r in deps.root_paths(tree).orderBy("focus", "step").collect():
        got.setdefault(r["focus"], []).append(r["form"])
    root = "<root>"
    assert got == {0: ["geht", root], 1: [root], 2: ["geht", root], 3: ["ins", "geht", root], 4: [root], 5: ["root2", root]}


ROOTED = "0 i1 SUBJ geht; 1 r1 SUBJ Er; 1 i1 ROOT <root>; 2 i1 PP geht; 1 r1 PP ins; 3 i1 PN ins; 2 r1 PN Kino; 4 i1 ROOT <root>; 5 i1 DEP root2; 4 r1 DEP dep"
CASES = [
    (dict(depth=1, use_root=True), ROOTED),
    (dict(depth=1), "; ".join(x for x in ROOTED.split("; ") if "<root>" not in x)),
    (
        dict(depth=2, normalize=True),
        "0 i1 SUBJ geht; 1 r1 SUBJ er; 2 i1 PP geht; 1 r1 PP ins; 3 i1 PN ins; 2 r1 PN kino; 3 i2 PP geht; 1 r2 PN kino; 5 i1 DEP root2; 4 r1 DEP dep",
    ),
    (
        dict(depth=2, normalize=True, use_root=True, untyped=True),
        "0 geht; 1 er; 0 <root>; 1 <root>; 2 geht; 1 ins; 2 <root>; 3 ins; 2 kino; 3 geht; 1 kino; 4 <root>; 5 root2; 4 dep; 5 <root>",
    ),
    (
        dict(depth=2, normalize=True, use_root=True),
        "0 i1 SUBJ geht; 1 r1 SUBJ er; 0 i2 ROOT <root>; 1 i1 ROOT <root>; 2 i1 PP geht; 1 r1 PP ins; 2 i2 ROOT <root>; 3 i1 PN ins; 2 r1 PN kino; "
        "3 i2 PP geht; 1 r2 PN kino; 4 i1 ROOT <root>; 5 i1 DEP root2; 4 r1 DEP dep; 5 i2 ROOT <root>",
    ),
]


@pytest.mark.parametrize("options, expected", CASES)
def test_contexts(tree, options, expected):
    assert shown(deps.dependency_contexts(tree, DepembedsConfig(**options))) == expected.split("; ")


def test_cycles_missing_heads_and_empty_trees_end(spark):
    node = lambda i, h: (i, f"w{i}", h, None)
    df = spark.createDataFrame([(1, [node(1, 2), node(2, 1)]), (2, [node(1, 9)]), (3, []), (4, None)], "sent_id long, nodes array<struct<id:int,form:string,head:int,rel:string>>")
    got = deps.dependency_contexts(df, DepembedsConfig(depth=0, use_root=True)).collect()
    assert sum(r["sent_id"] == 1 for r in got) == 8
    assert [(r["form"], r["dep_label"]) for r in got if r["sent_id"] == 2] == [("<root>", "")]
    assert {r["sent_id"] for r in got} == {1, 2}


def test_projective_trees_and_lifting(spark, tree):
    before = tree.select("nodes").first()["nodes"]
    assert deps.projectivize(tree).first()["nodes"] == before
    crossing = [(1, "a", 3, "x"), (2, "b", 4, "y"), (3, "c", 0, "z"), (4, "d", 3, "u")]
    df = spark.createDataFrame([(1, crossing)], "sent_id long, nodes array<struct<id:int,form:string,head:int,rel:string>>")
    lifted = deps.projectivize(df).first()["nodes"]
    assert [n["head"] for n in lifted] == [3, 3, 0, 3] and [n["rel"] for n in lifted] == ["x", "y", "z", "u"]


def plain_lift(parent):
    """Lifting written out: every arc is looked at again after each lift."""
    parent = list(parent)

    def under(j, h):
        while j >= 0 and j != h:
            j = parent[j]
        return j == h

    while True:
        bad = [(abs(p - i), i) for i, p in enumerate(parent) if p >= 0 and any(not under(j, p) for j in range(min(i, p) + 1, max(i, p)))]
        if not bad:
            return parent
        i = min(bad)[1]
        parent[i] = parent[parent[i]]


def random_tree(rng, n):
    order = rng.permutation(n)
    parent = [-1] * n
    for k in range(1, n):
        parent[order[k]] = int(order[rng.integers(0, k)]) if rng.random() < 0.95 else -1
    return parent


def test_lifting_equals_the_plain_loop():
    rng = np.random.default_rng(12)
    for n in [1, 2, 3, *rng.integers(4, 40, size=150).tolist()]:
        parent = random_tree(rng, n)
        assert deps.lift(parent) == plain_lift(parent)
    assert deps.lift([1, 2, 0, -1]) == [1, 2, 0, -1]  # a cycle
    began = time.time()
    deps.lift(random_tree(rng, 2000))
    assert time.time() - began < 30


def test_cycles_end_after_their_own_size_whatever_else_is_in_the_batch(spark):
    node = lambda i, h: (i, f"w{i}", h, "r")
    rows = [(1, [node(1, 2), node(2, 1)]), (2, [node(i, i - 1) for i in range(1, 30)])]
    df = spark.createDataFrame(rows, "sent_id long, nodes array<struct<id:int,form:string,head:int,rel:string>>").coalesce(1)
    assert deps.dependency_contexts(df, DepembedsConfig(depth=0, use_root=True)).where("sent_id = 1").count() == 8


def test_training_pairs_keep_tokens_without_contexts(spark, tree):
    words = build_vocabulary(tree.select(F.explode("nodes.form").alias("token")), SimpleVocabConfig(Cutoff("MinCount", 1), 1e9)).table
    config = DepembedsConfig(depth=1)
    ranked = context_vocabulary(deps.dependency_contexts(tree, config), Cutoff("MinCount", 1), 1e9)
    got = deps.training_pairs(tree, config, words, ranked).orderBy("pos").collect()
    assert [len(r["contexts"]) for r in got] == [1, 2, 2, 1, 1, 1]
    none = deps.training_pairs(tree, config, words, ranked.limit(0)).collect()
    assert len(none) == 6 and all(r["contexts"] == [] for r in none)


@pytest.mark.parametrize("options", [dict(depth=1), dict(depth=2, use_root=True, normalize=True), dict(depth=0, untyped=True, normalize=True, use_root=True)])
def test_training_pairs_by_lookup_and_by_join_agree(spark, options):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(60):
        n = int(rng.integers(1, 30))
        rows.append((s, [(i + 1, f"W{rng.integers(9)}", int(rng.integers(0, n + 3)), [None, "", "a", "b"][rng.integers(4)]) for i in range(n)]))
    trees = spark.createDataFrame(rows, "sent_id long, nodes array<struct<id:int,form:string,head:int,rel:string>>")
    config = DepembedsConfig(**options)
    words = build_vocabulary(trees.select(F.explode("nodes.form").alias("token")), SimpleVocabConfig(Cutoff("MinCount", 40), 1e-1)).table
    ranked = context_vocabulary(deps.dependency_contexts(trees, config), Cutoff("MinCount", 3), 1e-1)
    a, b = (sorted(map(str, deps.training_pairs(trees, config, words, ranked, 1, lookup).collect())) for lookup in (10**6, 0))
    assert a == b and len(a) > 100


def test_chunks_of_files(tmp_path):
    text = tmp_path / "a.txt"
    text.write_text("aaa\nbbb\nccc\nddd\n")
    assert [corpus.chunk_start(str(text), i, 3) for i in range(3)] == [0, 8, 12]
    trees = tmp_path / "b.txt"
    trees.write_text("a\nb\n\nc\nd\n\ne\nf\n\n")
    assert [corpus.chunk_start(str(trees), i, 2, b"\n\n") for i in range(2)] == [0, 10]
    with pytest.raises(ValueError):
        corpus.chunk_start(str(text), 3, 3)


def test_scans_of_files(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("one two\rx\n \n\nthree\n".encode())
    got = corpus.tokenised(corpus.read_lines(spark, str(tmp_path / "t.txt"))).collect()
    assert [r["tokens"] for r in got] == [["one", "two", "x"], ["three"]]
    (tmp_path / "c.txt").write_text(f"{BLOCK}\n\n\n\n{BLOCK}\n")
    trees = corpus.parse_trees(corpus.read_blocks(spark, str(tmp_path / "c.txt"))).collect()
    assert [len(r["nodes"]) for r in trees] == [6, 6]


def test_byte_ranges_give_every_line_once(spark, tmp_path):
    rng = np.random.default_rng(2)
    for f in range(2):
        lines = ["é" * int(rng.integers(0, 30)) + str(i) for i in range(300)]
        (tmp_path / f"{f}.txt").write_text("\n".join(lines) + "\n" * f, encoding="utf-8")
    want = sorted(x for f in range(2) for x in (tmp_path / f"{f}.txt").read_text(encoding="utf-8").rstrip("\n").split("\n"))
    for parts in (1, 3, 40):
        got = corpus.read_parts(spark, str(tmp_path), parts).collect()
        assert sorted(r["value"] for r in got) == want and max(r["part"] for r in got) < parts
    (tmp_path / "0.txt").write_text("a\nb\n\nc\n\nd")
    (tmp_path / "1.txt").unlink()
    assert sorted(r["value"] for r in corpus.read_parts(spark, str(tmp_path), 3, "\n\n").collect()) == ["a\nb", "c", "d"]


def test_strict_trees_and_carriage_returns(spark, tmp_path):
    good = spark.createDataFrame([(1, BLOCK)], "sent_id long, value string")
    assert len(corpus.parse_trees(good, strict=True).first()["nodes"]) == 6
    for bad in ("1\tw\t_\t_\t_\t_\tx\tdep", "1\tw", "no row at all"):
        with pytest.raises(Exception, match="malformed tree"):
            corpus.parse_trees(spark.createDataFrame([(bad,)], "value string"), strict=True).collect()
    (tmp_path / "c.txt").write_bytes(f"{BLOCK}\n\n{BLOCK}\n".replace("\n", "\r\n").encode())
    trees = corpus.parse_trees(corpus.read_blocks(spark, str(tmp_path / "c.txt")), strict=True).collect()
    assert [len(r["nodes"]) for r in trees] == [6, 6] and trees[0]["nodes"][-1]["rel"] == "DEP"


def test_too_many_lines_in_a_document(spark):
    docs = spark.createDataFrame([(1, "a\n" * 100_001)], "doc_id long, text string")
    with pytest.raises(Exception, match="too many lines"):
        corpus.document_sentences(docs).agg(F.max("sent_id")).collect()
