"""Queries that run whole operators end to end - training steps, sinks, options,
checks - and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom import cli
from wordloom.config import BucketConfig, BucketIndexerType, CommonConfig, Cutoff, DepembedsConfig, EmbeddingFormat, LossType, ModelType, RunConfig, SimpleVocabConfig, SkipGramConfig, SubwordVocabConfig
from wordloom.durable import written
from wordloom.functions import vectors as vec
from wordloom.operators import deps, sampling, train
from wordloom.operators.examples import Work
from wordloom.operators.trainers import trainer_for
from wordloom.operators.vocab import build_vocabulary
from wordloom.plans.corpus import SENTS, TREES, U, VOCAB, _vocab, bucket32, sentences, sinks_path, tokens
from wordloom.plans.models import _LOGISTIC, BAND, N, _hashed
from wordloom.session import spread, table
from wordloom.sources import corpus, sinks

DIMS, RATE = 16, 0.05


# ---------------------------------------------------------------- training


def _explicit(batch: pa.RecordBatch) -> Work:
    """Work of rows ``part, sent_id, block, outputs``: one focus with one context and its negatives."""
    outputs = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return Work(batch.column(2).to_numpy(zero_copy_only=False), np.ones(batch.num_rows, np.int64), outputs)


def train_super_step(spark, d) -> DataFrame:
    """The parameters after one super-step of two parts over all embeddings.

    Word e has the input rows 2e and 2e + 1.  In part 0 its outputs are 4e
    (positive) to 4e + 3, in part 1 those of the word seven further on, so that
    both parts change every row and examples of one part share none.
    """
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    m = e.count() // 4
    params = written(e.select(F.lit(train.INPUT).alias("matrix"), "row_id", "vec").unionByName(e.select(F.lit(train.OUTPUT).alias("matrix"), "row_id", "vec")))
    i = F.col("id")
    words = spark.range(m).select(i.alias("idx"), F.array(2 * i, 2 * i + 1).alias("ids"))
    parts = [spark.range(m).select(F.lit(p).cast("long").alias("part"), F.lit(0).cast("long").alias("sent_id"), i.alias("block"), F.sequence(4 * ((i + s) % m), 4 * ((i + s) % m) + 3).alias("outputs")) for p, s in ((0, 0), (1, 7))]
    blocks = written(parts[0].unionByName(parts[1]))
    updated, _, stats = train.super_step(blocks, params, words, _explicit, (RATE, RATE))
    rows = updated.select("matrix", "row_id", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))
    total = spark.createDataFrame([(-1, stats.positives, stats.tokens, round(stats.loss, 6))], "matrix int, row_id long, dim int, v double")
    return rows.unionByName(total)


def trainer_negatives(spark, d) -> DataFrame:
    """The negatives that the trainer draws for one output of every row id."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy(zero_copy_only=False)
            drawn = sampling.negative_draws(row % (N * BAND), [3, row], N, 0.5, BAND, attempts=4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(drawn)], names=["row_id", "negative"])

    return table(spark, d, "params").select("row_id").distinct().mapInArrow(draw, "row_id long, negative long")


def training_totals(spark, d) -> DataFrame:
    """Tokens, positives and model sizes of one pass that keeps every token, windows of one."""
    common = CommonConfig(dims=4, epochs=1, negative_samples=2)
    config = RunConfig("documents", "", common, SimpleVocabConfig(Cutoff("MinCount", 20), 1e9), SkipGramConfig(ModelType.DIRGRAM, 1))
    trainer = trainer_for(written(sentences(spark, d)), config)
    vocab = trainer.vocab
    start = cli.initial_params(spark, vocab.table, trainer.n_output_types, common.dims)
    trained = train.train(trainer, start, vocab.n_tokens, common, max_passes=1)
    rows = trained.params.groupBy("matrix").count().collect()
    n = {r["matrix"]: r["count"] for r in rows}
    return spark.createDataFrame(
        [(trained.tokens, trained.positives, vocab.size, trainer.n_output_types, n[train.INPUT], n[train.OUTPUT], all(0 < x < 9 for x in trained.losses))],
        "tokens long, positives long, words long, output_types long, input_rows long, output_rows long, losses_sound boolean",
    )


# ---------------------------------------------------------------- sinks


def _model(spark, d) -> tuple[DataFrame, RunConfig]:
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("idx"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("label"), F.col("embedding").cast("array<double>").alias("mean"))
    full = rows.withColumn("vec", vec.l2_normalize(F.col("mean"))).withColumn("norm", vec.l2_norm(F.col("mean")))
    return full, RunConfig("c", "", CommonConfig(dims=64), SimpleVocabConfig(), SkipGramConfig())


def _written_model(spark, d, kind: EmbeddingFormat) -> str:
    from dataclasses import replace

    full, config = _model(spark, d)
    vocab = full.select("idx", "label", F.lit(7).cast("long").alias("count"))
    params = full.select(F.lit(train.INPUT).alias("matrix"), F.col("idx").alias("row_id"), F.col("mean").cast("array<float>").alias("vec"))
    local = lambda path: path.removeprefix("file://") if kind == EmbeddingFormat.WORD2VEC else path
    write = lambda path: sinks.write_model(vocab, full, params, replace(config, output=local(path), common=replace(config.common, format=kind)), sinks.TrainInfo.start("c", "o", 3))
    return local(sinks_path(spark, write))


def model_text_rows(spark, d) -> DataFrame:
    """The lines of a model file with header, read back: the header's numbers, then word and values."""
    lines = spark.read.text(_written_model(spark, d, EmbeddingFormat.TEXTDIMS))
    parts = lines.select(F.split("value", " ").alias("p"))
    return parts.select(F.element_at("p", 1).alias("label"), F.posexplode(F.expr("slice(p, 2, size(p) - 1)")).alias("dim", "v")).withColumn("v", F.round(F.col("v").cast("float").cast("double"), 6))


def model_word2vec_rows(spark, d) -> DataFrame:
    """The words and values of a word2vec file, read back."""
    path = _written_model(spark, d, EmbeddingFormat.WORD2VEC)
    rows = [(i, w, [round(float(x), 6) for x in v]) for i, (w, v) in enumerate(sinks.read_word2vec(path))]
    return spark.createDataFrame(rows, "idx long, label string, x array<double>").select("idx", "label", F.posexplode("x").alias("dim", "v"))


def model_tables(spark, d) -> DataFrame:
    """Unit vectors times norms of the canonical tables, read back with the counts."""
    path = _written_model(spark, d, EmbeddingFormat.NATIVE)
    words, norms, vocab = (spark.read.parquet(f"{path}/{t}") for t in ("words", "norms", "vocab"))
    joined = words.join(norms, "idx").join(vocab.select("idx", "count"), "idx")
    flat = joined.select("idx", "label", "count", F.posexplode(F.transform("vec", lambda x: x * F.col("norm"))).alias("dim", "v"))
    return flat.withColumn("v", F.round("v", 6))


def model_metadata(spark, d) -> DataFrame:
    """The metadata of a written model, without its times, as paths and values."""
    import json

    path = _written_model(spark, d, EmbeddingFormat.NATIVE)
    document = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    for key in ("start_datetime", "end_datetime", "output"):
        document["training_info"].pop(key)
    document.pop("version_info")

    def leaves(value, at=""):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from leaves(v, f"{at}.{k}" if at else k)
        else:
            yield at, str(value)

    return spark.createDataFrame(sorted(leaves(document)), "path string, value string")


def model_fasttext_rows(spark, d) -> DataFrame:
    """Every word of a fastText file with its count and the mean of its rows, read back."""
    config = RunConfig("c", "", CommonConfig(dims=2), SubwordVocabConfig(Cutoff("MinCount", 20), indexer=BucketConfig(10, BucketIndexerType.FASTTEXT)), SkipGramConfig())
    built = build_vocabulary(tokens(spark, d), config.vocab)
    params = cli.initial_params(spark, built.table, built.size, 2)
    path = sinks_path(spark, lambda p: sinks.write_fasttext(built.table, params, config, p.removeprefix("file://"))).removeprefix("file://")
    arguments, words, matrix = sinks.read_fasttext(path)
    assert (arguments["dim"], arguments["bucket"], len(matrix)) == (2, 1024, built.size + 1024)
    ids = built.table.select("idx", "subwords").orderBy("idx").toArrow()["subwords"].to_pylist()
    rows = [(w, n, *(round(float(x), 6) for x in matrix[[*s, i]].astype(float).mean(axis=0))) for i, ((w, n), s) in enumerate(zip(words, ids))]
    return spark.createDataFrame(rows, "label string, count long, a double, b double")


# ---------------------------------------------------------------- dependency contexts

OPTIONS = [(r, n, u) for r in (False, True) for n in (False, True) for u in (False, True)]
#: Trees that real files may hold by mistake: cycles, heads that are missing, a token that is its own head.
PLANTED = [
    (1, [(1, "A", 2, "x"), (2, "B", 1, "y")]),
    (2, [(1, "A", 9, "x"), (2, "<root>", 1, "y"), (3, "C", 2, "z")]),
    (3, [(1, "A", 1, "x"), (2, "B", 1, "y"), (3, "C", 0, "z")]),
    (4, [(1, "A", 2, "x"), (2, "B", 3, "y"), (3, "C", 1, "z"), (4, "D", 1, "u")]),
]


def _with_options(trees: DataFrame) -> DataFrame:
    out = None
    for i, (root, lower, untyped) in enumerate(OPTIONS):
        one = deps.dependency_contexts(trees, DepembedsConfig(depth=2, use_root=root, normalize=lower, untyped=untyped)).drop("seq").withColumn("options", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def parsed_contexts_options(spark, d) -> DataFrame:
    """Contexts of the parsed trees in documents under all eight combinations of options, to depth 2."""
    return _with_options(corpus.document_trees(spread(table(spark, d, "documents").select("doc_id", "text"))))


def planted_contexts_options(spark, d) -> DataFrame:
    """As parsed_contexts_options, of trees with cycles and missing heads."""
    return _with_options(spark.createDataFrame(PLANTED, f"sent_id long, nodes array<{corpus.NODE}>"))


def _crossing_trees(spark, d) -> DataFrame:
    """Trees over all sentences in which a token hangs on one of the five before it; many arcs cross."""
    back = lambda t: F.ascii(F.md5(t)) % 5 + 1
    node = lambda t, i: F.struct((i + 1).cast("int").alias("id"), t.alias("form"), F.greatest(F.lit(0), i + 1 - back(t)).cast("int").alias("head"), F.lit("r").alias("rel"))
    return sentences(spark, d).select("sent_id", F.transform("tokens", node).alias("nodes"))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens, crossing arcs and heads that were not above the token before, for each tree."""
    for batch in batches:
        rows = []
        for sent, before, after in zip(*(c.to_pylist() for c in batch.columns)):
            old, new = ([n["head"] for n in t] for t in (before, after))
            wrong = 0
            for i, h in enumerate(new):
                j = old[i]
                while j and j != h:
                    j = old[j - 1]
                wrong += j != h
            crossing, ends = 0, []
            for lo, hi in sorted(((min(i, h), max(i, h)) for i, h in enumerate(new, 1)), key=lambda x: (x[0], -x[1])):
                while ends and ends[-1] <= lo:
                    ends.pop()
                crossing += bool(ends) and hi > ends[-1]
                ends.append(hi)
            rows.append((sent, len(new), crossing, wrong, sum(h == 0 for h in new) >= sum(h == 0 for h in old)))
        columns = list(zip(*rows)) or [[]] * 5
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["sent_id", "n_tokens", "crossing", "not_above", "roots_stay"])


def projectivized_checks(spark, d) -> DataFrame:
    """For trees with many crossing arcs over all sentences: what is left after lifting."""
    trees = written(_crossing_trees(spark, d))
    both = trees.withColumnRenamed("nodes", "before").join(deps.projectivize(trees).withColumnRenamed("nodes", "after"), "sent_id")
    return both.select("sent_id", "before", "after").mapInArrow(_judge, "sent_id long, n_tokens int, crossing int, not_above int, roots_stay boolean")


# ---------------------------------------------------------------- configuration


def configured_runs(spark, d) -> DataFrame:
    """What the command line makes of its defaults and of some options."""
    runs = {
        "skipgram": ["skipgram", "c", "o"],
        "structgram": ["skipgram", "c", "o", "--model", "structgram", "--context", "7", "--subwords", "none", "--target-size", "9"],
        "dirgram": ["skipgram", "c", "o", "--model", "dirgram", "--subwords", "ngrams", "--ngram-mincount", "3"],
        "deps": ["deps", "c", "o", "--dependency-depth", "0", "--untyped-deps", "--context-target-size", "11"],
    }
    rows = []
    for name, argv in runs.items():
        c = cli.configure(cli.parser().parse_args(argv))
        window = isinstance(c.model, SkipGramConfig)
        shown = {
            "dims": c.common.dims, "epochs": c.common.epochs, "ns": c.common.negative_samples, "lr": c.common.lr, "zipf": c.common.zipf_exponent,
            "cutoff": f"{c.vocab.cutoff.type} {c.vocab.cutoff.value}", "discard": c.vocab.discard_threshold,
            "band": c.model.model.band(c.model.context_size) if window else 1,
            "ngrams": f"{c.vocab.min_n} {c.vocab.max_n}" if isinstance(c.vocab, SubwordVocabConfig) else "none",
            "contexts": "window" if window else f"{c.model.context_cutoff.type} {c.model.context_cutoff.value} {c.model.depth} {c.model.untyped}",
        }
        rows += [(name, k, str(v)) for k, v in shown.items()]
    return spark.createDataFrame(rows, "run string, option string, value string")


def refused(spark, d) -> DataFrame:
    """Calls that must fail, and whether they do."""
    empty = sentences(spark, d).limit(0)
    run = RunConfig("x", "y", CommonConfig(dims=2, epochs=1), SimpleVocabConfig(), SkipGramConfig())
    short = table(spark, d, "embeddings").select(vec.dot(F.col("embedding"), F.array(F.lit(1.0))))
    cases = {
        "empty corpus": lambda: cli.fit(spark, run, empty),
        "part out of range": lambda: corpus.chunk_start(f"{d}/documents.parquet", 3, 3),
        "vectors of different length": lambda: short.collect(),
        "fasttext without its buckets": lambda: RunConfig("x", "y", CommonConfig(format=EmbeddingFormat.FASTTEXT)),
        "two cutoffs": lambda: Cutoff.of(1, 2),
        "unknown model": lambda: ModelType.parse("cbow"),
        "unknown loss": lambda: LossType.parse(1),
        "unknown format": lambda: EmbeddingFormat.parse("json"),
        "unknown indexer": lambda: BucketIndexerType.parse("md5"),
        "nothing to draw from": lambda: sampling.zipf_draw(F.lit(0.5), 0),
        "one output row": lambda: sampling.negative_draws(np.zeros(1, int), [0], 1, 0.5, 1),
        "malformed tree": lambda: corpus.parse_trees(spark.createDataFrame([("1\tw\t_",)], "value string"), strict=True).collect(),
    }

    def fails(call) -> bool:
        try:
            call()
        except Exception:
            return True
        return False

    return spark.createDataFrame([(name, fails(call)) for name, call in cases.items()], "case string, refused boolean")


QUERIES = {
    "train_super_step": train_super_step,
    "trainer_negatives": trainer_negatives,
    "training_totals": training_totals,
    "model_text_rows": model_text_rows,
    "model_word2vec_rows": model_word2vec_rows,
    "model_tables": model_tables,
    "model_metadata": model_metadata,
    "model_fasttext_rows": model_fasttext_rows,
    "parsed_contexts_options": parsed_contexts_options,
    "planted_contexts_options": planted_contexts_options,
    "projectivized_checks": projectivized_checks,
    "configured_runs": configured_runs,
    "refused": refused,
}

# ---------------------------------------------------------------- SQL

_STEP = f"""WITH m AS (SELECT count(*) // 4 AS m FROM embeddings),
e AS (SELECT vec_id AS r, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
u AS (SELECT r // 2 AS w, dim, avg(v::DOUBLE) AS u FROM e, m WHERE r // 2 < m GROUP BY ALL),
len AS (SELECT w, sum(u * u) AS uu FROM u GROUP BY 1),
ex AS (SELECT p.part, w.w, k.k, 4 * ((w.w + p.s) % m) + k.k AS o, (k.k = 0)::INTEGER AS label
    FROM m, (VALUES (0, 0), (1, 7)) p(part, s), (SELECT unnest(range((SELECT m FROM m))) AS w) w, (SELECT unnest([0, 1, 2, 3]) AS k) k),
dot AS (SELECT part, ex.w, k, o, label, sum(u.u * e.v) AS a, sum(e.v::DOUBLE * e.v) AS ww FROM ex JOIN e ON e.r = o JOIN u ON u.w = ex.w AND u.dim = e.dim GROUP BY ALL),
j AS (SELECT *, {_LOGISTIC} AS y FROM dot),
g AS (SELECT part, w, k, o, ww, {RATE}::DOUBLE * (label - y) AS g, {RATE}::DOUBLE * greatest(y * (1 - y), {train.LEAST_CURVE}::DOUBLE * abs(label - y)) AS c,
    -ln(CASE WHEN label = 1 THEN y ELSE 1 - y END + 1e-5::DOUBLE) AS loss FROM j),
outs AS (SELECT 1 AS matrix, o AS r, e.dim, ((e.v::DOUBLE + g * u)::FLOAT - e.v) AS d, c * uu AS h
    FROM g JOIN e ON e.r = o JOIN u ON u.w = g.w AND u.dim = e.dim JOIN len ON len.w = g.w),
back AS (SELECT part, g.w, e.dim, sum(g * e.v) AS d FROM g JOIN e ON e.r = o GROUP BY ALL),
bend AS (SELECT part, w, sum(c * ww) AS h FROM g GROUP BY ALL),
ins AS (SELECT 0 AS matrix, e.r, e.dim, ((e.v + back.d::FLOAT) - e.v) AS d, h FROM back JOIN bend USING (part, w) JOIN e ON e.r // 2 = back.w AND e.dim = back.dim),
moved AS (SELECT matrix, r, dim, sum(d::DOUBLE) * (1 - exp(-sum(h))) / sum(1 - exp(-h)) AS d FROM (FROM outs UNION ALL FROM ins) GROUP BY ALL)
SELECT b.matrix::INTEGER AS matrix, e.r AS row_id, e.dim::INTEGER AS dim, round((e.v::DOUBLE + coalesce(moved.d, 0))::FLOAT::DOUBLE, 6) AS v
FROM e CROSS JOIN (VALUES (0), (1)) b(matrix) LEFT JOIN moved ON moved.matrix = b.matrix AND moved.r = e.r AND moved.dim = e.dim
UNION ALL SELECT -1, 2 * m, (2 * m)::INTEGER, (SELECT round(sum(loss), 6) FROM g) FROM m"""

_TRIES = "SELECT row_id, a FROM (SELECT DISTINCT row_id FROM params), (SELECT unnest(range(4)) AS a)"
_low = sampling._antiderivative(1.5, 0.5) - 1
_span = sampling._antiderivative(N + 0.5, 0.5) - _low
_X = f"(1.0::DOUBLE + (r.u * {_span!r}::DOUBLE + {_low!r}::DOUBLE) / 2)"
_NEGATIVES = f"""WITH r AS ({_hashed(_TRIES, "row_id, a", "0", "a", "3", "row_id")}), b AS ({_hashed(_TRIES, "row_id, a", "1", "a", "3", "row_id")}),
t AS (SELECT row_id, a, (greatest(1, least({N}, floor({_X} * {_X})))::BIGINT - 1) * {BAND} + floor(b.u * {BAND})::BIGINT AS n FROM r JOIN b USING (row_id, a))
SELECT row_id, coalesce(arg_min(n, a) FILTER (WHERE n <> row_id % {N * BAND}), (row_id % {N * BAND} + 1) % {N * BAND}) AS negative FROM t GROUP BY row_id"""


def _options(source: str) -> str:
    """Contexts to depth 2 of ``source`` (``sent_id, pos, id, form, head, rel``) under all options.

    A head is the first node of its id; a climb ends after as many steps as the tree has nodes."""
    cases = []
    for i, (root, lower, untyped) in enumerate(OPTIONS):
        form = "lower(form)" if lower else "form"
        typed = "NULL::INTEGER AS direction, NULL::INTEGER AS depth, NULL::VARCHAR AS dep_label" if untyped else "direction, depth, dep_label"
        where = "" if root else f"WHERE {form} IS DISTINCT FROM '<root>'"
        cases.append(f"SELECT sent_id, focus, {int(untyped)} AS kind, {typed}, {form} AS form, {i} AS options FROM ctx {where}")
    return f"""WITH {source}, n AS (SELECT *, count(*) OVER (PARTITION BY sent_id) AS size FROM nodes),
h AS (SELECT n.*, f.pos AS up, f.form AS up_form FROM n LEFT JOIN (SELECT sent_id, id, min(pos) AS pos, arg_min(form, pos) AS form FROM n GROUP BY ALL) f
    ON f.sent_id = n.sent_id AND f.id = n.head AND n.head > 0),
one AS (SELECT h.*, 1 AS depth, pos AS node, rel AS node_rel, form AS node_form FROM h),
two AS (SELECT h.*, 2 AS depth, one.node, one.node_rel, one.node_form FROM one JOIN h ON h.sent_id = one.sent_id AND h.pos = one.up WHERE one.size > 1),
climb AS (FROM one UNION ALL FROM two),
ctx AS (SELECT sent_id, node::INTEGER AS focus, 0 AS direction, depth, rel AS dep_label, CASE WHEN up IS NULL THEN '<root>' ELSE up_form END AS form FROM climb
    UNION ALL SELECT sent_id, up::INTEGER, 1, depth, node_rel, node_form FROM climb WHERE up IS NOT NULL)
{" UNION ALL ".join(cases)}"""


_PLANTED_ROWS = ", ".join(f"({s}, {i}, {n[0]}, '{n[1]}', {n[2]}, '{n[3]}')" for s, nodes in PLANTED for i, n in enumerate(nodes))
_FT_M = (1 << 10) - 1
_values = lambda rows: "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("TRUE" if x is True else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows) + ")"
SQL = {
    "train_super_step": _STEP,
    "trainer_negatives": _NEGATIVES,
    "training_totals": f"""WITH {VOCAB}, v AS (SELECT label FROM counts WHERE "count" >= 20), k AS (SELECT sent_id, count(*) AS n FROM toks JOIN v ON token = label GROUP BY 1),
        w AS (SELECT count(*) AS w FROM v)
        SELECT sum(n)::BIGINT AS tokens, sum(2 * (n - 1))::BIGINT AS positives, any_value(w) AS words, any_value(2 * w) AS output_types,
            any_value(w) AS input_rows, any_value(2 * w) AS output_rows, TRUE AS losses_sound FROM k, w""",
    "model_text_rows": """SELECT (SELECT count(*) FROM embeddings)::VARCHAR AS label, 0::INTEGER AS dim, 64::DOUBLE AS v
        UNION ALL SELECT 'w' || vec_id, (i - 1)::INTEGER, round(v::DOUBLE, 6) FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)""",
    "model_word2vec_rows": """SELECT vec_id AS idx, 'w' || vec_id AS label, (i - 1)::INTEGER AS dim, round(v::DOUBLE, 6) AS v
        FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)""",
    "model_tables": """SELECT vec_id AS idx, 'w' || vec_id AS label, 7::BIGINT AS "count", (i - 1)::INTEGER AS dim, round(v::DOUBLE, 6) AS v
        FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)""",
    "model_metadata": "SELECT col0 AS path, col1 AS value FROM (" + _values(sorted({
        "common_config.loss": "logistic_negative_sampling", "common_config.dims": "64", "common_config.epochs": "15", "common_config.negative_samples": "5",
        "common_config.lr": "0.05", "common_config.zipf_exponent": "0.5", "model_config.type": "SkipGramLike", "model_config.model": "skipgram",
        "model_config.context_size": "10", "vocab_config.type": "SimpleVocab", "vocab_config.cutoff.type": "MinCount", "vocab_config.cutoff.value": "5",
        "vocab_config.discard_threshold": "0.0001", "training_info.corpus": "c", "training_info.n_threads": "3",
    }.items())) + ")",
    "model_fasttext_rows": f"""WITH {_vocab('"count" >= 20')}, n AS (SELECT count(*) AS n FROM vocab),
        g AS (SELECT idx, unnest(range(1, length(label) + 3)) AS p, '<' || label || '>' AS w FROM vocab),
        grams AS (SELECT idx, substr(w, p, k) AS ngram FROM g, (SELECT unnest([3, 4, 5, 6]) AS k) WHERE p + k - 1 <= length(w)),
        hashed AS (SELECT ngram, {bucket32(_FT_M)} AS b FROM (SELECT DISTINCT ngram FROM grams)),
        ids AS (SELECT idx, b + n AS r FROM grams JOIN hashed USING (ngram), n UNION ALL SELECT idx, idx FROM vocab),
        start AS (SELECT r, {", ".join(f"((2 * {U.format(f"'i|0|in|' || r || '|{q}'")} - 1) / 2.0::DOUBLE)::FLOAT::DOUBLE AS {c}" for q, c in enumerate("ab"))} FROM (SELECT DISTINCT r FROM ids))
        SELECT label, any_value("count") AS "count", round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM vocab JOIN ids USING (idx) JOIN start USING (r) GROUP BY idx, label""",
    "planted_contexts_options": _options(f"nodes AS (SELECT * FROM (VALUES {_PLANTED_ROWS}) t(sent_id, pos, id, form, head, rel))"),
    "parsed_contexts_options": _options(f"{TREES}, nodes AS (SELECT sent_id, row_number() OVER (PARTITION BY sent_id ORDER BY i) - 1 AS pos, id, form, head, rel FROM parsed)"),
    "projectivized_checks": f"WITH {SENTS} SELECT sent_id, len(tokens)::INTEGER AS n_tokens, 0::INTEGER AS crossing, 0::INTEGER AS not_above, TRUE AS roots_stay FROM sents",
    "configured_runs": "SELECT col0 AS run, col1 AS option, col2 AS value FROM (" + _values([
        (run, k, str({**dict(dims=300, epochs=15, ns=5, lr=0.05, zipf=0.5, cutoff="MinCount 5", discard=0.0001, band=1, ngrams="3 6", contexts="window"), **other}[k]))
        for run, other in {"skipgram": {}, "structgram": dict(band=14, ngrams="none", cutoff="TargetSize 9"), "dirgram": dict(band=2), "deps": dict(contexts="TargetSize 11 0 True")}.items()
        for k in ("dims", "epochs", "ns", "lr", "zipf", "cutoff", "discard", "band", "ngrams", "contexts")
    ]) + ")",
    "refused": 'SELECT col0 AS "case", col1 AS refused FROM (' + _values([(c, True) for c in (
        "empty corpus", "part out of range", "vectors of different length", "fasttext without its buckets", "two cutoffs", "unknown model", "unknown loss",
        "unknown format", "unknown indexer", "nothing to draw from", "one output row", "malformed tree",
    )]) + ")",
}
