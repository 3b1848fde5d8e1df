"""Queries over dependency trees, samplers, vectors and training, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.cli import fit
from wordloom.config import CommonConfig, Cutoff, DepembedsConfig, RunConfig, SimpleVocabConfig, SkipGramConfig
from wordloom.durable import written
from wordloom.functions import vectors as vec
from wordloom.functions.rand import uniform
from wordloom.operators import deps, sampling, train
from wordloom.operators.vocab import build_vocabulary, context_vocabulary
from wordloom.plans.corpus import SENTS, U, VOCAB, sentences, simple_vocab
from wordloom.session import table

N, BAND, DIMS, STEP_LR = 1000, 10, 16, 0.05


def trees(spark, d) -> DataFrame:
    return deps.synthetic_trees(sentences(spark, d))


def dep_paths(spark, d):
    return deps.root_paths(trees(spark, d))


def _contexts(**options):
    def query(spark, d):
        return deps.dependency_contexts(trees(spark, d), DepembedsConfig(**options)).drop("seq")

    return query


def dep_context_vocab(spark, d):
    contexts = deps.dependency_contexts(trees(spark, d), DepembedsConfig())
    ranked = context_vocabulary(contexts, Cutoff(), 1e-4)
    return ranked.select("idx", *deps.CONTEXT, "count", F.round("keep_prob", 6).alias("keep_prob"))


def dep_train_pairs(spark, d):
    source = written(trees(spark, d))
    words = build_vocabulary(source.select(F.explode("nodes.form").alias("token")), SimpleVocabConfig()).table
    ranked = written(context_vocabulary(deps.dependency_contexts(source), Cutoff(), 1e-4))
    pairs = deps.training_pairs(source, DepembedsConfig(), words, ranked)
    return pairs.withColumn("contexts", F.array_join(F.col("contexts").cast("array<string>"), " "))


def projectivized_trees(spark, d):
    from wordloom.sources.corpus import document_trees

    out = deps.projectivize(document_trees(table(spark, d, "documents")))
    return out.select("sent_id", F.explode("nodes").alias("n")).select("sent_id", "n.id", "n.form", "n.head", "n.rel")


def _draws(spark, d):
    return table(spark, d, "params").select("row_id").distinct()


def weighted_draws(spark, d):
    """One draw for every row id from the counts of the vocabulary."""
    words = simple_vocab(spark, d).table.select(F.col("idx").alias("item"), F.col("count").alias("weight"))
    return sampling.weighted_draws(_draws(spark, d), uniform("r", F.col("row_id")), words)


def zipf_draws(spark, d):
    """One draw by the observed law and one by the textbook law for every row id."""
    draws = _draws(spark, d).withColumn("observed", sampling.zipf_draw(uniform("z", 0, F.col("row_id")), N))
    both = sampling.weighted_draws(draws, uniform("y", F.col("row_id")), sampling.zipf_weights(spark, N))
    return both.withColumnRenamed("item", "analytic")


def banded_draws(spark, d):
    rank = sampling.zipf_draw(uniform("z", 0, F.col("row_id")), N)
    return _draws(spark, d).select("row_id", sampling.banded(rank, uniform("b", 0, F.col("row_id")), BAND).alias("item"))


def negative_samples(spark, d):
    positive = F.col("row_id") % (N * BAND)
    drawn = sampling.negative_sample(positive, [F.col("row_id")], N, 0.5, BAND, attempts=3)
    return _draws(spark, d).select("row_id", drawn.alias("negative"))


def model_init(spark, d):
    rows = sampling.initial_vectors(spark, "in", table(spark, d, "embeddings").count(), DIMS)
    return rows.select("row_id", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))


def _neighbours(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id")


def _flat(df: DataFrame, column: str) -> DataFrame:
    out = df.select("vec_id", F.posexplode(column).alias("dim", "v"))
    return out.withColumn("v", F.round("v", 6))


def vec_dot(spark, d):
    return _neighbours(spark, d).select("vec_id", F.round(vec.dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


def vec_scale(spark, d):
    e = table(spark, d, "embeddings")
    return _flat(e.select("vec_id", vec.scale(F.col("embedding"), F.col("vec_id").cast("double") % 7 + 0.5).alias("x")), "x")


def vec_scaled_add(spark, d):
    return _flat(_neighbours(spark, d).select("vec_id", vec.scaled_add(F.col("embedding"), F.col("other"), 0.5).alias("x")), "x")


def vec_l2_normalize(spark, d):
    scaled = vec.scale(F.col("embedding"), F.col("vec_id").cast("double") % 7 + 0.5)
    return _flat(table(spark, d, "embeddings").select("vec_id", vec.l2_normalize(scaled).alias("x")), "x")


def mean_embedding(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("vec_id"), "embedding")
    return _flat(train.mean_vectors(rows, ["vec_id"], "embedding"), "mean")


def logistic_loss(spark, d):
    scaled = vec.dot(F.col("embedding"), F.col("other")) * (F.col("vec_id") % 40)
    judged = vec.logistic_loss(F.col("a"), F.col("label"))
    rows = _neighbours(spark, d).select("vec_id", scaled.alias("a"), (F.col("vec_id") % 2).alias("label"))
    return rows.select("vec_id", F.round(judged["loss"], 6).alias("loss"), F.round(judged["grad"], 6).alias("grad"))


def _step_examples(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    n = e.count()
    i = F.col("row_id")
    outputs = F.array(*[F.struct(F.lit(k).alias("k"), ((i * a + b) % n).alias("output"), F.lit(int(k == 0)).alias("label")) for k, (a, b) in enumerate([(3, 2), (5, 11), (11, 3)])])
    ids = F.array(i, (i * 7 + 1) % n, (i * 13 + 5) % n)
    return e.select(i.alias("ex_id"), ids.alias("ids"), F.explode(outputs).alias("o")).select("ex_id", "ids", "o.k", "o.output", "o.label"), e


def sgd_relational_step(spark, d):
    examples, e = _step_examples(spark, d)
    out = train.relational_step(examples, e, e, STEP_LR)
    return out.withColumn("value", F.round("value", 6))


def train_loss(spark, d):
    rows = _neighbours(spark, d).select(vec.dot(F.col("embedding"), F.col("other")).alias("a"), (F.col("vec_id") % 2).alias("label"))
    judged = rows.select("label", vec.logistic_loss(F.col("a"), F.col("label"))["loss"].alias("loss"))
    return train.train_loss(judged).select(F.round("loss", 6).alias("loss"))


def trained_model(spark, d):
    """A window model trained for one epoch of documents (kept tokens, so several passes): word and unit vector."""
    config = RunConfig("documents", "", CommonConfig(dims=DIMS, epochs=1, negative_samples=3), SimpleVocabConfig(), SkipGramConfig(context_size=3))
    _, final, _ = fit(spark, config, sentences(spark, d))
    return final.select("idx", "label", "vec", "norm")


QUERIES = {
    "dep_paths": dep_paths,
    "dep_contexts_typed": _contexts(depth=1),
    "dep_contexts_untyped": _contexts(depth=2, use_root=True, normalize=True, untyped=True),
    "dep_contexts_normalized": _contexts(depth=2, normalize=True),
    "dep_contexts_root": _contexts(depth=2, use_root=True),
    "dep_contexts_unlimited_depth": _contexts(depth=0, use_root=True),
    "dep_context_vocab": dep_context_vocab,
    "dep_train_pairs": dep_train_pairs,
    "projectivized_trees": projectivized_trees,
    "weighted_draws": weighted_draws,
    "zipf_draws": zipf_draws,
    "banded_draws": banded_draws,
    "negative_samples": negative_samples,
    "model_init": model_init,
    "vec_dot": vec_dot,
    "vec_scale": vec_scale,
    "vec_scaled_add": vec_scaled_add,
    "vec_l2_normalize": vec_l2_normalize,
    "mean_embedding": mean_embedding,
    "logistic_loss": logistic_loss,
    "sgd_relational_step": sgd_relational_step,
    "train_loss": train_loss,
    "trained_model": trained_model,
}

# ---------------------------------------------------------------- SQL

_NODES = f"{SENTS}, nodes AS (SELECT sent_id, pos + 1 AS id, token AS form, (pos + 1) // 2 AS head, 'r' || (length(token) % 4) AS rel FROM toks)"


def _hashed(source: str, keep: str, *parts: str) -> str:
    """``source`` with ``u``, a number in [0, 1) hashed from the integers ``parts``."""
    word = lambda x: f"({x})::UHUGEINT"
    cut = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    golden = "11400714819323198485::UBIGINT"
    sql = f"SELECT *, {golden} AS h FROM ({source})"
    for p in parts:
        sql = f"SELECT * REPLACE ({cut(f'{word(p)} + {word("h")} + {word(golden)}')} AS h) FROM ({sql})"
        for shift, factor in ((30, "13787848793156543929"), (27, "10723151780598845931")):
            sql = f"SELECT * REPLACE ({cut(f'{word(f"xor(h, h >> {shift})")} * {word(factor)}')} AS h) FROM ({sql})"
        sql = f"SELECT * REPLACE (xor(h, h >> 31) AS h) FROM ({sql})"
    return f"SELECT {keep}, (h >> 11)::DOUBLE / 9007199254740992 AS u FROM ({sql})"


def _climb(limit: str) -> str:
    return f"""WITH RECURSIVE {_NODES},
climb AS (SELECT sent_id, id AS node, id AS cur, head, 1 AS depth FROM nodes
    UNION ALL SELECT c.sent_id, c.node, n.id, n.head, c.depth + 1 FROM climb c JOIN nodes n ON n.sent_id = c.sent_id AND n.id = c.head WHERE {limit}),
ctx AS (SELECT c.sent_id, c.node - 1 AS focus, 0 AS direction, c.depth, n.rel AS dep_label, coalesce(h.form, '<root>') AS form, c.node
      FROM climb c JOIN nodes n ON n.sent_id = c.sent_id AND n.id = c.cur LEFT JOIN nodes h ON h.sent_id = c.sent_id AND h.id = c.head
    UNION ALL SELECT c.sent_id, c.head - 1, 1, c.depth, n.rel, n.form, c.node
      FROM climb c JOIN nodes n ON n.sent_id = c.sent_id AND n.id = c.node WHERE c.head > 0)
"""


def _ctx(depth: int, root: bool, lower: bool = False, untyped: bool = False) -> str:
    form = "lower(form)" if lower else "form"
    typed = "NULL::INTEGER AS direction, NULL::INTEGER AS depth, NULL::VARCHAR AS dep_label" if untyped else "direction::INTEGER AS direction, depth::INTEGER AS depth, dep_label"
    where = "" if root else f"WHERE {form} <> '<root>'"
    limit = f"c.head > 0 AND c.depth < {depth}" if depth else "c.head > 0"
    return _climb(limit) + f"SELECT sent_id, focus::INTEGER AS focus, {int(untyped)}::INTEGER AS kind, {typed}, {form} AS form FROM ctx {where}"


_CVOCAB = (
    _climb("c.head > 0 AND c.depth < 1")
    + """, shown AS (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY node, depth, direction) - 1 AS seq FROM ctx),
kept_ctx AS (SELECT * FROM shown WHERE form <> '<root>'),
ccount AS (SELECT 0 AS kind, direction, depth, dep_label, form, count(*) AS "count" FROM kept_ctx GROUP BY ALL),
ctotal AS (SELECT sum("count")::DOUBLE AS t FROM ccount),
cvocab AS (SELECT row_number() OVER (ORDER BY "count" DESC, direction DESC, depth DESC, dep_label DESC, form DESC) - 1 AS idx, ccount.*,
    least(1.0::DOUBLE, 1e-4::DOUBLE / ("count"::DOUBLE / t) + sqrt(1e-4::DOUBLE / ("count"::DOUBLE / t))) AS keep_prob
    FROM ccount, ctotal WHERE "count" >= 5)
"""
)
_IDS = "ids AS (SELECT DISTINCT row_id FROM params)"
_low = sampling._antiderivative(1.5, 0.5) - 1
_span = sampling._antiderivative(N + 0.5, 0.5) - _low


def _zipf(key: str) -> str:
    y = f"({U.format(key)} * {_span!r}::DOUBLE + {_low!r}::DOUBLE)"
    x = f"(1.0::DOUBLE + {y} / 2) * (1.0::DOUBLE + {y} / 2)"
    return f"(greatest(1, least({N}, floor({x})))::BIGINT - 1)"


def _cumulated(source: str) -> str:
    return f"cum AS (SELECT item, sum(weight) OVER (ORDER BY item) - weight AS low, sum(weight) OVER (ORDER BY item) AS high, sum(weight) OVER () AS total FROM ({source}))"


def _band(a: int) -> str:
    rank, u = _zipf(f"'z|{a}|' || row_id"), U.format(f"'b|{a}|' || row_id")
    return f"({rank} * {BAND} + floor({u} * {BAND})::BIGINT)"


_PAIR = "pair AS (SELECT a.vec_id, a.embedding AS u, b.embedding AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_DOT = "list_sum(list_transform(range(1, len(u) + 1), lambda i: u[i]::DOUBLE * w[i]::DOUBLE))"
_LOGISTIC = "CASE WHEN a > 10 THEN 1.0::DOUBLE WHEN a < -10 THEN 0.0::DOUBLE ELSE 1.0 / (1.0 + exp(-a)) END"
_FLAT = "SELECT vec_id, (i - 1)::INTEGER AS dim, round(v, 6) AS v FROM (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM ({}))"
_SCALED = "list_transform(embedding, lambda e: e::DOUBLE * (vec_id % 7 + 0.5::DOUBLE))"
SQL = {
    "dep_paths": _climb("c.head > 0")
    + """SELECT c.sent_id, (node - 1)::INTEGER AS focus, depth::INTEGER AS step, coalesce(h.form, '<root>') AS form
        FROM climb c LEFT JOIN nodes h ON h.sent_id = c.sent_id AND h.id = c.head""",
    "dep_contexts_typed": _ctx(1, False),
    "dep_contexts_untyped": _ctx(2, True, True, True),
    "dep_contexts_normalized": _ctx(2, False, True),
    "dep_contexts_root": _ctx(2, True),
    "dep_contexts_unlimited_depth": _ctx(0, True),
    "dep_context_vocab": _CVOCAB
    + """SELECT idx, kind::INTEGER AS kind, direction::INTEGER AS direction, depth::INTEGER AS depth, dep_label, form, "count",
        round(keep_prob, 6) AS keep_prob FROM cvocab""",
    "dep_train_pairs": _CVOCAB.replace("WITH RECURSIVE " + SENTS, "WITH RECURSIVE " + VOCAB)
    + f""", focus AS (SELECT sent_id, pos, idx FROM ({_hashed("SELECT sent_id, pos, idx, keep_prob FROM toks JOIN vocab ON token = label", "sent_id, pos, idx, keep_prob", "2", "0", "sent_id", "pos")})
            WHERE u < keep_prob),
        drawn AS ({_hashed("SELECT k.sent_id, k.focus, k.seq, v.idx, v.keep_prob FROM kept_ctx k JOIN cvocab v USING (direction, depth, dep_label, form)", "sent_id, focus, seq, idx, keep_prob", "6", "0", "sent_id", "seq")}),
        found AS (SELECT sent_id, focus AS pos, string_agg(idx::VARCHAR, ' ' ORDER BY seq) AS contexts FROM drawn WHERE u < keep_prob GROUP BY 1, 2)
        SELECT sent_id, pos::INTEGER AS pos, idx AS focus_idx, coalesce(contexts, '') AS contexts FROM focus LEFT JOIN found USING (sent_id, pos)""",
    "weighted_draws": f"""WITH {VOCAB}, {_IDS}, {_cumulated('SELECT idx AS item, "count" AS weight FROM vocab')},
        d AS (SELECT row_id, 1 + floor({U.format("'r|' || row_id")} * (SELECT max(high) FROM cum))::BIGINT AS v FROM ids)
        SELECT row_id, item FROM d JOIN cum ON v > low AND v <= high""",
    "zipf_draws": f"""WITH {_IDS}, {_cumulated(f"SELECT k - 1 AS item, floor(1000000000::DOUBLE / sqrt(k::DOUBLE))::BIGINT AS weight FROM range(1, {N + 1}) t(k)")},
        d AS (SELECT row_id, {_zipf("'z|0|' || row_id")} AS observed,
              1 + floor({U.format("'y|' || row_id")} * (SELECT max(high) FROM cum)::DOUBLE)::BIGINT AS v FROM ids)
        SELECT row_id, observed, item AS analytic FROM d JOIN cum ON v > low AND v <= high""",
    "banded_draws": f"WITH {_IDS} SELECT row_id, {_band(0)} AS item FROM ids",
    "negative_samples": f"""WITH {_IDS}, t AS (SELECT row_id, row_id % {N * BAND} AS p, {_band(0)} AS a, {_band(1)} AS b, {_band(2)} AS c FROM ids)
        SELECT row_id, CASE WHEN a <> p THEN a WHEN b <> p THEN b WHEN c <> p THEN c ELSE (p + 1) % {N * BAND} END AS negative FROM t""",
    "model_init": f"""SELECT r AS row_id, q::INTEGER AS dim, round(((2 * {U.format("'i|0|in|' || r || '|' || q")} - 1) / {DIMS}::DOUBLE)::FLOAT::DOUBLE, 6) AS v
        FROM range((SELECT count(*) FROM embeddings)) a(r), range({DIMS}) b(q)""",
    "vec_dot": f"WITH {_PAIR} SELECT vec_id, round({_DOT}, 6) AS dot FROM pair",
    "vec_scale": _FLAT.format(f"SELECT vec_id, {_SCALED} AS x FROM embeddings"),
    "vec_scaled_add": f"WITH {_PAIR} " + _FLAT.format("SELECT vec_id, list_transform(range(1, len(u) + 1), lambda i: u[i]::DOUBLE + 0.5::DOUBLE * w[i]::DOUBLE) AS x FROM pair"),
    "vec_l2_normalize": _FLAT.format(
        f"SELECT vec_id, list_transform(s, lambda e: e / sqrt(list_sum(list_transform(s, lambda y: y * y)))) AS x FROM (SELECT vec_id, {_SCALED} AS s FROM embeddings)"
    ),
    "mean_embedding": """SELECT vec_id, dim::INTEGER AS dim, round(avg(v::DOUBLE), 6) AS v FROM (SELECT vec_id % 50 AS vec_id, unnest(embedding) AS v,
        generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY ALL""",
    "logistic_loss": f"""WITH {_PAIR}, t AS (SELECT vec_id, {_DOT} * (vec_id % 40) AS a, vec_id % 2 AS label FROM pair),
        y AS (SELECT *, {_LOGISTIC} AS y FROM t)
        SELECT vec_id, round(-ln(CASE WHEN label = 1 THEN y ELSE 1 - y END + 1e-5::DOUBLE), 6) AS loss, round(label - y, 6) AS grad FROM y""",
    "sgd_relational_step": f"""WITH n AS (SELECT count(*) AS n FROM embeddings),
        m AS (SELECT vec_id AS row_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
        ex AS (SELECT vec_id AS ex_id, unnest([vec_id, (vec_id * 7 + 1) % n, (vec_id * 13 + 5) % n]) AS row_id FROM embeddings, n),
        o AS (SELECT vec_id AS ex_id, k, (vec_id * a + b) % n AS output, CASE WHEN k = 0 THEN 1 ELSE 0 END AS label
              FROM embeddings, n, (VALUES (0, 3, 2), (1, 5, 11), (2, 11, 3)) t(k, a, b)),
        u AS (SELECT ex_id, dim, avg(v) AS u FROM ex JOIN m USING (row_id) GROUP BY ALL),
        f AS (SELECT o.ex_id, k, label, output, dim, u, v FROM o JOIN u USING (ex_id) JOIN m USING (dim) WHERE m.row_id = output),
        s AS (SELECT ex_id, k, any_value(label) AS label, sum(u * v) AS a FROM f GROUP BY 1, 2),
        j AS (SELECT *, {_LOGISTIC} AS y FROM s),
        g AS (SELECT ex_id, k, {STEP_LR}::DOUBLE * (label - y) AS g, -ln(CASE WHEN label = 1 THEN y ELSE 1 - y END + 1e-5::DOUBLE) AS loss FROM j),
        w AS (SELECT f.*, g FROM f JOIN g USING (ex_id, k)),
        back AS (SELECT ex_id, dim, sum(g * v) AS d FROM w GROUP BY ALL)
        SELECT kind, id, dim::INTEGER AS dim, round(value, 6) AS value FROM (
            SELECT 'out' AS kind, output AS id, dim, sum(g * u) AS value FROM w GROUP BY ALL
            UNION ALL SELECT 'in', row_id, dim, sum(d) FROM ex JOIN back USING (ex_id) GROUP BY ALL
            UNION ALL SELECT 'loss', ex_id, -1, sum(loss) FROM g GROUP BY ALL)""",
    "train_loss": f"""WITH {_PAIR}, t AS (SELECT {_DOT} AS a, vec_id % 2 AS label FROM pair), y AS (SELECT label, {_LOGISTIC} AS y FROM t)
        SELECT round(sum(-ln(CASE WHEN label = 1 THEN y ELSE 1 - y END + 1e-5::DOUBLE)) / sum(label), 6) AS loss FROM y""",
}
