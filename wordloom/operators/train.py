"""Training: the relational gradient step and the part-parallel trainer.

``relational_step`` is one synchronous step in DataFrame operations.  The
trainer runs super-steps.  The parts of a step train in parallel, each in the
sequential order (the focus mean once per focus, the old output vector for the
input delta, the delta in full to every input row) in NumPy on a copy of the
rows it touches; then the deltas of a row are merged.  One super-step is one
pass of Spark jobs over durable tables.  Parameters of bounded size stay with
the driver and go to every task, which trains its parts side by side and sums
their changes; larger ones are joined to the parts.  Both give the same rows.

Steps grow with the progress: the first ones are single parts, later ones take
a fixed share of all that was trained before, cut into parts of bounded size.
A row thus never misses more than that share of its own history, whatever the
corpus, and the number of steps is logarithmic in it.
"""

from __future__ import annotations

import gc
import logging
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.config import CommonConfig
from wordloom.durable import remove, shared_dir, written_at
from wordloom.operators.examples import Layout, Work
from wordloom.operators.lockstep import LEAST_CURVE, Part, lockstep_pass, runs

PARAMS = "matrix int, row_id long, vec array<float>"
INPUT, OUTPUT = 0, 1
#: Focus tokens of one part, the memory bound of a task.
PART_TOKENS = 10_000
#: Share of the tokens trained so far that one step may add, and its most parts.
GROWTH, MAX_PARTS = 0.25, 4096
#: Bytes of vectors, and of the words' input rows, up to which every task of a step gets all parameters.
HELD_BYTES = 32 << 20
#: Bytes of shuffle files after which those of past steps are collected.
LEFT_BYTES = 256 << 20
#: Most parts that a task trains at once, and bytes of their rows and outputs.
GROUP_PARTS, GROUP_BYTES = 256, 96 << 20

log = logging.getLogger("wordloom")

def learning_rate(processed, epochs: int, n_tokens: int, lr: float):
    """The rate after ``processed`` kept focus tokens (a number or a column), never below 0."""
    if isinstance(processed, Column):
        goal = F.lit(float(epochs * n_tokens))
        return F.greatest(F.lit(0.0), F.coalesce((1 - F.try_divide(processed.cast("double"), goal)) * F.lit(lr), F.lit(0.0)))
    return max(0.0, (1 - processed / (epochs * n_tokens)) * lr) if epochs * n_tokens else 0.0


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows sorted by the columns ``keys``, each key in one batch
    only, with the starts of the keys."""
    held: list[pa.RecordBatch] = []

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for i in keys:
            values = batch.column(i).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.concat_batches([*held, batch])
        at = starts(both)
        if len(at) > 1:
            yield both.slice(0, at[-1]), at[:-1]
        held = [both.slice(at[-1])]
    if held:
        yield held[0], np.zeros(1, int)


def _step_batches(lr: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changes of whole examples, vectors as arrays."""
    for rows, start in whole_groups(batches, [0]):
        ex_id, role, row_id, label = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        vec = _vectors(rows.column(4))
        sizes = np.diff(np.append(start, len(ex_id)))
        group, inn = np.repeat(np.arange(len(start)), sizes), role == INPUT
        many = np.add.reduceat(inn.astype(int), start)
        u = np.add.reduceat(vec * inn[:, None], start) / np.maximum(many, 1)[:, None]
        live = ~inn & (many[group] > 0)
        a = np.where(live, np.einsum("ij,ij->i", vec, u[group]), 0.0)
        y = np.where(a > 10, 1.0, np.where(a < -10, 0.0, 1 / (1 + np.exp(-np.clip(a, -10, 10)))))
        loss = np.where(live, -np.log(np.where(label == 1, y, 1 - y) + 1e-5), 0.0)
        g = np.where(live, lr * (label - y), 0.0)
        back = np.add.reduceat(g[:, None] * vec, start)
        fed = inn & np.logical_or.reduceat(live, start)[group]
        told = np.flatnonzero(np.logical_or.reduceat(live, start))
        parts = [("out", row_id[live], g[live, None] * u[group[live]]), ("in", row_id[fed], back[group[fed]]), ("loss", ex_id[start][told], np.add.reduceat(loss, start)[told, None])]
        for kind, ids, values in parts:
            offsets = pa.array((np.arange(len(ids) + 1) * values.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(ids), pa.string()), pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=["kind", "id", "value"])


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, start in whole_groups(batches, [0, 1]):
        kinds = rows.column(0).take(pa.array(start))
        loss = kinds[0].as_py() == "loss"
        if any((k == "loss") != loss for k in pc.unique(kinds).to_pylist()):  # losses have one number: apart from the vectors
            lone = pc.equal(rows.column(0), "loss")
            for some in (rows.filter(lone), rows.filter(pc.invert(lone))):
                yield from _sum_batches(iter([some]))
            continue
        values = np.add.reduceat(_vectors(rows.column(2)), start)
        offsets = pa.array((np.arange(len(start) + 1) * values.shape[1]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([kinds, rows.column(1).take(pa.array(start)), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=["kind", "id", "value"])


def relational_step(examples: DataFrame, inputs: DataFrame, outputs: DataFrame, lr: float) -> DataFrame:
    """One step: ``(kind, id, dim, value)`` with the changes of both matrices and the loss.

    ``examples`` has ``ex_id, k, ids, output, label``, one row per positive or
    negative, numbered by ``k`` within the example; rows of one ``ex_id``
    share the focus ``ids``.  ``kind`` is ``in`` or ``out`` for the change of
    row ``id``, ``loss`` for the summed loss of example ``id``.  For one focus
    whose outputs do not repeat this equals the sequential order; otherwise it
    is a synchronous mini-batch.  Vectors travel as arrays: one join a matrix,
    one exchange by example and one by row.
    """
    vectors = lambda df: df.select("row_id", F.col("vec").cast("array<double>").alias("vec"))
    shape = lambda df, role: df.select("ex_id", F.lit(role).alias("role"), "row_id", "label", "vec")
    focus = examples.select("ex_id", "ids").dropDuplicates(["ex_id"]).select("ex_id", F.explode("ids").alias("row_id"), F.lit(0).alias("label"))
    pairs = examples.select("ex_id", F.col("output").alias("row_id"), F.col("label").cast("int").alias("label"))
    rows = shape(focus.join(vectors(inputs), "row_id"), INPUT).unionByName(shape(pairs.join(vectors(outputs), "row_id"), OUTPUT))
    changes = rows.repartition("ex_id").sortWithinPartitions("ex_id").mapInArrow(lambda it: _step_batches(lr, it), "kind string, id long, value array<double>")
    # in, loss, out: the kinds in order
    summed = changes.repartition("kind", "id").sortWithinPartitions("kind", "id").mapInArrow(_sum_batches, "kind string, id long, value array<double>")
    flat = summed.select("kind", "id", F.posexplode("value").alias("dim", "value"))
    return flat.withColumn("dim", F.when(F.col("kind") == "loss", -1).otherwise(F.col("dim")))


def train_loss(losses: DataFrame, loss: str = "loss", label: str = "label") -> DataFrame:
    """``(loss)``: summed over positives and negatives, divided by the positives."""
    positives = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    return losses.agg(F.try_divide(F.sum(loss), positives).alias("loss"))


@dataclass(frozen=True)
class StepStats:
    loss: float
    positives: int
    tokens: int


def sequential_pass(
    examples: list[tuple[np.ndarray, np.ndarray]], rows_in: np.ndarray, rows_out: np.ndarray, rates, curve_in: np.ndarray | None = None, curve_out: np.ndarray | None = None
) -> float:
    """Train on ``(input rows, outputs)`` in order, changing both matrices in
    place; returns the summed loss.

    ``outputs`` has a row per context: the positive, then its negatives.
    ``rates`` is the learning rate, or one for each focus.  The mean ``u`` of
    the focus is not refreshed between its contexts and a context's delta goes
    in full to every input row.  An output row only ever moves along ``u``
    during one focus, so its activation follows from a scalar recurrence:
    repeats see what earlier ones changed, yet vectors are touched once per
    distinct row.  Sums are in double whatever the matrices hold.  The curve
    arrays add up, for each row, the rate times the curvature of its losses.
    """
    total, exp, ln = 0.0, math.exp, math.log
    steady = isinstance(rates, float)
    for at, (ids, outputs) in enumerate(examples):
        if not outputs.size:
            continue
        lr = rates if steady else rates[at]
        u = rows_in[ids].mean(axis=0, dtype=np.float64)
        order = outputs.ravel().tolist()
        distinct = {o: i for i, o in enumerate(dict.fromkeys(order))}
        rows = np.fromiter(distinct, np.int64, len(distinct))
        w = rows_out[rows].astype(np.float64)
        activation, length = (w @ u).tolist(), float(u @ u)
        moved, curve = [0.0] * len(rows), [0.0] * len(rows)
        along, width = 0.0, outputs.shape[1]
        for k, o in enumerate(order):
            i = distinct[o]
            a = activation[i] + moved[i] * length
            y = 1.0 if a > 10 else 0.0 if a < -10 else 1 / (1 + exp(-a))
            if k % width:
                total -= ln(1 - y + 1e-5)
                g = -y
            else:
                total -= ln(y + 1e-5)
                g = 1 - y
            curve[i] += max(y * (1 - y), LEAST_CURVE * abs(g))
            g *= lr
            along += g * moved[i]  # the old row is w + moved * u
            moved[i] += g
        step = np.array(moved)
        delta = step @ w + along * u
        if curve_out is not None:
            bend = lr * np.array(curve)
            curve_out[rows] += bend * length
            np.add.at(curve_in, ids, float(bend @ np.einsum("ij,ij->i", w, w)))
        rows_out[rows] = w + step[:, None] * u
        if len(ids) > 1:
            np.add.at(rows_in, ids, delta.astype(rows_in.dtype))
        else:
            rows_in[ids[0]] = rows_in[ids[0]] + delta
    return total


_CHANGES = "matrix int, row_id long, delta array<float>, curve double, loss double, positives long, tokens long"
_CHANGE = pa.schema([
    ("matrix", pa.int32()), ("row_id", pa.int64()), ("delta", pa.list_(pa.float32())),
    ("curve", pa.float64()), ("loss", pa.float64()), ("positives", pa.int64()), ("tokens", pa.int64()),
])
_WORDS = 2


def _vectors(array: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1) if len(array) else np.empty((0, 0), np.float32)


def _one_batch(table: pa.Table) -> pa.RecordBatch:
    columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns]
    return pa.RecordBatch.from_arrays(columns, schema=table.schema)


def _train_part(expand: Callable[[pa.RecordBatch], Work], first: float, last: float):
    """One part of a super-step, over its blocks and its parameter rows."""

    def run(blocks: pa.Table, side: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _CHANGE.empty_table()
        work = expand(_one_batch(blocks.sort_by([("sent_id", "ascending"), ("block", "ascending")])))
        side = side.sort_by([("matrix", "ascending"), ("row_id", "ascending")])
        matrix, row_id = side["matrix"].to_numpy(), side["row_id"].to_numpy()
        cut = np.searchsorted(matrix, [OUTPUT, _WORDS])
        spans = {INPUT: slice(0, cut[0]), OUTPUT: slice(cut[0], cut[1])}
        rows = {m: row_id[s] for m, s in spans.items()}
        stack = {m: _vectors(_one_batch(side.slice(s.start, s.stop - s.start).select(["vec"])).column(0)).copy() for m, s in spans.items()}
        ids = _one_batch(side.slice(cut[1]).select(["ids"])).column(0)
        ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        flat = np.searchsorted(rows[INPUT], ids.flatten().to_numpy(zero_copy_only=False))
        word = np.searchsorted(row_id[cut[1] :], work.focus)
        outputs = np.searchsorted(rows[OUTPUT], work.outputs)
        at = np.concatenate([[0], np.cumsum(work.sizes)])
        examples = [(flat[ends[w] : ends[w + 1]], outputs[at[i] : at[i + 1]]) for i, w in enumerate(word.tolist())]
        before = {m: stack[m].copy() for m in stack}
        curves = {m: np.zeros(len(rows[m])) for m in stack}
        rates = np.linspace(first, last, len(examples), endpoint=False)
        loss = sequential_pass(examples, stack[INPUT], stack[OUTPUT], rates, curves[INPUT], curves[OUTPUT])
        tables = []
        for m in (INPUT, OUTPUT):
            delta = stack[m] - before[m]
            moved = np.flatnonzero(delta.any(axis=1))
            for a in range(0, len(moved), 10_000):
                some = moved[a : a + 10_000]
                offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * delta.shape[1])
                none = np.zeros(len(some), np.int64)
                columns = [pa.array(np.full(len(some), m, np.int32)), pa.array(rows[m][some]), pa.ListArray.from_arrays(offsets, pa.array(delta[some].ravel())), pa.array(curves[m][some])]
                tables.append(pa.Table.from_arrays([*columns, pa.array(none.astype(float)), pa.array(none), pa.array(none)], schema=_CHANGE))
        total = [[-1], [-1], [[]], [0.0], [float(loss)], [len(outputs)], [len(examples)]]
        tables.append(pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(total, _CHANGE)], schema=_CHANGE))
        return pa.concat_tables(tables)

    return run


def _touched_batches(expand: Callable[[pa.RecordBatch], Work], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(part, matrix, row_id)`` of the words and output rows that blocks use."""
    for batch in batches:
        part = batch.column(batch.schema.get_field_index("part")).to_numpy(zero_copy_only=False)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for some in np.split(order, cuts):
            if not len(some):
                continue
            work = expand(batch.take(pa.array(some)))
            for m, rows in ((_WORDS, np.unique(work.focus)), (OUTPUT, np.unique(work.outputs))):
                columns = [np.full(len(rows), part[some[0]], np.int64), np.full(len(rows), m, np.int32), rows.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "matrix", "row_id"])


def _share(curve: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The share of the summed deltas that a row takes; see :func:`merge_changes`."""
    return np.divide(-np.expm1(-curve), apart, out=np.ones(len(curve)), where=apart > 0)


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by matrix, row and kind: each parameter row before its deltas."""
    for rows, start in whole_groups(batches, [0, 1]):
        matrix, row_id, curve = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        vec = _vectors(rows.column(4)).astype(np.float64)
        base = vec[start]
        vec[start] = 0
        delta = np.add.reduceat(vec, start)
        factor = _share(np.add.reduceat(curve, start), np.add.reduceat(-np.expm1(-curve), start))
        out = (base + delta * factor[:, None]).astype(np.float32)
        offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
        columns = [pa.array(matrix[start]), pa.array(row_id[start]), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))]
        yield pa.RecordBatch.from_arrays(columns, names=["matrix", "row_id", "vec"])


def merge_changes(params: DataFrame, changes: DataFrame) -> DataFrame:
    """Parameters after the changes of parallel parts.

    Deltas of one row that start from the same value are summed as far as that
    cannot overshoot.  With ``h`` the rate times the curvature a part saw, the
    part has closed at most ``1 - exp(-h)`` of the way to its optimum, and all
    parts one after the other ``1 - exp(-sum h)``; the sum of the deltas is
    scaled by the quotient of the second and the sum of the first.  Rare rows
    keep the whole sum, rows that every part has settled get the average.
    """
    rows = params.select("matrix", "row_id", F.lit(0).alias("kind"), F.lit(0.0).alias("curve"), "vec")
    moves = changes.where("matrix >= 0").select("matrix", "row_id", F.lit(1).alias("kind"), "curve", F.col("delta").alias("vec"))
    both = rows.unionByName(moves).repartition("matrix", "row_id").sortWithinPartitions("matrix", "row_id", "kind")
    return both.mapInArrow(_merge_batches, PARAMS)


def super_step(blocks: DataFrame, params: DataFrame, words: DataFrame, expand: Callable[[pa.RecordBatch], Work], rates: tuple[float, float]) -> tuple[DataFrame, str, StepStats]:
    """Train the parts of ``blocks`` in parallel; returns the parameters as a
    durable table, its path, and the totals.

    ``blocks`` (durable, read twice) has ``part, sent_id, block`` and what
    ``expand`` turns into :class:`Work`; ``words`` has ``idx`` and ``ids``,
    the input rows of each word.  The learning rate falls from the first to
    the second of ``rates`` within each part.
    """
    spark = params.sparkSession
    names = blocks.columns
    shape = "part long, matrix int, row_id long"
    touched, touched_at = written_at(blocks.select(*names).mapInArrow(lambda it: _touched_batches(expand, it), shape).distinct())
    focus = touched.where(F.col("matrix") == _WORDS).join(words.select(F.col("idx").alias("row_id"), "ids"), "row_id")
    inputs = focus.select("part", F.lit(INPUT).alias("matrix"), F.explode("ids").alias("row_id")).distinct()
    rows = inputs.unionByName(touched.where(F.col("matrix") == OUTPUT)).join(params, ["matrix", "row_id"])
    side = rows.select(F.col("part").alias("at"), "matrix", "row_id", "vec", F.lit(None).cast("array<long>").alias("ids")).unionByName(
        focus.select(F.col("part").alias("at"), "matrix", "row_id", F.lit(None).cast("array<float>").alias("vec"), "ids")
    )
    raw = blocks.groupBy("part").cogroup(side.groupBy("at")).applyInArrow(_train_part(expand, *rates), _CHANGES)
    changes, changes_at = written_at(raw)
    total = changes.where("matrix = -1").agg(F.sum("loss"), F.sum("positives"), F.sum("tokens")).first()
    updated, path = written_at(merge_changes(params, changes))
    for old in (touched_at, changes_at):
        remove(spark, old)
    return updated, path, StepStats(total[0] or 0.0, total[1] or 0, total[2] or 0)


_SUMS = "matrix int, row_id long, delta array<float>, curve double, apart double, loss double, positives long, tokens long"
_SUM = pa.schema([
    ("matrix", pa.int32()), ("row_id", pa.int64()), ("delta", pa.list_(pa.float32())),
    ("curve", pa.float64()), ("apart", pa.float64()), ("loss", pa.float64()), ("positives", pa.int64()), ("tokens", pa.int64()),
])


def _sum_table(matrix: np.ndarray, row_id: np.ndarray, delta: np.ndarray, *others: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(delta) + 1, dtype=np.int32) * delta.shape[1])
    columns = [pa.array(matrix.astype(np.int32)), pa.array(row_id), pa.ListArray.from_arrays(offsets, pa.array(delta.ravel().astype(np.float32)))]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(o) for o in others]], schema=_SUM)


def _add_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each row, of rows sorted by matrix and row."""
    for rows, start in whole_groups(batches, [0, 1]):
        column = [rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4, 5, 6, 7)]
        yield _sum_table(column[0][start], column[1][start], np.add.reduceat(_vectors(rows.column(2)), start, dtype=np.float64), *[np.add.reduceat(c, start) for c in column[2:]])


@dataclass
class Held:
    """All parameters, with the driver: rows in the order of their ids, and the input rows of each word."""

    row_id: dict[int, np.ndarray]
    vec: dict[int, np.ndarray]
    word: np.ndarray
    n_ids: np.ndarray
    ids: np.ndarray  #: places of the words' input rows, one word after the other

    @classmethod
    def of(cls, params: DataFrame, words: DataFrame) -> Held | None:
        """None if the vectors or the words' ids take more than ``HELD_BYTES``."""
        numbers = params.agg(F.sum(F.size("vec")), F.count(F.lit(1))).first(), words.agg(F.sum(F.size("ids")), F.count(F.lit(1))).first()
        if max(4 * (numbers[0][0] or 0) + 8 * numbers[0][1], 8 * ((numbers[1][0] or 0) + 2 * numbers[1][1])) > HELD_BYTES:
            return None
        rows, known = params.toArrow().sort_by([("matrix", "ascending"), ("row_id", "ascending")]), words.select("idx", "ids").toArrow().sort_by("idx")
        matrix, row_id, vec = rows["matrix"].to_numpy(), rows["row_id"].to_numpy(), _vectors(rows["vec"].combine_chunks())
        of = {m: matrix == m for m in (INPUT, OUTPUT)}
        ids = known["ids"].combine_chunks()
        ordered = {m: row_id[of[m]] for m in of}
        places = np.searchsorted(ordered[INPUT], ids.flatten().to_numpy(zero_copy_only=False))
        return cls(ordered, {m: vec[of[m]] for m in of}, known["idx"].to_numpy(), ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), places)

    @property
    def bytes(self) -> int:
        return sum(v.nbytes + 8 * len(v) for v in self.vec.values())

    def add(self, sums: pa.Table) -> StepStats:
        """Merge the changes of all parts."""
        for batch in sums.to_batches():
            matrix, row_id, curve, apart = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            delta = _vectors(batch.column(2)) * _share(curve, apart)[:, None]
            for m in (INPUT, OUTPUT):
                of = matrix == m
                at = np.searchsorted(self.row_id[m], row_id[of])
                self.vec[m][at] = self.vec[m][at].astype(np.float64) + delta[of]
        return StepStats(*(pc.sum(sums[c]).as_py() or 0 for c in ("loss", "positives", "tokens")))

    def table(self, spark: SparkSession) -> DataFrame:
        parts = []
        for m in (INPUT, OUTPUT):
            offsets = pa.array(np.arange(len(self.vec[m]) + 1, dtype=np.int32) * self.vec[m].shape[1])
            columns = [pa.array(np.full(len(self.vec[m]), m, np.int32)), pa.array(self.row_id[m]), pa.ListArray.from_arrays(offsets, pa.array(self.vec[m].ravel()))]
            parts.append(pa.Table.from_arrays(columns, names=["matrix", "row_id", "vec"]))
        return spark.createDataFrame(pa.concat_tables(parts), PARAMS)


class _Group:
    """Parts that a task trains side by side, each on its own copy of the rows it touches."""

    def __init__(self, held: Held):
        self.held, self.parts, self.touched = held, [], []
        self.size, self.end = 0, {INPUT: 0, OUTPUT: 0}
        self.totals = [0.0, 0, 0]
        self.ends = np.cumsum(held.n_ids)
        self.known = {OUTPUT: self._dense(held.row_id[OUTPUT]), _WORDS: self._dense(held.word)}
        self.delta = {m: np.zeros(v.shape) for m, v in held.vec.items()}
        self.curve = {m: np.zeros((2, len(v))) for m, v in held.vec.items()}

    @staticmethod
    def _dense(ids: np.ndarray) -> np.ndarray | None:
        return None if len(ids) and ids[0] == 0 and ids[-1] == len(ids) - 1 else ids

    def _place(self, m: int, ids: np.ndarray) -> np.ndarray:
        return ids if self.known[m] is None else np.searchsorted(self.known[m], ids)

    def _own(self, m: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that a part touches, and the places of ``at`` in the copies of all parts."""
        used = np.zeros(len(self.held.vec[m]), bool)
        used[at] = True
        rows = np.flatnonzero(used)
        copy = np.empty(len(used), np.int64)
        copy[rows] = self.end[m] + np.arange(len(rows))
        self.end[m] += len(rows)
        return rows, copy[at]

    def take(self, work: Work, rates: tuple[float, float]) -> None:
        word = self._place(_WORDS, work.focus)
        n_ids = self.held.n_ids[word]
        inn, ids = self._own(INPUT, self.held.ids[runs(self.ends[word] - n_ids, n_ids)])
        out, outputs = self._own(OUTPUT, self._place(OUTPUT, work.outputs))
        self.parts.append(Part(ids, n_ids, outputs, work.sizes, np.linspace(*rates, len(word), endpoint=False)))
        self.touched.append({INPUT: inn, OUTPUT: out})
        self.totals[1] += len(outputs)
        self.totals[2] += len(word)
        self.size += 8 * (outputs.size + ids.size) + (len(inn) + len(out)) * (8 + 8 * self.held.vec[INPUT].shape[1])
        if len(self.parts) >= GROUP_PARTS or self.size >= GROUP_BYTES:
            self.train()

    def train(self) -> None:
        if not self.parts:
            return
        stack = {m: np.concatenate([self.held.vec[m][t[m]] for t in self.touched]) for m in (INPUT, OUTPUT)}
        curves = {m: np.zeros(len(stack[m])) for m in stack}
        if len(self.parts) == 1:
            loss = sequential_pass(self.parts[0].examples(), stack[INPUT], stack[OUTPUT], self.parts[0].rates, curves[INPUT], curves[OUTPUT])
        else:
            loss = lockstep_pass(self.parts, stack[INPUT], stack[OUTPUT], curves[INPUT], curves[OUTPUT])
        self.totals[0] += loss
        for m in stack:
            begin = 0
            for t in self.touched:
                own = slice(begin, begin + len(t[m]))
                delta = stack[m][own] - self.held.vec[m][t[m]]
                moved = delta.any(axis=1)
                rows, curve = t[m][moved], curves[m][own][moved]
                self.delta[m][rows] += delta[moved]
                self.curve[m][:, rows] += np.stack([curve, -np.expm1(-curve)])
                begin = own.stop
        self.parts, self.touched, self.size, self.end = [], [], 0, {INPUT: 0, OUTPUT: 0}

    def sums(self) -> Iterator[pa.RecordBatch]:
        for m, delta in self.delta.items():
            moved = np.flatnonzero(delta.any(axis=1) | self.curve[m].any(axis=0))
            for a in range(0, len(moved), 10_000):
                some = moved[a : a + 10_000]
                none = np.zeros(len(some), np.int64)
                yield _sum_table(np.full(len(some), m), self.held.row_id[m][some], delta[some], *self.curve[m][:, some], none.astype(float), none, none)
        if self.totals[2]:
            one = np.full(1, -1)
            yield _sum_table(one, one, np.zeros((1, self.delta[INPUT].shape[1])), np.zeros(1), np.zeros(1), *[np.array([x]) for x in self.totals])


def held_step(blocks: DataFrame, held: Held, expand: Callable[[pa.RecordBatch], Work], rates: tuple[float, float], parts: int) -> StepStats:
    """As :func:`super_step`, in one job over ``parts`` parts; changes ``held``.

    A task trains the parts it has side by side and sums their changes, so a
    row leaves a task once, whatever the number of parts.
    """
    context = blocks.sparkSession.sparkContext
    shared = context.broadcast(held)  # at most HELD_BYTES of vectors and as many of ids
    tasks = min(parts, context.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group(shared.value)
        for rows, start in whole_groups(batches, [0]):
            for a, b in zip(start, [*start[1:], rows.num_rows]):
                group.take(expand(rows.slice(a, b - a)), rates)
        group.train()
        yield from group.sums()

    rows = blocks.select("part", *[c for c in blocks.columns if c != "part"])
    dealt = rows.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part", "sent_id", "block")
    sums = dealt.mapInArrow(run, _SUMS)
    if tasks > 1:
        sums = sums.repartition("matrix", "row_id").sortWithinPartitions("matrix", "row_id").mapInArrow(_add_batches, _SUMS)
    stats = held.add(sums.toArrow())
    shared.destroy()
    return stats


class Trainer(Protocol):
    """What a model gives to :func:`train`."""

    words: DataFrame  #: ``idx, ids``: the input rows of every word
    kept: float  #: focus tokens that one pass is expected to keep

    def blocks(self, layout: Layout) -> DataFrame:
        """The blocks of one pass, with ``step`` and ``part``."""

    def expand(self, epoch: int) -> Callable[[pa.RecordBatch], Work]:
        """How blocks become work."""


@dataclass(frozen=True)
class Trained:
    """``params`` has ``matrix, row_id, vec``; ``losses`` one mean loss a super-step."""

    params: DataFrame
    losses: list[float]
    tokens: int
    positives: int = 0
    steps: list[tuple[int, int]] = field(default_factory=list)  #: (tokens, parts) of each


def plan_layout(epoch: int, done: int, kept: float, goal: int, part_tokens: int | None = None, growth: float | None = None, max_parts: int | None = None) -> Layout:
    """The steps of a pass that starts after ``done`` tokens on the way to ``goal``."""
    part_tokens, growth, max_parts = part_tokens or PART_TOKENS, growth or GROWTH, max_parts or MAX_PARTS
    missing = goal - done
    # a little more than what is missing, since the kept tokens are random
    needed = min(kept, missing + 3 * math.sqrt(512 * missing) + 512)
    bounds, parts, at = [], [], 0.0
    while at < needed:
        size = min(max(part_tokens, growth * (done + at)), max_parts * part_tokens)
        if needed - at - size < part_tokens / 2:
            size = needed - at
        parts.append(max(1, round(size / part_tokens)))
        at += size
        bounds.append(at)
    if needed >= kept and bounds:
        bounds[-1] = math.inf
    return Layout(epoch, kept, tuple(bounds), tuple(parts))


def train(trainer: Trainer, params: DataFrame, n_tokens: int, config: CommonConfig, max_passes: int | None = None) -> Trained:
    """Passes until the kept focus tokens reach ``epochs * n_tokens``.

    Each pass is written once, by step; each step starts from the parameters
    of the one before and its tables are removed when the next is durable.
    Since subsampling drops tokens, more passes than ``epochs`` may be needed;
    ``max_passes`` bounds them.  A pass without any token is an error.
    """
    spark = params.sparkSession
    shared_dir(spark)
    goal, began = config.epochs * n_tokens, time.time()
    params, path = written_at(params)
    held = Held.of(params, trainer.words)
    losses, steps, processed, positives, epoch, left_over = [], [], 0, 0, 0, 0
    while processed < goal and (max_passes is None or epoch < max_passes):
        layout, before = plan_layout(epoch, processed, max(trainer.kept, 1.0), goal), processed
        laid = trainer.blocks(layout).repartition("step", "part")
        blocks, blocks_at = written_at(laid, ["step"])
        for i, parts in enumerate(layout.parts):
            share = (layout.bounds[i] if math.isfinite(layout.bounds[i]) else layout.length) - (layout.bounds[i - 1] if i else 0)
            rates = tuple(learning_rate(p, config.epochs, n_tokens, config.lr) for p in (processed, processed + share))
            now = blocks.where(F.col("step") == i).drop("step")
            if held:
                stats = held_step(now, held, trainer.expand(epoch), rates, parts)
                left_over += held.bytes * min(parts, spark.sparkContext.defaultParallelism)
                if left_over > LEFT_BYTES:  # shuffle files stay until the driver's JVM collects the plans
                    gc.collect()
                    spark.sparkContext._jvm.System.gc()
                    left_over = 0
            else:
                updated, new, stats = super_step(now, params, trainer.words, trainer.expand(epoch), rates)
                remove(spark, path)
                params, path = updated, new
            processed, positives = processed + stats.tokens, positives + stats.positives
            losses.append(stats.loss / max(stats.positives, 1))
            steps.append((stats.tokens, parts))
            left = (time.time() - began) * max(goal - processed, 0) / max(processed, 1)
            log.info("trained %d of %d tokens, rate %.5f, loss %.4f, about %.0f s left", processed, goal, rates[1], losses[-1], left)
            if processed >= goal:
                break
        remove(spark, blocks_at)
        if processed == before:
            raise ValueError("the corpus provides no sentences to train on")
        epoch += 1
    if held and processed:
        params, new = written_at(held.table(spark))
        remove(spark, path)
    return Trained(params, losses, processed, positives, steps)


def final_vectors(vocab: DataFrame, params: DataFrame) -> DataFrame:
    """``(idx, label, mean, vec, norm)``: the mean of a word's input rows, its
    unit vector and its norm; a mean without length becomes NaN."""
    from wordloom.functions.vectors import l2_norm, l2_normalize
    from wordloom.operators.subwords import input_ids

    rows = params.where(F.col("matrix") == INPUT).select("row_id", "vec")
    spread = vocab.select("idx", "label", F.explode(input_ids(vocab)).alias("row_id"))
    mean = mean_vectors(spread.join(rows, "row_id"), ["idx", "label"])
    return mean.select("idx", "label", "mean", l2_normalize(F.col("mean")).alias("vec"), l2_norm(F.col("mean")).alias("norm"))


def mean_vectors(rows: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """``keys`` and ``mean``, the component-wise mean of the group's vectors."""
    each = rows.select(*keys, F.posexplode(vec).alias("_dim", "_v"))
    part = each.groupBy(*keys, "_dim").agg(F.avg(F.col("_v").cast("double")).alias("_v"))
    return part.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_dim", "_v")))["_v"].alias("mean"))
