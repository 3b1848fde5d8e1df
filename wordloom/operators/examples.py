"""Training examples of whole models, laid out by step and part of a pass.

A pass over the corpus is written once, as blocks of a bounded number of focus
tokens: window models keep the subsampled tokens with a margin of the window
on both sides, dependency models the ranked contexts.  Windows and negatives
are drawn from hashed keys where a block is read, so neither is ever stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.config import DepembedsConfig, SkipGramConfig
from wordloom.operators.deps import training_pairs
from wordloom.operators.pairs import output_index, windows
from wordloom.operators.sampling import hashed_uniform, negative_draws

#: Focus tokens of one block: no longer sentence is trained in one piece.
BLOCK = 512
# Streams of the hashed draws; 0 and 1 belong to the negatives.
_KEEP, _WIDTH, _STEP, _PART = 2, 3, 4, 5


@dataclass(frozen=True)
class Work:
    """Focus tokens in order of training: their words, their numbers of
    outputs, and a row per output of the positive and its negatives."""

    focus: np.ndarray
    sizes: np.ndarray
    outputs: np.ndarray


@dataclass(frozen=True)
class Layout:
    """The steps of one pass and the parts of each step.

    A block's place in the pass is hashed, as a share of the pass's ``length``
    expected focus tokens; ``bounds`` has the ends of the steps in focus
    tokens from the start of the pass (what lies beyond the last one is not
    needed) and ``parts`` the number of parts of each.
    """

    epoch: int
    length: float
    bounds: tuple[float, ...]
    parts: tuple[int, ...]

    def place(self, sent_id: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(step, part)`` of each block; the step after the last if not needed."""
        at = hashed_uniform(_STEP, self.epoch, sent_id, block) * self.length
        step = np.searchsorted(np.array(self.bounds), at, "right")
        ways = np.array([*self.parts, 1])[step]
        return step, np.floor(hashed_uniform(_PART, self.epoch, sent_id, block) * ways).astype(np.int64)


def _flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and concatenated values of a list column."""
    sizes = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, array.flatten().to_numpy(zero_copy_only=False)


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of the runs of ``sizes``."""
    return np.arange(int(sizes.sum())) - np.repeat(_begins(sizes), sizes)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _window_batches(margin: int, layout: Layout, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sent_ids = batch.column(0).to_numpy(zero_copy_only=False)
        known = batch.column(1)
        sizes = known.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        pos, idx, keep = (f.to_numpy(zero_copy_only=False) for f in known.flatten().flatten())
        row = np.repeat(np.arange(len(sizes)), sizes)
        lucky = hashed_uniform(_KEEP, layout.epoch, sent_ids[row], pos) < keep
        pos, idx, row = pos[lucky], idx[lucky], row[lucky]
        sizes = np.bincount(row, minlength=len(sizes))
        blocks = -(-sizes // BLOCK)
        of, number = np.repeat(np.arange(len(sizes)), blocks), _within(blocks)
        step, part = layout.place(sent_ids[of], number)
        needed = step < len(layout.parts)
        of, number, step, part = of[needed], number[needed], step[needed], part[needed]
        begin, end = _begins(sizes)[of], np.cumsum(sizes)[of]
        first, last = begin + number * BLOCK, np.minimum(begin + (number + 1) * BLOCK, end)
        low, high = np.maximum(first - margin, begin), np.minimum(last + margin, end)
        take = np.repeat(low, high - low) + _within(high - low)
        columns = [step.astype(np.int32), part, sent_ids[of], number, first - low, last - first]
        arrays = [pa.array(c) for c in columns] + [_lists(pos[take], high - low), _lists(idx[take], high - low)]
        yield pa.RecordBatch.from_arrays(arrays, names=["step", "part", "sent_id", "block", "lead", "n", "pos", "idx"])


def window_blocks(known: DataFrame, config: SkipGramConfig, layout: Layout) -> DataFrame:
    """The blocks of one pass of a window model over ``(sent_id, known)``."""
    shape = "step int, part long, sent_id long, block long, lead long, n long, pos array<int>, idx array<long>"
    return known.mapInArrow(lambda it: _window_batches(config.context_size, layout, it), shape)


def _with_negatives(positive: np.ndarray, sizes: np.ndarray, sent: np.ndarray, pos: np.ndarray, epoch: int, ns: int, n: int, band: int, exponent: float) -> np.ndarray:
    """A row of the positive and ``ns`` negatives for each output of each focus."""
    out = np.empty((len(positive), 1 + ns), np.int64)
    out[:, 0] = positive
    if ns and len(positive):
        each = np.repeat(np.repeat(np.arange(len(sizes)), sizes), ns)
        drawn = negative_draws(np.repeat(positive, ns), [epoch, sent[each], pos[each], _within(sizes * ns)], n, exponent, band)
        out[:, 1:] = drawn.reshape(-1, ns)
    return out


def expand_windows(config: SkipGramConfig, n_words: int, ns: int, exponent: float, epoch: int) -> Callable[[pa.RecordBatch], Work]:
    """How blocks of :func:`window_blocks` become :class:`Work`."""
    context, model = config.context_size, config.model

    def expand(batch: pa.RecordBatch) -> Work:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        held, pos = _flat(column["pos"])
        _, idx = _flat(column["idx"])
        sent, lead, n = (column[c].to_numpy(zero_copy_only=False) for c in ("sent_id", "lead", "n"))
        begin = _begins(held)
        at = np.repeat(begin + lead, n) + _within(n)
        row = np.repeat(np.arange(len(n)), n)
        width = 1 + np.floor(hashed_uniform(_WIDTH, epoch, sent[row], pos[at]) * context).astype(np.int64)
        sizes, which, other = windows(begin[row], (begin + held)[row], at, width)
        positive = output_index(model, idx[other], other - at[which], context)
        return Work(idx[at], sizes, _with_negatives(positive, sizes, sent[row], pos[at], epoch, ns, n_words, model.band(context), exponent))

    return expand


def _dependency_batches(layout: Layout, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sent, pos = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        step, part = layout.place(sent, pos // BLOCK)
        needed = pa.array(np.flatnonzero(step < len(layout.parts)))
        placed = pa.RecordBatch.from_arrays([pa.array(step.astype(np.int32)), pa.array(part), *batch.columns[:1], pa.array(pos), *batch.columns[2:]], names=["step", "part", "sent_id", "block", "focus_idx", "outputs"])
        yield placed.take(needed)


def dependency_blocks(trees: DataFrame, config: DepembedsConfig, vocab: DataFrame, context_vocab: DataFrame, layout: Layout) -> DataFrame:
    """The focus tokens of one pass of the dependency model; outputs are ranked contexts."""
    rows = training_pairs(trees, config, vocab, context_vocab, layout.epoch)
    shape = "step int, part long, sent_id long, block long, focus_idx long, outputs array<long>"
    return rows.mapInArrow(lambda it: _dependency_batches(layout, it), shape)


def expand_contexts(n_contexts: int, ns: int, exponent: float, epoch: int) -> Callable[[pa.RecordBatch], Work]:
    """How rows of :func:`dependency_blocks` become :class:`Work`."""

    def expand(batch: pa.RecordBatch) -> Work:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        sizes, positive = _flat(column["outputs"])
        sent, pos, focus = (column[c].to_numpy(zero_copy_only=False) for c in ("sent_id", "block", "focus_idx"))
        return Work(focus, sizes, _with_negatives(positive.astype(np.int64), sizes, sent, pos, epoch, ns, n_contexts, 1, exponent))

    return expand
