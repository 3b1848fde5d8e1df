"""Sentences, subsampling and focus-output pairs of the window models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.config import ModelType
from wordloom.functions.rand import uniform

#: Words and bytes of labels up to which a vocabulary is sent to every executor.
LOOKUP_WORDS, LOOKUP_BYTES = 1_000_000, 64 << 20
#: Pairs of one output batch.
BATCH_PAIRS = 500_000
_KNOWN = "sent_id long, known array<struct<pos:int,idx:long,keep:double>>"


def explode_tokens(sentences: DataFrame) -> DataFrame:
    """``(sent_id, pos, token)`` from ``(sent_id, tokens)``, positions from 0."""
    return sentences.select("sent_id", F.posexplode("tokens").alias("pos", "token"))


def kept_tokens(tokens: DataFrame, vocab: DataFrame, epoch: int = 0) -> DataFrame:
    """In-vocabulary tokens that survive subsampling: ``(sent_id, pos, idx)``.

    An equi-join on the token: a vocabulary under the engine's broadcast
    threshold is broadcast, a larger one is shuffled, and a token that holds a
    large part of the corpus is split by adaptive skew handling.
    """
    known = tokens.join(vocab.select(F.col("label").alias("token"), "idx", "keep_prob"), "token")
    return known.where(uniform("s", epoch, F.col("sent_id"), F.col("pos")) < F.col("keep_prob")).select("sent_id", "pos", "idx")


class Lookup:
    """Positions of strings in a list, by a hash table that a task builds once.

    Only the distinct strings of a batch are looked up, so a batch costs
    nothing in proportion to the list.
    """

    def __init__(self, labels: pa.Array):
        self.at = dict(zip(labels.to_pylist(), range(len(labels))))

    def __call__(self, strings: pa.Array) -> np.ndarray:
        """The position of each string, -1 for one that is not in the list."""
        coded = strings.dictionary_encode()
        get = self.at.get
        place = np.array([get(s, -1) for s in coded.dictionary.to_pylist()] + [get(None, -1)], np.int64)
        return place[coded.indices.fill_null(len(place) - 1).to_numpy(zero_copy_only=False)]


def _lookup_batches(labels: pa.Array, idx: np.ndarray, keep: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = Lookup(labels)
    for batch in batches:
        tokens = batch.column(1)
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = find(tokens.flatten())
        hit = place >= 0
        place, counts = place[hit], np.bincount(row[hit], minlength=len(sizes))
        known = pa.StructArray.from_arrays(
            [pa.array(pos[hit].astype(np.int32)), pa.array(idx[place]), pa.array(keep[place])], names=["pos", "idx", "keep"]
        )
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, known)], names=["sent_id", "known"])


def known_tokens(sentences: DataFrame, vocab: DataFrame, lookup_words: int = LOOKUP_WORDS) -> DataFrame:
    """``(sent_id, known)``: the in-vocabulary tokens of each sentence in
    order, as an array of ``(pos, idx, keep)``.

    A vocabulary of at most ``lookup_words`` words and ``LOOKUP_BYTES`` of
    labels is sent to the executors and looked up inside the sentence, without
    a shuffle; a larger one is joined on the token.  Both give the same rows,
    but sentences without any known token may be missing.
    """
    spark = sentences.sparkSession
    size = vocab.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("label")), F.lit(0))).first()
    if size[0] <= lookup_words and size[1] <= LOOKUP_BYTES:
        rows = vocab.select("label", "idx", F.col("keep_prob").cast("double").alias("keep")).toArrow()
        columns = rows["label"].combine_chunks(), rows["idx"].to_numpy(), rows["keep"].to_numpy()
        shared = spark.sparkContext.broadcast(columns)  # size checked above
        return sentences.select("sent_id", "tokens").mapInArrow(lambda it: _lookup_batches(*shared.value, it), _KNOWN)
    tokens = explode_tokens(sentences).join(vocab.select(F.col("label").alias("token"), "idx", F.col("keep_prob").cast("double").alias("keep")), "token")
    return tokens.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("pos", "idx", "keep"))).alias("known"))


def kept_sentences(known: DataFrame, epoch: int = 0) -> DataFrame:
    """``(sent_id, kept)``: the tokens that survive subsampling, of
    :func:`known_tokens`, as an array of ``(pos, idx)`` in order."""
    lucky = F.filter("known", lambda t: uniform("s", epoch, F.col("sent_id"), t["pos"]) < t["keep"])
    return known.select("sent_id", F.transform(lucky, lambda t: F.struct(t["pos"].alias("pos"), t["idx"].alias("idx"))).alias("kept"))


def window_size(sent_id: Column, pos: Column, context: int, epoch: int = 0) -> Column:
    """The width of a focus token's window, uniform in 1..context."""
    return (F.lit(1) + F.floor(uniform("w", epoch, sent_id, pos) * F.lit(context))).cast("int")


def output_index(model: ModelType, token: np.ndarray, offset: np.ndarray, context: int) -> np.ndarray:
    """The output row of ``token`` at distance ``offset`` (not 0) from its focus."""
    if model == ModelType.STRUCTGRAM:
        return token * (2 * context) + offset + context - (offset > 0)
    if model == ModelType.DIRGRAM:
        return token * 2 + (offset > 0)
    return token


def windows(begin: np.ndarray, end: np.ndarray, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sizes, which, other)``: for each focus at ``at`` in its sentence
    ``[begin, end)`` the number of other positions within ``width``, and for
    each such pair the focus's number and the other position."""
    low, high = np.maximum(at - width, begin), np.minimum(at + width + 1, end)
    sizes = high - low - 1
    which = np.repeat(np.arange(len(at)), sizes)
    other = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]
    return sizes, which, other + (other >= at[which])


def _pair_batches(model: ModelType, context: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.column(1)
        sizes = kept.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        pos, idx, width = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in kept.flatten().flatten())
        row = np.repeat(np.arange(len(sizes)), sizes)
        end = np.cumsum(sizes)
        begin, end, sent = (end - sizes)[row], end[row], batch.column(0).to_numpy(zero_copy_only=False)[row]
        step = max(1, BATCH_PAIRS // (2 * context))
        for a in range(0, len(row), step):
            at = np.arange(a, min(a + step, len(row)))
            _, which, other = windows(begin[at], end[at], at, width[at])
            focus = at[which]
            out = output_index(model, idx[other], other - focus, context)
            columns = sent[focus], pos[focus].astype(np.int32), idx[focus], out
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sent_id", "pos", "focus_idx", "output_idx"])


def window_pairs(sentences: DataFrame, model: ModelType, context: int, epoch: int = 0) -> DataFrame:
    """``(sent_id, pos, focus_idx, output_idx)``, one row per pair.

    The window runs over the kept tokens only, its width is drawn for each
    focus token by the token's original position.  No shuffle, and work in
    proportion to the pairs: they are built from the flattened positions of a
    batch of sentences.
    """
    drawn = F.transform("kept", lambda t: F.struct(t["pos"].alias("pos"), t["idx"].alias("idx"), window_size(F.col("sent_id"), t["pos"], context, epoch).alias("width")))
    wide = sentences.select("sent_id", drawn.alias("kept"))
    return wide.mapInArrow(lambda it: _pair_batches(model, context, it), "sent_id long, pos int, focus_idx long, output_idx long")
