"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 7).

Merges run on a hierarchical-bitmap rank queue: one bucket per merge rank
holds the linked-list positions whose pair has that rank, three levels of
64-bit words mark the buckets in use, and find-first-set walks them to the
least rank.  A merge is O(1) bitmap work, so a very long pre-token costs
O(n log n) instead of O(n^2).
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabulary files lie; a parameter of every function here.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pre-token pattern the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens remembered per task, and the longest one remembered.
CACHE_ENTRIES, CACHE_LENGTH = 200_000, 64


@functools.cache
def load_ranks(name: str, directory: str) -> dict[bytes, int]:
    """Token bytes -> id of ``<directory>/<name>.tiktoken``."""
    lines = Path(directory, f"{name}.tiktoken").read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


class RankQueue:
    """Positions by rank, least rank first and leftmost first within a rank."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low = [0] * words
        self.mid = [0] * ((words >> 6) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, int]:
        i = (self.top & -self.top).bit_length() - 1
        m = self.mid[i]
        word = (i << 6) + (m & -m).bit_length() - 1
        bits = self.low[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            bits &= bits - 1
            self.low[word] = bits
            if not bits:
                self.mid[word >> 6] &= ~(1 << (word & 63))
                if not self.mid[word >> 6]:
                    self.top &= ~(1 << (word >> 6))
        return rank, position


class Encoder(dict):
    """Pre-token string -> ids, as a bounded cache over the merge loop."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values()))

    def __missing__(self, piece: str) -> list[int]:
        ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, queue = self.ranks, self.queue
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        end = list(range(1, n + 1))  # where the part that starts here ends; also the next part
        before = list(range(-1, n - 1))
        pair = [-1] * n  # rank of the pair that starts here, -1 for none or merged away
        for i in range(n - 1):
            rank = ranks.get(data[i : i + 2])
            if rank is not None:
                pair[i] = rank
                queue.push(rank, i)
        while queue.top:
            rank, i = queue.pop()
            if pair[i] != rank:  # stale
                continue
            gone = end[i]
            end[i] = end[gone]
            pair[gone] = -1
            pair[i] = -1
            if end[i] < n:
                before[end[i]] = i
                again = ranks.get(data[i : end[end[i]]])
                if again is not None:
                    pair[i] = again
                    queue.push(again, i)
            left = before[i]
            if left >= 0:
                again = ranks.get(data[left : end[i]])
                pair[left] = -1 if again is None else again
                if again is not None:
                    queue.push(again, left)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : end[i]]])
            i = end[i]
        return ids


@functools.cache
def _pattern():
    import regex

    return regex.compile(PATTERN)


def _encode_batches(ranks: dict[bytes, int], lengths_only: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, split = Encoder(ranks), _pattern().findall
    ids_of = encoder.__getitem__
    for batch in batches:
        # texts that are repeated in a batch are encoded once
        texts = batch.column(batch.num_columns - 1).dictionary_encode()
        place = texts.indices.fill_null(len(texts.dictionary)).to_numpy(zero_copy_only=False)
        parts = [np.fromiter(chain.from_iterable(map(ids_of, split(text))), np.int32) if text else np.empty(0, np.int32) for text in texts.dictionary.to_pylist()]
        parts.append(np.empty(0, np.int32))
        lengths = np.array([len(p) for p in parts], np.int64)[place]
        kept = batch.columns[:-1]
        names = batch.schema.names[:-1]
        if lengths_only:
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lengths)], names=[*names, "n_tokens"])
        else:
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            values = pa.array(np.concatenate([parts[i] for i in place]) if len(place) else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*names, "ids"])


def _mapped(df: DataFrame, keep: list[str], text: str, name: str, directory: str, lengths_only: bool) -> DataFrame:
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(name, directory))  # under 2 MB whatever the corpus
    slim = df.select(*keep, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    out = "n_tokens long" if lengths_only else "ids array<int>"
    return slim.mapInArrow(lambda it: _encode_batches(shared.value, lengths_only, it), f"{fields}, {out}" if fields else out)


def encode(df: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """The columns ``keep`` and ``ids``, the token ids of each text.

    No special tokens are added and strings that look like them are plain
    text.  A null text and an empty text have an empty list.  Every row comes
    out once, repeated rows included; whole texts are encoded whatever their
    length.
    """
    return _mapped(df, keep, text, name, directory, False)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the length :func:`encode` would give."""
    return _mapped(df, keep, text, name, directory, True)
