"""Typed configuration of vocabularies, models and training."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field
from enum import Enum


class _Named(Enum):
    @classmethod
    def parse(cls, value):
        """Member by name or number; anything else is an error."""
        for member in cls:
            if value == member or value == member.value or value == member.number:
                return member
        raise ValueError(f"unknown {cls.__name__}: {value!r}")

    @property
    def number(self) -> int:
        return list(type(self)).index(self)


class ModelType(_Named):
    SKIPGRAM = "skipgram"
    STRUCTGRAM = "structgram"
    DIRGRAM = "dirgram"

    def band(self, context: int) -> int:
        """Output rows of one word: one, one per window offset, or one per side."""
        return {ModelType.SKIPGRAM: 1, ModelType.STRUCTGRAM: 2 * context, ModelType.DIRGRAM: 2}[self]


class LossType(_Named):
    LOGISTIC_NEGATIVE_SAMPLING = "logistic_negative_sampling"


class BucketIndexerType(_Named):
    """Hash of character n-grams: code points by 64-bit FNV-1a, or UTF-8 bytes by the 32-bit variant."""

    NATIVE = "native"
    FASTTEXT = "fasttext"


class EmbeddingFormat(_Named):
    FASTTEXT = "fasttext"
    NATIVE = "native"
    WORD2VEC = "word2vec"
    TEXT = "text"
    TEXTDIMS = "textdims"


class SubwordKind(_Named):
    BUCKETS = "buckets"
    NGRAMS = "ngrams"
    NONE = "none"


@dataclass(frozen=True)
class Cutoff:
    """``MinCount(n)`` keeps items seen at least ``n`` times; ``TargetSize(n)``
    keeps at most ``n`` items and drops all items of the count that would not fit."""

    type: str = "MinCount"
    value: int = 5

    def __post_init__(self):
        if self.type not in ("MinCount", "TargetSize") or self.value < 0:
            raise ValueError(f"no such cutoff: {self.type} {self.value}")

    @classmethod
    def of(cls, mincount: int | None = None, target_size: int | None = None) -> Cutoff:
        """From the two exclusive options; neither gives the default."""
        if mincount is not None and target_size is not None:
            raise ValueError("mincount and target size exclude each other")
        if target_size is not None:
            return cls("TargetSize", target_size)
        return cls("MinCount", 5 if mincount is None else mincount)


@dataclass(frozen=True)
class SimpleVocabConfig:
    cutoff: Cutoff = Cutoff()
    discard_threshold: float = 1e-4


@dataclass(frozen=True)
class BucketConfig:
    buckets_exp: int = 21
    indexer_type: BucketIndexerType = BucketIndexerType.NATIVE


@dataclass(frozen=True)
class NGramConfig:
    cutoff: Cutoff = Cutoff()


@dataclass(frozen=True)
class SubwordVocabConfig:
    """``min_n`` and ``max_n`` are both inclusive."""

    cutoff: Cutoff = Cutoff()
    discard_threshold: float = 1e-4
    min_n: int = 3
    max_n: int = 6
    indexer: BucketConfig | NGramConfig = BucketConfig()

    def __post_init__(self):
        if not 1 <= self.min_n <= self.max_n:
            raise ValueError("n-gram lengths need 1 <= min_n <= max_n")


@dataclass(frozen=True)
class CommonConfig:
    loss: LossType = LossType.LOGISTIC_NEGATIVE_SAMPLING
    dims: int = 300
    epochs: int = 15
    format: EmbeddingFormat = EmbeddingFormat.NATIVE
    negative_samples: int = 5
    lr: float = 0.05
    zipf_exponent: float = 0.5


@dataclass(frozen=True)
class SkipGramConfig:
    model: ModelType = ModelType.SKIPGRAM
    context_size: int = 10


@dataclass(frozen=True)
class DepembedsConfig:
    """``depth`` 0 means unlimited."""

    depth: int = 1
    use_root: bool = False
    normalize: bool = False
    projectivize: bool = False
    untyped: bool = False
    context_cutoff: Cutoff = Cutoff()
    context_discard: float = 1e-4


VocabConfig = SimpleVocabConfig | SubwordVocabConfig


def check_format(common: CommonConfig, vocab: VocabConfig) -> None:
    """The fastText format can only hold hashed buckets of its own indexer."""
    fits = (
        isinstance(vocab, SubwordVocabConfig)
        and isinstance(vocab.indexer, BucketConfig)
        and vocab.indexer.indexer_type == BucketIndexerType.FASTTEXT
    )
    if common.format == EmbeddingFormat.FASTTEXT and not fits:
        raise ValueError("the fasttext format needs subwords=buckets and hash-indexer=fasttext")


@dataclass(frozen=True)
class RunConfig:
    """Everything one training run needs; see ``wordloom.cli`` for the options."""

    corpus: str
    output: str
    common: CommonConfig = CommonConfig()
    vocab: VocabConfig = SubwordVocabConfig()
    model: SkipGramConfig | DepembedsConfig = SkipGramConfig()
    partitions: int = field(default_factory=lambda: min((os.cpu_count() or 2) // 2, 20))

    def __post_init__(self):
        check_format(self.common, self.vocab)


def plain(config) -> dict:
    """A configuration as nested plain values, for metadata documents."""

    def value(v):
        if isinstance(v, Enum):
            return v.value
        if isinstance(v, dict):
            return {k: value(x) for k, x in v.items()}
        return v

    return {k: value(v) for k, v in asdict(config).items()}
