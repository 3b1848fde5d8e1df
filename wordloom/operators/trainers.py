"""The trainers of the two kinds of models: vocabularies, outputs and blocks of a pass."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.config import CommonConfig, DepembedsConfig, RunConfig, SkipGramConfig, plain
from wordloom.durable import written
from wordloom.operators import deps, examples
from wordloom.operators.pairs import known_tokens
from wordloom.operators.subwords import input_ids
from wordloom.operators.vocab import Vocabulary, build_vocabulary, context_vocabulary


def _kept(vocab: Vocabulary) -> float:
    """Focus tokens that survive subsampling in one pass, on average."""
    return float(vocab.table.agg(F.coalesce(F.sum(F.col("count") * F.col("keep_prob")), F.lit(0.0))).first()[0])


@dataclass(frozen=True)
class WindowTrainer:
    """Window models over ``(sent_id, tokens)``; tokens are looked up once for all passes."""

    vocab: Vocabulary
    words: DataFrame
    known: DataFrame
    kept: float
    common: CommonConfig
    model: SkipGramConfig

    @classmethod
    def over(cls, sentences: DataFrame, config: RunConfig) -> WindowTrainer:
        vocab = build_vocabulary(sentences.select(F.explode("tokens").alias("token")), config.vocab)
        words = written(vocab.table.select("idx", input_ids(vocab.table).alias("ids")))
        return cls(vocab, words, written(known_tokens(sentences, vocab.table)), _kept(vocab), config.common, config.model)

    @property
    def n_output_types(self) -> int:
        return self.vocab.size * self.model.model.band(self.model.context_size)

    def metadata(self) -> dict:
        return {"type": "SkipGramLike", **plain(self.model)}

    def blocks(self, layout: examples.Layout) -> DataFrame:
        return examples.window_blocks(self.known, self.model, layout)

    def expand(self, epoch: int):
        c = self.common
        return examples.expand_windows(self.model, self.vocab.size, c.negative_samples, c.zipf_exponent, epoch)


@dataclass(frozen=True)
class DependencyTrainer:
    """The dependency model over ``(sent_id, nodes)``; one reading gives both vocabularies."""

    vocab: Vocabulary
    words: DataFrame
    kept: float
    trees: DataFrame
    context_vocab: DataFrame
    n_output_types: int
    common: CommonConfig
    model: DepembedsConfig

    @classmethod
    def over(cls, trees: DataFrame, config: RunConfig) -> DependencyTrainer:
        model = config.model
        if model.projectivize:
            trees, model = written(deps.projectivize(trees)), replace(model, projectivize=False)
        vocab = build_vocabulary(trees.select(F.explode("nodes.form").alias("token")), config.vocab)
        words = written(vocab.table.select("idx", input_ids(vocab.table).alias("ids")))
        ranked = written(context_vocabulary(deps.dependency_contexts(trees, model), model.context_cutoff, model.context_discard))
        return cls(vocab, words, _kept(vocab), trees, ranked, ranked.count(), config.common, model)

    def metadata(self) -> dict:
        return {"type": "Depembeds", **plain(self.model)}

    def blocks(self, layout: examples.Layout) -> DataFrame:
        return examples.dependency_blocks(self.trees, self.model, self.vocab.table, self.context_vocab, layout)

    def expand(self, epoch: int):
        c = self.common
        return examples.expand_contexts(self.n_output_types, c.negative_samples, c.zipf_exponent, epoch)


def trainer_for(source: DataFrame, config: RunConfig) -> WindowTrainer | DependencyTrainer:
    """The trainer of the configured model over its (durable) corpus."""
    kind = WindowTrainer if isinstance(config.model, SkipGramConfig) else DependencyTrainer
    return kind.over(source, config)
