"""Command line: ``python -m wordloom.cli skipgram|deps [options] CORPUS OUTPUT``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from wordloom.config import (
    BucketConfig, BucketIndexerType, CommonConfig, Cutoff, DepembedsConfig, EmbeddingFormat, ModelType,
    NGramConfig, RunConfig, SimpleVocabConfig, SkipGramConfig, SubwordKind, SubwordVocabConfig,
)
from wordloom.durable import written
from wordloom.operators import train
from wordloom.operators.sampling import initial_vectors
from wordloom.operators.trainers import trainer_for
from wordloom.sources import corpus, sinks
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    """All options; exclusive ones exclude each other here already."""
    top = argparse.ArgumentParser(prog="wordloom")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("skipgram", "deps"):
        p = commands.add_parser(name)
        p.add_argument("corpus")
        p.add_argument("output")
        p.add_argument("--buckets", type=int, default=21, metavar="EXP")
        p.add_argument("--dims", type=int, default=300)
        p.add_argument("--discard", type=float, default=1e-4)
        p.add_argument("-f", "--format", default="native", choices=[f.value for f in EmbeddingFormat])
        p.add_argument("--hash-indexer", default="native", choices=[f.value for f in BucketIndexerType])
        p.add_argument("--epochs", type=int, default=15)
        p.add_argument("--lr", type=float, default=0.05)
        words = p.add_mutually_exclusive_group()
        words.add_argument("--mincount", type=int)
        words.add_argument("--target-size", type=int)
        p.add_argument("--minn", type=int, default=3)
        p.add_argument("--maxn", type=int, default=6)
        p.add_argument("--subwords", default="buckets", choices=[k.value for k in SubwordKind])
        grams = p.add_mutually_exclusive_group()
        grams.add_argument("--ngram-mincount", type=int)
        grams.add_argument("--ngram-target-size", type=int)
        p.add_argument("--ns", type=int, default=5)
        p.add_argument("--threads", type=int)
        p.add_argument("--zipf", type=float, default=0.5)
        if name == "skipgram":
            p.add_argument("--context", type=int, default=10)
            p.add_argument("--model", default="skipgram", choices=[m.value for m in ModelType])
            continue
        p.add_argument("--context-discard", type=float, default=1e-4)
        contexts = p.add_mutually_exclusive_group()
        contexts.add_argument("--context-mincount", type=int)
        contexts.add_argument("--context-target-size", type=int)
        p.add_argument("--dependency-depth", type=int, default=1)
        for flag in ("--untyped-deps", "--normalize-context", "--projectivize", "--use-root"):
            p.add_argument(flag, action="store_true")
    return top


def configure(args: argparse.Namespace) -> RunConfig:
    """The typed configuration of parsed options."""
    cutoff = Cutoff.of(args.mincount, args.target_size)
    if args.subwords == "none":
        vocab = SimpleVocabConfig(cutoff, args.discard)
    else:
        if args.subwords == "ngrams":
            indexer = NGramConfig(Cutoff.of(args.ngram_mincount, args.ngram_target_size))
        else:
            indexer = BucketConfig(args.buckets, BucketIndexerType.parse(args.hash_indexer))
        vocab = SubwordVocabConfig(cutoff, args.discard, args.minn, args.maxn, indexer)
    common = CommonConfig(
        dims=args.dims, epochs=args.epochs, format=EmbeddingFormat.parse(args.format),
        negative_samples=args.ns, lr=args.lr, zipf_exponent=args.zipf,
    )
    if args.command == "skipgram":
        model = SkipGramConfig(ModelType.parse(args.model), args.context)
    else:
        model = DepembedsConfig(
            args.dependency_depth, args.use_root, args.normalize_context, args.projectivize, args.untyped_deps,
            Cutoff.of(args.context_mincount, args.context_target_size), args.context_discard,
        )
    extra = {"partitions": args.threads} if args.threads else {}
    return RunConfig(args.corpus, args.output, common, vocab, model, **extra)


def initial_params(spark: SparkSession, vocab: DataFrame, n_outputs: int, dims: int) -> DataFrame:
    """Rows of both matrices.  Of the subword rows only those that some word
    uses are made; the others never change from their initial value."""
    from wordloom.functions.rand import uniform
    from wordloom.operators.subwords import input_ids

    used = vocab.select(F.explode(input_ids(vocab)).alias("row_id")).distinct()
    component = lambda d: ((2 * uniform("i", 0, "in", F.col("row_id"), d) - 1) / F.lit(float(dims))).cast("float")
    inn = used.select(F.lit(train.INPUT).alias("matrix"), "row_id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), component).alias("vec"))
    out = initial_vectors(spark, "out", n_outputs, dims).select(F.lit(train.OUTPUT).alias("matrix"), "row_id", "vec")
    return inn.unionByName(out)


def fit(spark: SparkSession, config: RunConfig, source: DataFrame, max_passes: int | None = None):
    """Train on sentences ``(sent_id, tokens)`` or trees ``(sent_id, nodes)``;
    returns ``(vocabulary, final vectors, trained)``."""
    trainer = trainer_for(written(source), config)
    vocab = trainer.vocab
    if not vocab.size:
        raise ValueError("the corpus provides no sentences to train on")
    start = initial_params(spark, vocab.table, trainer.n_output_types, config.common.dims)
    trained = train.train(trainer, start, vocab.n_tokens, config.common, max_passes)
    return vocab, train.final_vectors(vocab.table, trained.params), trained


def run(spark: SparkSession, config: RunConfig) -> None:
    """Read the corpus, train and write the model."""
    info = sinks.TrainInfo.start(config.corpus, config.output, config.partitions)
    if isinstance(config.model, SkipGramConfig):
        lines = corpus.tokenised(corpus.read_lines(spark, config.corpus))
        source = lines.select(F.monotonically_increasing_id().alias("sent_id"), "tokens")
    else:
        blocks = corpus.parse_trees(corpus.read_blocks(spark, config.corpus), strict=True)
        source = blocks.select(F.monotonically_increasing_id().alias("sent_id"), "nodes")
    vocab, vectors, trained = fit(spark, config, source)
    sinks.write_model(vocab.table, vectors, trained.params, config, info)


def main(argv: list[str] | None = None) -> None:
    config = configure(parser().parse_args(argv))
    run(SparkSession.builder.getOrCreate(), config)


if __name__ == "__main__":
    main()
