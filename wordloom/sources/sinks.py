"""Writing trained embeddings: tables with metadata, text and word2vec files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from datetime import datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom import __version__
from wordloom.config import EmbeddingFormat, RunConfig, check_format, plain
from wordloom.operators.sampling import initial_vectors

_TIME = "%Y-%m-%d %H:%M:%S"


@dataclass(frozen=True)
class TrainInfo:
    """Where a model came from and when it was trained (local time)."""

    corpus: str
    output: str
    n_threads: int
    start_datetime: str = ""
    end_datetime: str = ""

    @classmethod
    def start(cls, corpus: str, output: str, n_threads: int) -> TrainInfo:
        return cls(corpus, output, n_threads, datetime.now().strftime(_TIME))

    def set_end(self) -> TrainInfo:
        return replace(self, end_datetime=datetime.now().strftime(_TIME))


def metadata(config: RunConfig, info: TrainInfo) -> dict:
    """The metadata document: configuration, version and training information."""
    model = plain(config.model)
    kind = "SkipGramLike" if "context_size" in model else "Depembeds"
    common = {k: v for k, v in plain(config.common).items() if k != "format"}
    return {
        "common_config": common,
        "model_config": {"type": kind, **model},
        "vocab_config": {"type": type(config.vocab).__name__.removesuffix("Config"), **plain(config.vocab)},
        "version_info": {"version": __version__},
        "training_info": asdict(info),
    }


def text_rows(vectors: DataFrame, dims: int | None = None, size: int | None = None) -> DataFrame:
    """``(idx, line)``: a word and its mean vector, separated by blanks; with
    ``dims`` a header ``size dims`` at index -1."""
    line = F.concat_ws(" ", "label", F.transform("mean", lambda x: x.cast("float").cast("string")))
    body = vectors.select(F.col("idx").cast("long").alias("idx"), line.alias("line"))
    if dims is None:
        return body
    header = vectors.sparkSession.createDataFrame([(-1, f"{size} {dims}")], "idx long, line string")
    return header.unionByName(body)


def write_text(vectors: DataFrame, path: str, header: bool = False) -> None:
    """Ordered text parts (their names sort in order) in the folder ``path``."""
    first = vectors.select(F.size("mean").alias("n")).first()
    rows = text_rows(vectors, first["n"] if first else 0, vectors.count()) if header else text_rows(vectors)
    rows.orderBy("idx").select("line").write.mode("overwrite").text(path)


def write_word2vec(vectors: DataFrame, path: str) -> None:
    """One local file: ``size dims``, then each word, a blank and its floats.

    Rows stream through the driver one partition at a time, in order.
    """
    first = vectors.select(F.size("mean").alias("n")).first()
    dims = first["n"] if first else 0
    with Path(path).open("wb") as out:
        out.write(f"{vectors.count()} {dims}\n".encode())
        for row in vectors.orderBy("idx").select("label", "mean").toLocalIterator():
            out.write(row["label"].encode() + b" " + struct.pack(f"<{dims}f", *row["mean"]) + b"\n")


# Fixed values of the fastText model file: magic number, version, skip-gram model, negative-sampling loss.
_FT_MAGIC, _FT_VERSION, _FT_MODEL, _FT_LOSS = 793_712_314, 12, 2, 2


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows as one binary value of little-endian floats a batch."""
    for batch in batches:
        raw = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.large_binary())], names=["raw"])


def write_fasttext(vocab: DataFrame, params: DataFrame, config: RunConfig, path: str) -> None:
    """One local file in fastText's model layout: arguments, dictionary, input
    matrix (words, then all buckets) and an empty output matrix.

    The rows are the raw ones, so that a reader's mean over a word's rows is
    its vector.  Bucket rows that no word uses have their initial value.  Rows
    stream through the driver in order, one binary value a batch.
    """
    check_format(replace(config.common, format=EmbeddingFormat.FASTTEXT), config.vocab)
    spark, common, words = vocab.sparkSession, config.common, config.vocab
    size, buckets, dims = vocab.count(), 1 << words.indexer.buckets_exp, common.dims
    window = getattr(config.model, "context_size", 0)
    least = words.cutoff.value if words.cutoff.type == "MinCount" else 0
    first = initial_vectors(spark, "in", size + buckets, dims).withColumnRenamed("vec", "start")
    rows = first.join(params.where(F.col("matrix") == 0).select("row_id", "vec"), "row_id", "left")
    ordered = rows.orderBy("row_id").select(F.coalesce("vec", "start").alias("vec")).mapInArrow(_blobs, "raw binary")
    with Path(path).open("wb") as out:
        arguments = (dims, window, common.epochs, least, common.negative_samples, 1, _FT_LOSS, _FT_MODEL, buckets, words.min_n, words.max_n, 100)
        out.write(struct.pack("<14id", _FT_MAGIC, _FT_VERSION, *arguments, words.discard_threshold))
        total = vocab.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        out.write(struct.pack("<3i2q", size, size, 0, total, -1))
        for row in vocab.orderBy("idx").select("label", "count").toLocalIterator():
            out.write(row["label"].encode() + b"\0" + struct.pack("<qb", row["count"], 0))
        out.write(struct.pack("<?2q", False, size + buckets, dims))
        for row in ordered.toLocalIterator():
            out.write(row["raw"])
        out.write(struct.pack("<?2q", False, 0, dims))


def read_fasttext(path: str) -> tuple[dict[str, int], list[tuple[str, int]], np.ndarray]:
    """``(arguments, words with counts, input matrix)`` of a file of :func:`write_fasttext`."""
    raw = Path(path).read_bytes()
    names = ("dim", "ws", "epoch", "minCount", "neg", "wordNgrams", "loss", "model", "bucket", "minn", "maxn", "lrUpdateRate")
    magic, version, *values = struct.unpack_from("<14i", raw)
    if (magic, version) != (_FT_MAGIC, _FT_VERSION):
        raise ValueError("not a fastText model of a known version")
    at = 14 * 4 + 8
    size = struct.unpack_from("<i", raw, at)[0]
    at, words = at + 28, []
    for _ in range(size):
        end = raw.index(b"\0", at)
        words.append((raw[at:end].decode(), struct.unpack_from("<q", raw, end + 1)[0]))
        at = end + 10
    rows, dims = struct.unpack_from("<2q", raw, at + 1)
    matrix = np.frombuffer(raw, "<f4", rows * dims, at + 17).reshape(rows, dims)
    return dict(zip(names, values)), words, matrix


def read_word2vec(path: str) -> Iterator[tuple[str, np.ndarray]]:
    """``(word, vector)`` of a file of :func:`write_word2vec`, in order."""
    with Path(path).open("rb") as file:
        size, dims = map(int, file.readline().split())
        for _ in range(size):
            word = b""
            while (c := file.read(1)) != b" ":
                word += c
            yield word.decode(), np.frombuffer(file.read(4 * dims), "<f4")
            file.read(1)


def write_tables(vocab: DataFrame, vectors: DataFrame, params: DataFrame, path: str, document: dict) -> None:
    """The canonical form: tables ``words``, ``norms`` and ``subwords`` (raw
    rows beside the words) and ``metadata`` as JSON text."""
    spark = vectors.sparkSession
    size = vectors.count()
    vectors.select("idx", "label", "vec").write.mode("overwrite").parquet(f"{path}/words")
    vectors.select("idx", "norm").write.mode("overwrite").parquet(f"{path}/norms")
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    rest = params.where((F.col("matrix") == 0) & (F.col("row_id") >= size)).select("row_id", "vec")
    rest.write.mode("overwrite").parquet(f"{path}/subwords")
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def write_model(vocab: DataFrame, vectors: DataFrame, params: DataFrame, config: RunConfig, info: TrainInfo) -> None:
    """Write a model in the configured format.

    The native format is the canonical tables.
    """
    check_format(config.common, config.vocab)
    kind, path = config.common.format, config.output
    if kind == EmbeddingFormat.FASTTEXT:
        write_fasttext(vocab, params, config, path)
    elif kind == EmbeddingFormat.WORD2VEC:
        write_word2vec(vectors, path)
    elif kind in (EmbeddingFormat.TEXT, EmbeddingFormat.TEXTDIMS):
        write_text(vectors, path, kind == EmbeddingFormat.TEXTDIMS)
    else:
        write_tables(vocab, vectors, params, path, metadata(config, info.set_end()))
