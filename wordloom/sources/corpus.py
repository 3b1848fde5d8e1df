"""Text and tree corpora: file scans, text columns and byte-range partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import has_tokens, whitespace_tokens

#: Room for the lines of one document in a sentence id.
LINES_PER_DOCUMENT = 100_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file or folder; only a line feed ends a line."""
    return spark.read.option("lineSep", "\n").text(path)


def tokenised(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines as token arrays; blank lines (and null) vanish."""
    # the filter looks for one visible character, so that no line is split twice
    return lines.where(has_tokens(F.col(value))).withColumn("tokens", whitespace_tokens(F.col(value)))


def document_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(sent_id, tokens)`` of each line of each document.

    ``sent_id`` is ``doc_id * 100000`` plus the line's position in the text,
    counted from 0 with blank lines included.  Null and blank texts have no
    sentences.  A text of more lines is an error: ids of two documents would
    meet.
    """
    lines = docs.select(F.col(doc_id), F.posexplode(F.split(F.col(text), "\n")).alias("at", "value"))
    return tokenised(lines).select(_sent_id(doc_id), "tokens")


def _sent_id(doc_id: str) -> Column:
    wrong = F.raise_error(F.concat(F.lit("too many lines in document "), F.col(doc_id).cast("string"))).cast("long")
    return F.when(F.col("at") < LINES_PER_DOCUMENT, F.col(doc_id) * LINES_PER_DOCUMENT + F.col("at")).otherwise(wrong).alias("sent_id")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a file that are separated by blank lines, as ``value``; lines
    may end in a carriage return."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.explode(F.split("value", "\n\r\n")).alias("value"))
    return blocks.where(has_tokens(F.col("value")))


NODE = "struct<id:int,form:string,head:int,rel:string>"


#: A comment, a blank row, a range or empty node, or a token row with its head.
_FINE_ROW = r"\A(?:#.*|\s*|[0-9]+[-.][0-9]+\t.*|[0-9]+(?:\t[^\t]*){5}\t[0-9]+\t[^\t]*(?:\t.*)?)\r?\z"


def parse_trees(blocks: DataFrame, value: str = "value", strict: bool = False) -> DataFrame:
    """Add ``nodes`` to blocks of tab-separated token rows.

    Comments, and rows whose id is not a whole number (ranges, empty nodes),
    are skipped; short rows parse as far as they go; a missing head is 0 and a
    missing relation is empty.  Blocks without any token row vanish.  With
    ``strict``, a row that is neither a comment nor blank and has no id, fewer
    than eight fields or no head number is an error.
    """
    if strict:
        blocks = blocks.withColumn(value, F.when(F.exists(F.split(F.col(value), "\n"), lambda r: ~r.rlike(_FINE_ROW)), F.raise_error(F.concat(F.lit("malformed tree: "), F.substring(value, 1, 200)))).otherwise(F.col(value)))
    rows = F.filter(F.split(F.col(value), "\n"), lambda r: r.rlike(r"\A[0-9]+\t"))
    field = lambda r, i: F.get(F.split(F.regexp_replace(r, r"\r\z", ""), "\t"), F.lit(i))
    head = lambda r: F.coalesce(F.when(field(r, 6).rlike(r"\A[0-9]{1,9}\z"), field(r, 6).cast("int")), F.lit(0))
    node = lambda r: F.struct(
        field(r, 0).try_cast("int").alias("id"),
        field(r, 1).alias("form"),
        head(r).alias("head"),
        F.coalesce(field(r, 7), F.lit("")).alias("rel"),
    )
    return blocks.withColumn("nodes", F.transform(rows, node)).where(F.size("nodes") > 0)


def document_trees(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(sent_id, nodes)`` of the tree blocks in each document, numbered by block."""
    blocks = docs.select(F.col(doc_id), F.posexplode(F.split(F.col(text), "\n\n")).alias("at", "value"))
    return parse_trees(blocks).select(_sent_id(doc_id), "nodes")


#: Bytes that are read at once.
_READ = 8 << 20


def _file(path: str) -> pa.NativeFile:
    """A file by its local path or by a URI of any file system the executors know."""
    if "://" in path:
        system, name = fs.FileSystem.from_uri(path)
        return system.open_input_file(name)
    return fs.LocalFileSystem().open_input_file(path.removeprefix("file:"))


def chunk_start(path: str, part: int, parts: int, separator: bytes = b"\n") -> int:
    """Byte offset at which part ``part`` of ``parts`` of a file begins: its
    share of the bytes, moved past the next separator.  A part that does not
    exist is an error."""
    if not 0 <= part < parts:
        raise ValueError(f"there is no part {part} of {parts}")
    with _file(path) as file:
        size = file.size()
        at = part * size // parts
        if not part:
            return 0
        tail = b""
        file.seek(at)
        while block := file.read(_READ):
            data = tail + block
            found = data.find(separator)
            if found >= 0:
                return at - len(tail) + found + len(separator)
            at += len(block)
            tail = data[len(data) - len(separator) + 1 :] if len(separator) > 1 else b""
        return size


def _part_batches(parts: int, separator: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, part in zip(*(c.to_pylist() for c in batch.columns)):
            at = chunk_start(path, part, parts, separator)
            with _file(path) as file:
                end = chunk_start(path, part + 1, parts, separator) if part + 1 < parts else file.size()
                file.seek(at)
                rest = b""
                while at < end or rest:
                    block = file.read(min(_READ, end - at))
                    at += len(block)
                    *pieces, rest = (rest + block).split(separator)
                    if at >= end:
                        pieces, rest = [*pieces, *([rest] if rest else [])], b""
                    values = pa.array([p.decode("utf-8", "replace") for p in pieces], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(pieces), pa.int32()), values], names=["part", "value"])


def read_parts(spark: SparkSession, path: str, parts: int, separator: str = "\n") -> DataFrame:
    """``(part, value)``: the lines (or blocks) of a file or folder, each file
    read in ``parts`` byte ranges by as many tasks.

    Every line belongs to the part its first byte lies in, so all lines come
    out once whatever the number of parts.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    each = files.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    named = each.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "part")
    return named.repartition("path", "part").mapInArrow(lambda it: _part_batches(parts, separator.encode(), it), "part int, value string")
