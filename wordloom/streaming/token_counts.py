"""Incremental token counts over a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import whitespace_tokens


def streaming_token_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Running ``(label, count)`` of a streaming (or static) DataFrame of
    texts; write it in ``complete`` or ``update`` mode.  The state holds one
    counter per distinct token; null and blank texts add nothing."""
    tokens = texts.select(F.explode(whitespace_tokens(F.col(text))).alias("label"))
    return tokens.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
