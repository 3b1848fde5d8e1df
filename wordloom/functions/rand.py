"""Uniform numbers from keys, so a draw does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) with 32 random bits, by the key ``a|b|c``."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fast_uniform(*parts: Column | str | int) -> Column:
    """As :func:`uniform` but by a cheaper hash, for training."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(9007199254740992.0)
