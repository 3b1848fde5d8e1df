"""Column functions over text: tokens, character n-grams and their bucket hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, as a regular-expression class.
WHITE = r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# FNV parameters of 64 and 32 bits.
FNV64_BASIS, FNV64_PRIME = 0xCBF29CE484222325, 0x100000001B3
FNV32_BASIS, FNV32_PRIME = 0x811C9DC5, 0x01000193


def has_tokens(line: Column) -> Column:
    """Whether anything but white space is in the line."""
    return line.rlike(WHITE.replace("[", "[^", 1))


def whitespace_tokens(line: Column) -> Column:
    """The tokens of a line; a blank line has none, a null line is null."""
    # white space at the ends leaves empty parts; one pass is cheaper than trimming first
    return F.array_remove(F.split(line, f"{WHITE}+"), "")


def bracketed(word: Column) -> Column:
    return F.concat(F.lit("<"), word, F.lit(">"))


def ngrams(word: Column, min_n: int, max_n: int) -> Column:
    """Character n-grams of the bracketed word, by start and longest first.

    Lengths count code points; ``min_n`` and ``max_n`` are both inclusive.
    """
    w = bracketed(word)
    starts = F.sequence(F.lit(1), F.length(w))
    per_start = F.transform(
        starts,
        lambda p: F.transform(
            F.filter(F.sequence(F.lit(max_n), F.lit(min_n), F.lit(-1)), lambda n: p + n - 1 <= F.length(w)),
            lambda n: F.substring(w, p, n),
        ),
    )
    return F.flatten(per_start)


def code_point_bucket(ngram: Column, exponent: int) -> Column:
    """FNV-1a of 64 bits over the length (8 bytes) and the code points (4 bytes
    each, little endian), reduced to ``2^exponent`` buckets.

    XOR, product and mask close over the low bits, so all arithmetic stays
    below ``2^62``; runs of zero bytes become one product with a power.
    """
    if not 1 <= exponent <= 31:
        raise ValueError("the exponent of the buckets lies in 1..31")
    m = (1 << exponent) - 1
    p1, p2, p4 = (F.lit(pow(FNV64_PRIME, k, 1 << exponent)).cast("long") for k in (1, 2, 4))
    mask = F.lit(m).cast("long")
    byte = lambda c, shift: F.shiftright(F.ascii(c).cast("long"), shift).bitwiseAND(255)
    times = lambda h, p: (h * p).bitwiseAND(mask)
    basis = F.lit(FNV64_BASIS & m).cast("long")
    start = basis
    for shift in (0, 8, 16, 24):  # a length has 31 bits
        start = times(start.bitwiseXOR(F.shiftright(F.length(ngram).cast("long"), shift).bitwiseAND(255)), p1)
    start = times(start, p4)

    def step(h: Column, c: Column) -> Column:
        for shift in (0, 8):
            h = times(h.bitwiseXOR(byte(c, shift)), p1)
        return times(h.bitwiseXOR(byte(c, 16)), p2)

    return F.aggregate(F.split(ngram, ""), start, step)


def utf8_bucket(ngram: Column, exponent: int) -> Column:
    """FNV-1a of 32 bits over the UTF-8 bytes, each read as a signed byte,
    modulo ``2^exponent`` buckets."""
    if not 1 <= exponent <= 31:
        raise ValueError("the exponent of the buckets lies in 1..31")
    m = (1 << exponent) - 1
    prime, mask = F.lit(FNV32_PRIME & m).cast("long"), F.lit(m).cast("long")
    digits = F.hex(F.encode(ngram, "UTF-8"))
    values = F.transform(
        F.sequence(F.lit(1), F.length(digits), F.lit(2)),
        lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"),
    )
    signed = lambda b: F.when(b >= 128, b + F.lit(0xFFFFFF00)).otherwise(b)
    step = lambda h, b: (h.bitwiseXOR(signed(b).bitwiseAND(mask)) * prime).bitwiseAND(mask)
    return F.aggregate(values, F.lit(FNV32_BASIS & m).cast("long"), step)
