"""One consistent form for text that looks the same (problem 2).

Arrow string buffers become numpy code-point arrays; lookup tables give each
code point its replacement; expansion offsets place the replacements; marks
are ordered and composed vectorially.  No string is touched row by row.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts whose usual shape is that of a Latin
# letter, written as (Latin letters, look-alikes in the same order).
LOOK_ALIKES = (
    # Cyrillic
    ("AaBCcEeHIiJjKMOoPpSsTXxYyhdqwvGFLQWZ", "АаВСсЕеНІіЈјКМОоРрЅѕТХхҮуһԁԛԝѵԌҒԼԚԜꙀ"),
    # Greek
    ("ABEZHIKMNOoPTYXvpFJ", "ΑΒΕΖΗΙΚΜΝΟοΡΤΥΧνρϜͿ"),
    ("aiuyck", "αιυγϲκ"),
    # Armenian
    ("OonuShqgjL", "ՕօոսՏհզցյԼ"),
    # Cherokee
    ("DRTiAJEWMHYGhZbVSLCPKBdQv", "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎩᏀᏂᏃᏏᏙᏚᏞᏟᏢᏦᏴᏧᏆᏉ"),
    ("AMESR", "ᎪᎷᎬᏕᏒ"),
    # Latin letters of another block with the plain letter's shape
    ("gd", "ɡԁ"),
    # Coptic and Lisu, upright capitals
    ("CKMNOPTX", "ⲤⲔⲘⲚⲞⲢⲦⲬ"),
    ("BPDTGKJCZFMNLSRVHWXYAEIOU", "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"),
)
# Hyphens of the same length and height.
HYPHENS = "‐‑‒⁃﹣－˗"
# Joined letters that compatibility mappings would not undo to the letters seen.
KEPT = "ſﬅ"  # the long s has a shape of its own

_DROP, _BLANK = -1, 0x20
_HANGUL = (0xAC00, 0xD7A4)
_SIZE = 0x110000


def _is_invisible(ch: str) -> bool:
    """Default-ignorable format characters, joiners, variation selectors and soft hyphens."""
    c = ord(ch)
    return (
        unicodedata.category(ch) == "Cf"
        or c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0x180B <= c <= 0x180F
        or 0xFE00 <= c <= 0xFE0F
        or 0xE0000 <= c <= 0xE0FFF
    )


def _is_blank(ch: str) -> bool:
    return unicodedata.category(ch) in ("Zs", "Zl", "Zp") or ch in "\t\n\x0b\x0c\r\x85"


#: Compatibility mappings that change only width, joined letters or font, not
#: what is seen; raised, lowered, circled and fractional forms are left out.
_VISIBLY_EQUAL = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


def _decomposition(ch: str) -> str:
    """The fully decomposed form of a code point under visibly equal mappings."""
    if ch in KEPT or 0x3131 <= ord(ch) <= 0x318E:  # letters of the Korean script that stand alone do not join
        return ch
    mapped = unicodedata.decomposition(ch)
    if not mapped:
        return ch
    kind, _, rest = mapped.partition(" ") if mapped[0] == "<" else ("", "", mapped)
    if kind and kind not in _VISIBLY_EQUAL:
        return ch
    return "".join(_decomposition(chr(int(x, 16))) for x in rest.split())


@dataclass(frozen=True)
class FormTables:
    """Lookup tables over all code points.

    ``start`` and ``length`` locate each code point's replacement in
    ``pool``; ``combining`` is the canonical class of a mark; ``alike`` maps a
    code point to its Latin look-alike; the pair tables compose base and mark.
    """

    start: np.ndarray
    length: np.ndarray
    pool: np.ndarray
    combining: np.ndarray
    alike: np.ndarray
    pairs: np.ndarray
    composed: np.ndarray


@functools.cache
def tables() -> FormTables:
    """Built once per process from the Unicode data of the interpreter."""
    start, length = np.arange(_SIZE, dtype=np.int32), np.ones(_SIZE, np.int8)
    combining, alike = np.zeros(_SIZE, np.uint8), np.arange(_SIZE, dtype=np.int32)
    pool: list[int] = []
    special: dict[int, list[int]] = {}
    pairs: dict[int, int] = {}
    for c in range(0x80, 0x30000):
        ch = chr(c)
        combining[c] = unicodedata.combining(ch)
        if _is_invisible(ch):
            special[c] = []
        elif _is_blank(ch):
            special[c] = [_BLANK]
        elif not _HANGUL[0] <= c < _HANGUL[1]:
            full = _decomposition(ch)
            if full != ch:
                special[c] = [ord(x) for x in full if not _is_invisible(x)]
            canonical = unicodedata.normalize("NFD", ch)
            if len(canonical) > 1 and unicodedata.normalize("NFC", canonical) == ch:
                one = unicodedata.decomposition(ch).split()
                if len(one) == 2:
                    pairs[(int(one[0], 16) << 21) | int(one[1], 16)] = c
    for c in range(0xE0000, 0xE1000):
        special[c] = []
    for c in "\t\n\x0b\x0c\r\x85":
        special[ord(c)] = [_BLANK]
    for c in HYPHENS:
        special[ord(c)] = [ord("-")]
    for latin, others in LOOK_ALIKES:
        for a, b in zip(latin, others, strict=True):
            alike[ord(b)] = ord(a)
    plain = np.arange(_SIZE, dtype=np.int32)
    for c, replacement in special.items():
        start[c], length[c] = _SIZE + len(pool), len(replacement)
        pool += replacement
    keys = np.array(sorted(pairs), np.int64)
    return FormTables(
        start, length, np.concatenate([plain, np.array(pool, np.int32)]), combining, alike,
        keys, np.array([pairs[int(k)] for k in keys], np.int32),
    )


def _code_points(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings in a row, and the offset of each string."""
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    starts = (raw & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(starts)])
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
    return points, before[offsets - offsets[0]]


def _strings(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The inverse of :func:`_code_points`; null where not ``valid``."""
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])[offsets].astype(np.int32)
    raw = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    mask = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(raw), mask)


def _decompose(points: np.ndarray, row: np.ndarray, t: FormTables) -> tuple[np.ndarray, np.ndarray]:
    """Replace each code point by its expansion; order marks canonically."""
    n = t.length[points].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    within = np.arange(total) - np.repeat(ends - n, n)
    out, row = t.pool[np.repeat(t.start[points], n) + within], np.repeat(row, n)
    ccc = t.combining[out]
    marks = ccc > 0
    if (marks[1:] & marks[:-1] & (ccc[1:] < ccc[:-1])).any():
        cluster = np.cumsum(~marks | np.concatenate([[True], row[1:] != row[:-1]]))
        order = np.lexsort((np.arange(total), ccc, cluster))
        out, row = out[order], row[order]
    return out, row


def _syllables(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join conjoining letters of the Korean script: first with vowel, then both with final."""
    for second, count in ((0x1161, 21), (0x11A8, 27)):
        if not ((points >= 0x1161) & (points < 0x11C3)).any():
            return points, row
        after = np.append(points[1:], 0)
        joins = np.append(row[1:] == row[:-1], False) & (after >= second) & (after < second + count)
        if count == 21:
            joins &= (points >= 0x1100) & (points < 0x1113)
            joined = _HANGUL[0] + ((points - 0x1100) * 21 + after - second) * 28
        else:
            joins &= (points >= _HANGUL[0]) & (points < _HANGUL[1]) & ((points - _HANGUL[0]) % 28 == 0)
            joined = points + after - second + 1
        keep = np.concatenate([[True], ~joins[:-1]])
        points, row = np.where(joins, joined, points)[keep].astype(np.int32), row[keep]
    return points, row


def _compose(points: np.ndarray, row: np.ndarray, t: FormTables) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition: each round joins every starter with its nearest
    mark that is not blocked, until nothing joins."""
    if len(points):
        points, row = _syllables(points, row)
    while len(points) > 1:
        ccc = t.combining[points]
        base = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(points)), 0))
        i = np.flatnonzero((ccc > 0) & (row[base] == row) & (t.combining[points[base]] == 0))
        # a mark is blocked when the one before it has the same class
        i = i[(base[i] == i - 1) | (ccc[i - 1] < ccc[i])]
        if not len(i) or not len(t.pairs):
            break
        key = (points[base[i]].astype(np.int64) << 21) | points[i]
        k = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
        hit = t.pairs[k] == key
        i, k = i[hit], k[hit]
        i_first, first = np.unique(base[i], return_index=True)
        if not len(first):
            break
        points = points.copy()
        points[i_first] = t.composed[k[first]]
        keep = np.ones(len(points), bool)
        keep[i[first]] = False
        points, row = points[keep], row[keep]
    return points, row


def _trimmed(points: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Drop blanks at the ends of each row; offsets of the rows that remain."""
    solid = np.flatnonzero(points != _BLANK)
    first = np.full(rows, len(points), np.int64)
    last = np.full(rows, -1, np.int64)
    np.minimum.at(first, row[solid], solid)
    np.maximum.at(last, row[solid], solid)
    at = np.arange(len(points))
    keep = (at >= first[row]) & (at <= last[row]) if len(points) else np.empty(0, bool)
    return points[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=rows))]).astype(np.int64)


def fold(array: pa.Array) -> tuple[pa.Array, pa.Array]:
    """``(form, skeleton)`` of every string.

    ``form`` is the consistent form: invisible characters gone, blanks and
    hyphens of one kind and none at the ends, widths and joined letters
    undone, marks composed.  ``skeleton`` further replaces look-alike letters;
    two texts look the same when their skeletons are equal.  Null stays null.
    """
    t = tables()
    valid = ~np.asarray(array.is_null())
    points, offsets = _code_points(array)
    row = np.repeat(np.arange(len(array)), np.diff(offsets))
    points, row = _decompose(points, row, t)
    results = []
    for chars in (points, t.alike[points]):
        # look-alikes may themselves take marks, so composition comes last
        chars, rows_ = _compose(chars, row, t)
        kept, bounds = _trimmed(chars, rows_, len(array))
        results.append(_strings(kept, bounds, valid))
    return results[0], results[1]


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form, skeleton = fold(batch.column(batch.num_columns - 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, form, skeleton], names=[*batch.schema.names, "form_", "skeleton_"])


def with_forms(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep``, ``text`` and its ``form_`` and ``skeleton_`` (see :func:`fold`).

    One row comes out for each that goes in.  Null text gives null forms, and
    text of only blanks and invisible characters gives the empty string.
    """
    slim = df.select(*keep, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.mapInArrow(_fold_batches, f"{fields}, form_ string, skeleton_ string")


def match_words(df: DataFrame, words: DataFrame, keep: list[str], text: str, word_id: str = "word_id", word: str = "word") -> DataFrame:
    """``keep``, ``text``, ``form_`` and, where the text looks like a word, the
    word's id and proper form (``word_id``, ``word_``), else null.

    All rows come out, also those that match nothing.  If several words look alike,
    one row comes out for each.
    """
    skeletons = with_forms(words, [word_id], word).where(F.col("skeleton_") != "").select(
        F.col(word_id).alias("word_id"), F.col(word).alias("word_"), F.col("skeleton_").alias("_key")
    )
    forms = with_forms(df, keep, text)
    return forms.join(skeletons, forms["skeleton_"] == skeletons["_key"], "left").drop("_key", "skeleton_")
