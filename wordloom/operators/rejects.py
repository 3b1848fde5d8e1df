"""Strict loading of delimited lines with the reason for every reject (problem 6).

Strict load plus anti-join: one strict pattern and typed casts load only the
conforming lines; the loaded record offsets are subtracted from the raw
offsets; only the remainder is diagnosed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Any field: quoted as a whole with doubled inner quotes, or without any quote.
_QUOTED = r'"(?:[^"]++|"")*+"'
_BARE = r'[^",]*+'
_FIELD = rf"(?:{_QUOTED}|{_BARE})"


@dataclass(frozen=True)
class Field:
    """One field of a line: the pattern of its value where it stands bare, and
    within quotes if that differs, its type, and numbers for its words if any."""

    name: str
    bare: str
    quoted: str = ""
    type: str = "string"
    codes: tuple[tuple[str, int], ...] = ()

    @property
    def pattern(self) -> str:
        return rf'(?:{self.bare}|"(?:{self.quoted or self.bare})")'


@dataclass(frozen=True)
class LineFormat:
    """Comma-separated lines: their fields, and constant columns to add."""

    fields: tuple[Field, ...]
    constants: tuple[tuple[str, int], ...] = ()

    @property
    def strict(self) -> str:
        """A line whose every field has a valid value."""
        return r"\A" + ",".join(f.pattern for f in self.fields) + r"\z"

    @property
    def right_columns(self) -> str:
        """A well-quoted line with the right number of fields."""
        return r"\A" + ",".join([_FIELD] * len(self.fields)) + r"\z"


# Control characters but a line break, and the replacement character.
_UNFIT = r"\x00-\x09\x0B-\x1F\x7F-\x9F\x{FFFD}"
#: A dependency context.
DEPENDENCY = LineFormat(
    (
        Field("sent_id", "[0-9]++", type="long"),
        Field("focus", "[0-9]++", type="int"),
        Field("direction", "regular|inverse", codes=(("inverse", 0), ("regular", 1))),
        Field("depth", "[1-9]", type="int"),
        Field("dep_label", "[A-Za-z]++(?::[A-Za-z]++)?"),
        Field("form", rf'[^",{_UNFIT}]++', rf'(?:[^"{_UNFIT}]++|"")++'),
    ),
    (("kind", 0),),
)
_WELL_QUOTED = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
_EACH = rf"(?:\A|,)({_FIELD})"


def _body(raw: Column) -> Column:
    """The line without its one optional trailing carriage return."""
    return F.when(raw.endswith("\r"), F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)


def _value(parts: Column, at: int, field: Field) -> Column:
    part = F.get(parts, F.lit(at))
    inner = F.substring(part, F.lit(2), F.length(part) - 2)
    value = F.when(part.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(part)
    if field.codes:
        words = F.create_map(*[F.lit(x) for code in field.codes for x in code])
        return words[value].alias(field.name)
    return (value if field.type == "string" else value.try_cast(field.type)).alias(field.name)


def load_strict(lines: DataFrame, raw: str = "raw", offset: str = "line_id", form: LineFormat = DEPENDENCY) -> DataFrame:
    """The conforming lines as typed rows: ``offset``, the fields, the constants.

    One pattern decides whether a line conforms, one pass cuts it into fields.
    Of a :data:`DEPENDENCY`, ``direction`` becomes 0 (inverse) or 1 (regular)
    and ``kind`` is 0 (typed).  Digit strings beyond the range of their type
    are valid by the format; their number is null.  A null line never conforms.
    """
    fit = lines.select(F.col(offset), _body(F.col(raw)).alias("_body")).where(F.col("_body").rlike(form.strict))
    parts = fit.select(offset, F.regexp_extract_all("_body", F.lit(_EACH), F.lit(1)).alias("_parts"))
    values = [_value(F.col("_parts"), i, f) for i, f in enumerate(form.fields)]
    return parts.select(offset, *values, *[F.lit(v).alias(name) for name, v in form.constants])


def diagnose(lines: DataFrame, raw: str = "raw", offset: str = "line_id", form: LineFormat = DEPENDENCY) -> DataFrame:
    """``(offset, reason)`` of lines that are known not to conform.

    The first failing test names the reason: ``quoting`` (a quote inside a
    bare field, text after a closing quote, an unclosed quote), ``columns``
    (another number of fields), else ``value``.  A null line has no fields at all and is
    ``columns``.
    """
    body = F.col("_body")
    return lines.select(F.col(offset), _body(F.col(raw)).alias("_body")).select(
        offset,
        F.when(body.isNull(), "columns")
        .when(~body.rlike(_WELL_QUOTED), "quoting")
        .when(~body.rlike(form.right_columns), "columns")
        .otherwise("value")
        .alias("reason"),
    )


def rejected(lines: DataFrame, raw: str = "raw", offset: str = "line_id", form: LineFormat = DEPENDENCY) -> DataFrame:
    """Lines that did not load, each with its reason.

    ``offset`` must be unique and not null; the anti-join keeps exactly the
    offsets the strict load did not return.  An empty table gives no rows and
    further columns of ``lines`` take no part.
    """
    slim = lines.select(offset, raw)
    loaded = load_strict(slim, raw, offset, form).select(offset)
    return diagnose(slim.join(loaded, offset, "left_anti"), raw, offset, form)
