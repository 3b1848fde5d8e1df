"""Queries of the general data-processing problems (3 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.rejects import load_strict, rejected
from wordloom.operators.skew import heavy_keys, salted_aggregate
from wordloom.session import spread, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with at least 1 in 100 of all rows, as they lie."""
    rows = table(spark, sf_dir, "type_counts").select("count_id", "label")
    heavy = heavy_keys(rows, "label", 0.005)
    per_label = salted_aggregate(rows, "label", {"records": ("count", F.lit(1))}, heavy=heavy)
    return per_label.where(F.col("label").isNotNull() & (F.col("records") * 100 >= heavy.rows)).select("label")


def p3_label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and summed count of every label, rows as they lie."""
    rows = table(spark, sf_dir, "type_counts").select("count_id", "label", "count")
    return salted_aggregate(rows, "label", {"records": ("count", F.lit(1)), "total": ("sum", F.col("count"))})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of dep_raw that break the format, with the reason."""
    return rejected(spread(table(spark, sf_dir, "dep_raw").select("line_id", "raw")))


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of dep_raw that conform, as typed dependency rows."""
    return load_strict(spread(table(spark, sf_dir, "dep_raw").select("line_id", "raw")))


QUERIES = {"p3_found": p3_found, "p3_label_totals": p3_label_totals, "p6_found": p6_found, "p6_loaded": p6_loaded}

# The SQL engine has no possessive quantifiers; none are needed there.
# What the fields of a valid line may hold.
VALUE_PATTERNS = {
    "sent_id": r"[0-9]+",
    "focus": r"[0-9]+",
    "direction": r"regular|inverse",
    "depth": r"[1-9]",
    "dep_label": r"[A-Za-z]+(?::[A-Za-z]+)?",
    "form": r"[^\x00-\x09\x0B-\x1F\x7F-\x9F\x{FFFD}]+",
}
_F = r'(?:"(?:[^"]|"")*"|[^",]*)'
_REC = r"\A" + ",".join(f"({_F})" for _ in VALUE_PATTERNS) + r"\z"
_BODY = "CASE WHEN ends_with(raw, chr(13)) THEN substr(raw, 1, length(raw) - 1) ELSE raw END"


def _value(i: int) -> str:
    f = f"regexp_extract(body, '{_REC}', {i + 1})"
    return f"CASE WHEN starts_with({f}, '\"') THEN replace(substr({f}, 2, length({f}) - 2), '\"\"', '\"') ELSE {f} END"


_PARTS = f"""
WITH b AS (SELECT line_id, {_BODY} AS body FROM dep_raw),
v AS (SELECT line_id, body, regexp_matches(body, '{_REC}') AS six, regexp_matches(body, '\\A{_F}(?:,{_F})*\\z') AS quoted,
      {", ".join(f"{_value(i)} AS {name}" for i, name in enumerate(VALUE_PATTERNS))} FROM b),
j AS (SELECT *, {" AND ".join(f"regexp_matches({name}, '^(?:{p})$')" for name, p in VALUE_PATTERNS.items())} AS fine FROM v)
"""
SQL = {
    "p3_found": """SELECT label FROM type_counts WHERE label IS NOT NULL GROUP BY label
        HAVING count(*) * 100 >= (SELECT count(*) FROM type_counts)""",
    "p3_label_totals": """SELECT label, count(*) AS records, CAST(sum("count") AS BIGINT) AS total
        FROM type_counts GROUP BY label""",
    "p6_found": _PARTS
    + """SELECT line_id, CASE WHEN body IS NULL THEN 'columns' WHEN NOT quoted THEN 'quoting'
        WHEN NOT six THEN 'columns' ELSE 'value' END AS reason FROM j WHERE body IS NULL OR NOT six OR NOT fine""",
    "p6_loaded": _PARTS
    + """SELECT line_id, TRY_CAST(sent_id AS BIGINT) AS sent_id, TRY_CAST(focus AS INTEGER) AS focus,
        CAST(0 AS INTEGER) AS kind, CAST(CASE direction WHEN 'inverse' THEN 0 ELSE 1 END AS INTEGER) AS direction,
        CAST(depth AS INTEGER) AS depth, dep_label, form FROM j WHERE six AND fine""",
}
