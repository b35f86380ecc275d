"""Sentences, tokens and replies as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(value: Column) -> Column:
    """1234567.8 -> 1,234,567.80; a missing value reads ``nan``."""
    return F.coalesce(F.format_number(value.cast("double"), 2), F.lit("nan"))


def two_decimals(value: Column) -> Column:
    return F.coalesce(value.cast("decimal(18,2)").cast("string"), F.lit("nan"))


def whole(value: Column) -> Column:
    return F.coalesce(value.cast("long").cast("string"), F.lit("nan"))


def render(template: str, **fields: Column) -> Column:
    """Fill ``{name}`` places of a sentence with columns, NULL reading as ``None``."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("None")))
    return F.concat(*parts)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, over the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space, line ends included, at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_code_fences(text: Column) -> Column:
    return strip(F.regexp_replace(text, "```sql|```", ""))


def labelled_line(reply: Column, label: str) -> Column:
    """Rest of the line after ``LABEL:``, trimmed; NULL when the label is missing."""
    found = F.regexp_extract(reply, rf"(?s){label}:([^\n]*)", 1)
    return F.when(F.contains(reply, F.lit(f"{label}:")), strip(found))


def printed(value: Column, kind: str) -> Column:
    """Text of one result cell: fractions with at most two decimals, NULL as ``None``."""
    if kind in ("double", "float") or kind.startswith("decimal"):
        fixed = F.round(value, 2).cast("decimal(38,2)").cast("string")
        out = F.regexp_replace(fixed, r"(\.\d)0$", "$1")
    elif kind == "boolean":
        out = F.initcap(value.cast("string"))
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit("None"))
