"""Identifiers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """``BK0000042``: zero-padded to ``width``; longer numbers are kept whole."""
    digits = number.cast("string")
    return F.concat(
        F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
    )


def schema_name(custom: str | None, default: str) -> str:
    """A custom schema, trimmed and upper-cased, replaces the default one."""
    return default if custom is None else custom.strip().upper()


def stamped_id(prefix: str, stamp: Column, keys: list[Column]) -> Column:
    """Run timestamp plus the digest of the key: rows of the same second stay distinct."""
    return F.concat(
        F.lit(prefix),
        F.date_format(stamp, "yyyyMMddHHmmss"),
        F.lit("_"),
        F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])),
    )
