"""Column expressions on whole texts that the operators share; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAK = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it.

    A column that is read inside a higher-order function is otherwise inlined there and
    computed again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space. A null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def stable_hash48(*parts: Column) -> Column:
    """48 bits of the MD5 digest of the parts, the same in every engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
