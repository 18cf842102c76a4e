"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: A word is a run of characters that are neither space nor one of tab..carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once, also where ``body`` has lambdas of its own.

    An outer expression named inside a lambda would be evaluated again for
    every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of ``text`` in order; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def digest_long(value: Column) -> Column:
    """The first 60 bits of the MD5 of ``value`` as text, also for null, as a non-negative long."""
    text = F.coalesce(value.cast("string"), F.lit("\x00"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
