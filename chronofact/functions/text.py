"""Tokens, whitespace pieces and offsets as column expressions.

Offsets are Unicode code points, half open, counted from zero.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The 29 characters Unicode text processing counts as white
# space. Java's \s covers only six of them.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WORD_PIECE = rf"[^{SPACE}]+[{SPACE}]*"
WORD = rf"[^{SPACE}]+"

# A character outside these ranges is plain, that is, lower-casing
# plus "ß" -> "ss" equals NFC followed by case folding, and [\p{L}\p{N}_] equals
# Python's \w. Plain are ASCII, Latin-1, Latin Extended-A, Cyrillic, Vietnamese,
# general punctuation and Han, without combining marks and special casings.
NOT_PLAIN = (
    r"[\x{b5}\x{130}\x{149}\x{17f}-\x{3ff}\x{460}-\x{1e9f}"
    r"\x{1efa}-\x{200f}\x{2028}-\x{20ab}\x{20ad}-\x{4dff}\x{9ff0}-\x{10ffff}]"
)
TERM = r"[\p{L}\p{N}_]+"

_WORD_CHARS = re.compile(r"\w+")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _terms_by_unicode_tables(text: pd.Series) -> pd.Series:
    return text.map(
        lambda s: None if s is None else _WORD_CHARS.findall(unicodedata.normalize("NFC", s).casefold())
    )


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def native_terms(text: Column | str) -> Column:
    """Terms of text made of :data:`PLAIN` characters only, wholly in the JVM."""
    folded = F.replace(F.lower(col(text)), F.lit("ß"), F.lit("ss"))
    return F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))


def terms(text: Column | str) -> Column:
    """NFC, case folded word-character runs, in order, duplicates kept.

    Rows of plain characters stay in the JVM. Only the other rows carry their
    text to Python, where the Unicode tables are complete.
    """
    text = col(text)
    plain = ~text.rlike(NOT_PLAIN)
    return F.when(plain, native_terms(text)).otherwise(
        _terms_by_unicode_tables(F.when(~plain, text))
    )


def word_pieces(text: Column | str) -> Column:
    """Whitespace-separated words, each with the white space that follows it."""
    return F.regexp_extract_all(col(text), F.lit(WORD_PIECE), F.lit(0))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(WORD))


def raw_offset(text: Column | str, offset: Column, crlf: Column) -> Column:
    """Offset in the raw text whose line ends were CRLF before normalisation."""
    return F.when(crlf, offset + line_feeds(F.substring(col(text), F.lit(1), offset))).otherwise(offset)


def span(text: Column | str, start: Column, end: Column) -> Column:
    return F.substring(col(text), start + 1, end - start)


def first_label(text: Column | str, labels: Sequence[str]) -> Column:
    """The first of ``labels``, in their order, that occurs anywhere in the text.

    Not the leftmost occurrence, which is what a regular expression would find.
    """
    return F.coalesce(*[F.when(F.contains(col(text), F.lit(label)), F.lit(label)) for label in labels])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once, also where ``body`` has lambdas of its own."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_totals(numbers: Column, block: int = 128) -> Column:
    """For every element of an integer array the sum of those before it.

    Two levels of partial sums: each element adds the blocks before its own
    and the elements before it in its block, so long arrays do not cost a
    quadratic number of additions.
    """
    add = lambda a, b: a + b
    zero = F.lit(0)

    def totals(sizes: Column) -> Column:
        last = F.floor((F.size(sizes) - 1) / F.lit(block)).cast("int")
        sums = F.transform(F.sequence(zero, last), lambda j: F.aggregate(F.slice(sizes, j * block + 1, F.lit(block)), zero, add))

        def total(blocks: Column, i: Column) -> Column:
            own = F.floor(i / F.lit(block)).cast("int")
            return (F.aggregate(F.slice(blocks, F.lit(1), own), zero, add)
                    + F.aggregate(F.slice(sizes, own * block + 1, i - own * block), zero, add))

        return let(sums, lambda blocks: F.transform(F.sequence(zero, F.size(sizes) - 1), lambda i: total(blocks, i)))

    return F.when(F.size(numbers) > 0, let(numbers, totals)).otherwise(F.array().cast("array<int>"))


def running_maxima(numbers: Column, block: int = 256) -> Column:
    """For every element of an array the largest up to and with it, in two levels like :func:`running_totals`."""
    def maxima(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / F.lit(block)).cast("int")
        tops = F.transform(F.sequence(F.lit(0), last), lambda j: F.array_max(F.slice(values, j * block + 1, F.lit(block))))

        def upto(blocks: Column, i: Column) -> Column:
            own = F.floor(i / F.lit(block)).cast("int")
            here = F.array_max(F.slice(values, own * block + 1, i - own * block + 1))
            return F.greatest(F.array_max(F.slice(blocks, F.lit(1), own)), here)
        return let(tops, lambda blocks: F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: upto(blocks, i)))

    return F.when(F.size(numbers) > 0, let(numbers, maxima)).otherwise(numbers)


def first_place(values: Column, holds: Callable[[Column], Column]) -> Column:
    """The first place from 0 at which ``holds``, which stays true from there on; the size if nowhere. A binary search."""
    n = F.size(values)

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        low = F.struct(s["lo"].alias("lo"), middle.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(holds(F.get(values, middle)), low).otherwise(
            F.struct((middle + 1).alias("lo"), s["hi"].alias("hi")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(1))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve)["lo"]


def running_starts(pieces: Column, gap: int = 0, block: int = 128) -> Column:
    """Start offset of every array element when elements are joined with ``gap`` characters."""
    return running_totals(F.transform(pieces, lambda p: F.length(p) + F.lit(gap)), block)


def line_feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def term_counts(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of an array of terms: each different term once, in order."""
    def counted(ordered: Column) -> Column:
        n = F.size(ordered)
        first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))
        return let(first, lambda starts: F.transform(starts, lambda p, j: F.struct(
            F.get(ordered, p - 1).alias("term"), (F.coalesce(F.get(starts, j + 1), n + 1) - p).cast("bigint").alias("tf"))))

    return F.when(F.size(terms) > 0, let(F.array_sort(terms), counted)).when(
        terms.isNotNull(), F.array().cast("array<struct<term:string,tf:bigint>>"))
