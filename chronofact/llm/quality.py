"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Every rule is a built-in expression, so the main path stays in the JVM. The
verdict is the same in every order; the order only decides how much work a
document costs before it is rejected. A filter computes what a rule needs only
when it comes to that rule; a report, which has all counts as columns, reads
them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .columns import BLANKS, let, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The sample that rules are tried on: rows, characters of a row, and how often each row is judged to time a rule.
SAMPLE_ROWS = 200
SAMPLE_CHARS = 20_000
SAMPLE_REPEATS = 8
Counts = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a bad document, by its counts; ``sql`` says the same over columns of these names."""

    name: str
    rejects: Callable[[Counts], Column]
    sql: str


#: What every document must pass, whatever the method's rules say.
BASE = (
    Rule("few_words", lambda c: c["n_words"] < MIN_WORDS, f"n_words < {MIN_WORDS}"),
    Rule("repeated_words", lambda c: c["much_repeated"], f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
)
#: The method's rules. A document passes if none rejects it: symbols for a quarter of the words, more than half of the
#: lines with a word equal to an earlier one, or a letter in fewer than four fifths of the words.
RULES = (
    Rule("symbols", lambda c: c["n_symbols"] * 4 > c["n_words"], "n_symbols * 4 > n_words"),
    Rule("repeated_lines", lambda c: c["n_dup_lines"] * 2 > c["n_lines"], "n_dup_lines * 2 > n_lines"),
    Rule("letters", lambda c: c["n_lettered"] * 5 < c["n_words"] * 4, "n_lettered * 5 < n_words * 4"),
)


def symbol_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, "")).cast("bigint")


def _solid_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, BLANKS, "") != "")


def repeated_line_count(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_solid_lines(text), lambda kept: F.size(kept) - F.size(F.array_distinct(kept))).cast("bigint")


def _windows(ws: Column) -> Column:
    """Hashes of all three-word windows of a list."""
    return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))


def repeated_word_count(word_list: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the list.

    Without two equal hashes there are none, which most texts show in one
    pass. Otherwise hashes are sorted with their places, so equal windows
    become neighbours in ``n log n`` steps however long the text is; should
    two different windows share a hash, their words are sorted too.
    """
    none = F.array().cast("array<int>")
    zero = F.lit(0).cast("bigint")

    def neighbours(found: Column, test: Callable[[Column, Column], Column]) -> Column:
        pairs = F.zip_with(F.slice(found, 1, F.size(found) - 1), F.slice(found, 2, F.size(found) - 1), lambda a, b: F.when(
            test(a, b), F.array(a["i"], b["i"])).otherwise(none))
        return F.array_sort(F.array_distinct(F.flatten(pairs)))

    def covered(starts: Column) -> Column:
        following = F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
        reach = F.zip_with(starts, following, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(reach, zero, lambda total, x: total + x)

    def exact(ws: Column, hashes: Column) -> Column:
        def words_at(i: Column) -> Column:
            return F.struct(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))

        def by_words(_: Column) -> Column:
            placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), words_at(i).alias("w"), i.alias("i"))))
            return neighbours(placed, lambda a, b: (a["h"] == b["h"]) & (a["w"] == b["w"]))

        def by_hash(placed: Column) -> Column:
            shared = F.exists(F.zip_with(F.slice(placed, 1, F.size(placed) - 1), F.slice(placed, 2, F.size(placed) - 1), lambda a, b: (
                a["h"] == b["h"]) & (words_at(a["i"]) != words_at(b["i"]))), lambda x: x)
            return F.when(shared, by_words(placed)).otherwise(neighbours(placed, lambda a, b: a["h"] == b["h"]))
        return let(let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), by_hash), covered)

    def counted(ws: Column) -> Column:
        return let(_windows(ws), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), zero).otherwise(exact(ws, hs)))
    return F.when(F.size(word_list) > 3, let(word_list, counted)).otherwise(zero)


def much_repeated(word_list: Column) -> Column:
    """Whether the repeated words are more than ``MAX_REPEAT_PERCENT`` of all.

    A window too many covers six words at most, with the one that it repeats,
    so few repeats settle it without sorting.
    """
    def judged(ws: Column) -> Column:
        spare = let(_windows(ws), lambda hs: F.size(hs) - F.size(F.array_distinct(hs)))
        limit = MAX_REPEAT_PERCENT * F.size(ws)
        return F.when(600 * spare <= limit, F.lit(False)).otherwise(100 * repeated_word_count(ws) > limit)
    return F.when(F.size(word_list) > 3, let(word_list, judged)).otherwise(F.lit(False))


def _held(docs: DataFrame, text: str) -> DataFrame:
    held = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    return held.withColumn("_words", words(F.col("_text")))


def counts(text: Column, ws: Column) -> dict[str, Column]:
    """Every count as an expression over a text and its words, computed where it is named."""
    return {
        "n_words": F.size(ws).cast("bigint"), "word_chars": word_chars(text), "n_symbols": symbol_count(text),
        "n_dup_lines": repeated_line_count(text), "n_lines": F.size(_solid_lines(text)).cast("bigint"),
        "n_lettered": F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))).cast("bigint"),
        "n_repeat_words": repeated_word_count(ws), "much_repeated": much_repeated(ws)}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    Null and empty texts have no words and fail. Columns of these names, and
    ``_text`` and ``_words``, are replaced. Rows are neither added nor lost.
    """
    known = counts(F.col("_text"), F.col("_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    counted = _held(docs, text).withColumns({n: known[n] for n in names})
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def cascade_order(docs: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = SAMPLE_ROWS,
                  repeats: int = SAMPLE_REPEATS) -> list[Rule]:
    """``rules`` by share rejected per second on at most ``rows`` rows of at most ``SAMPLE_CHARS`` characters, best first.

    Each row of the sample is judged ``repeats`` times and the time of a pass
    that judges nothing is taken off, so the seconds are those of the rule.
    The sample only sets the order of evaluation, never a verdict.
    """
    # take() looks at as few partitions as hold the rows; a limit would look at all
    taken = docs.select(F.col(text).cast("string").alias("t")).where(F.length("t") <= SAMPLE_CHARS).take(rows)
    if not taken:
        return list(rules)
    sample = _held(docs.sparkSession.createDataFrame(taken, "t string").coalesce(1), "t").withColumn(
        "_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def timed(rejects: Column) -> tuple[float, int]:
        began = time.perf_counter()
        found = sample.agg(F.count_if(rejects)).first()[0]
        return time.perf_counter() - began, found

    known = counts(F.col("_text"), F.col("_words"))
    idle = min(timed(F.size("_words") < 0)[0] for _ in range(2))
    rated = []
    for rule in rules:
        seconds, rejected = timed(rule.rejects(known))
        seconds = max(seconds - idle, 1e-4)
        rated.append((-rejected / seconds, seconds, rule))
    return [rule for *_, rule in sorted(rated, key=lambda r: r[:2])]


def verdict(rules: Sequence[Rule], known: Counts) -> Column:
    """False at the first rule that rejects; later rules are then not evaluated."""
    chain = F.when(rules[0].rejects(known), F.lit(False))
    return reduce(lambda so_far, rule: so_far.when(rule.rejects(known), F.lit(False)), rules[1:], chain).otherwise(F.lit(True))


def keep(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that the base and every rule accept, all in one cascade; rejected rows cost what led to it only."""
    order = cascade_order(docs, [*BASE, *rules], text)
    # one expression: a filter would compute columns below it anew wherever it names them
    shown = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.where(let(shown, lambda t: let(words(t), lambda ws: verdict(order, counts(t, ws)))))


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """:func:`measure` and ``kept``: true where the base holds and no rule rejects.

    Counts that are columns are read by the rules; others are computed where the cascade comes to them.
    """
    measured = measure(docs, text)
    known = counts(F.col("_text"), F.col("_words")) | {n: F.col(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    order = cascade_order(docs, rules, text)
    judged = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(order, known))
    return measured.withColumn("kept", judged).drop("_text", "_words")
