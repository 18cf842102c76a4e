"""Exact integer and rational arithmetic, and the formulas built on it.

A rational is ``struct<n: bigint, d: bigint>`` in lowest terms with ``d > 0``.
Comparisons cross-multiply as wide decimals; no value passes through a
floating point number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

# Fixed values of the formulas.
REVENUE_FLOOR = 280_000
CHARGE_DIVISOR = 5
ACCEPT_PROGRAM = "bike_partner"
ACCEPT_BELOW = (1, 2)
RATING_ABOVE = (97, 20)


def div(a: Column, b: Column) -> Column:
    """Integer quotient."""
    return F.call_function("div", a, b)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's remainders.

    A pair of numbers needs at most about 1.4405 * log2(smaller) + 2 steps, so
    the fold is only as long as the row needs.
    """
    a, b = F.abs(a.cast("bigint")), F.abs(b.cast("bigint"))
    steps = F.ceil(F.log2(F.least(a, b).cast("double") + 1) * 1.4405).cast("int") + 2

    def step(pair: Column, _: Column) -> Column:
        done = pair["y"] == 0
        return F.struct(
            F.when(done, pair["x"]).otherwise(pair["y"]).alias("x"),
            F.when(done, pair["y"]).otherwise(F.try_mod(pair["x"], pair["y"])).alias("y"),
        )

    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(a.alias("x"), b.alias("y")), step)["x"]


def rational(n: Column | str, d: Column | str) -> Column:
    """Lowest-terms rational; a denominator below one is an error, null stays null."""
    n, d = col(n).cast("bigint"), col(d).cast("bigint")
    valid = F.when(d <= 0, F.raise_error(F.lit("rational denominator must be positive")).cast("bigint")).otherwise(d)
    reduced = F.transform(
        F.array(F.struct(n.alias("n"), valid.alias("d"))),
        lambda r: F.transform(
            F.array(gcd(r["n"], r["d"])),
            lambda g: F.struct(div(r["n"], g).alias("n"), div(r["d"], g).alias("d")),
        )[0],
    )[0]
    return F.when(n.isNotNull() & d.isNotNull(), reduced)


def _times(value: Column, factor: int) -> Column:
    return value.cast("decimal(19,0)") * F.lit(factor).cast("decimal(19,0)")


def less_than(value: Column, bound: tuple[int, int]) -> Column:
    return _times(value["n"], bound[1]) < _times(value["d"], bound[0])


def greater_than(value: Column, bound: tuple[int, int]) -> Column:
    return _times(value["n"], bound[1]) > _times(value["d"], bound[0])


def equal(a: Column, b: Column) -> Column:
    wide = "decimal(19,0)"
    return a["n"].cast(wide) * b["d"].cast(wide) == b["n"].cast(wide) * a["d"].cast(wide)


def revenue_charge(revenue: Column | str) -> Column:
    """A fifth of the shortfall below the floor; a negative revenue is an error."""
    revenue = col(revenue).cast("bigint")
    charge = div(F.greatest(F.lit(REVENUE_FLOOR) - revenue, F.lit(0).cast("bigint")), F.lit(CHARGE_DIVISOR).cast("bigint"))
    return F.when(
        revenue < 0, F.raise_error(F.lit("revenue cannot be negative")).cast("bigint")
    ).when(revenue.isNotNull(), charge)


def auto_accept(program: Column | str, acceptance: Column) -> Column:
    return (col(program) == ACCEPT_PROGRAM) & less_than(acceptance, ACCEPT_BELOW)


def rating_condition(rating: Column) -> Column:
    return greater_than(rating, RATING_ABOVE)


def cancel_rate(cancelled: Column | str, completed: Column | str) -> Column:
    """Share of cancelled among finished; null where nothing finished."""
    c, k = col(cancelled).cast("bigint"), col(completed).cast("bigint")
    total = F.when(
        (c < 0) | (k < 0), F.raise_error(F.lit("counts cannot be negative")).cast("bigint")
    ).otherwise(c + k)
    return rational(c, F.when(total > 0, total))
