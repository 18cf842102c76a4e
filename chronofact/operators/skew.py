"""Joins and ordered look-ups that hold when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
ROWS_PER_SLICE = 2_000_000
SALTS = 64
#: Rows of one bucket of keys that one task may handle alone; only keys of larger buckets are salted or cut.
HOT_ROWS = 500_000
KEY_BUCKETS = 1 << 14
#: The slice of null instants, which sort before all others.
NULL_SLICE = -1


def content_size(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value of this type holds, nested content included.

    A type whose content cannot be measured is an error.
    """
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType,
                           T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return F.lit(16).cast("bigint")
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
            size = F.size(value) * 16
        else:
            size = F.aggregate(value, F.lit(0).cast("bigint"), lambda total, x: total + content_size(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        size = (content_size(F.map_keys(value), T.ArrayType(kind.keyType))
                + content_size(F.map_values(value), T.ArrayType(kind.valueType)))
    elif isinstance(kind, T.StructType):
        size = reduce(lambda a, b: a + b, [content_size(value.getField(f.name), f.dataType) for f in kind.fields], F.lit(0))
    else:
        raise TypeError(f"the size of {kind.simpleString()} cannot be measured")
    return F.coalesce(size.cast("bigint"), F.lit(0)) + 16


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is proven small: at most ``rows`` rows and ``size`` bytes of content.

    ``df`` is computed up to the limit of rows in each partition; hand over a
    stored table where that is costly.
    """
    width = reduce(lambda a, b: a + b, [content_size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(0))
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width.cast("bigint")).alias("b")).first()
    return got["n"] <= rows and (got["b"] or 0) <= size


def _key_bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int")


def hot_buckets(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """The buckets of ``keys`` with more than ``hot_rows`` rows; a key with that many rows lies in one of them.

    One pass that moves at most :data:`KEY_BUCKETS` counts from each task.
    """
    counted = df.groupBy(_key_bucket(keys).alias("_bucket")).count().where(F.col("count") > hot_rows)
    return [r["_bucket"] for r in counted.collect()]


def _is_hot(keys: Sequence[str], hot: Sequence[int]) -> Column:
    return _key_bucket(keys).isin(list(hot))


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str, *, small_fits: bool,
                salt: Column, salts: int = SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join on keys that may be very uneven in ``big``.

    A side proven small is broadcast and ``big`` does not move. Otherwise the
    rows of ``big`` with a hot key are spread over ``salts`` shuffle keys by
    ``salt``, and only the rows of ``small`` with such a key are repeated. ``big`` is
    read once more to find them, so hand over a stored table where it is costly.
    """
    if small_fits:
        return big.join(F.broadcast(small), list(on), how)
    hot = hot_buckets(big, on, hot_rows)
    if not hot:
        return big.join(small, list(on), how)
    same = _same_types(big, small, on)
    one = F.lit(0)
    spread = big.withColumn("_salt", F.when(_is_hot(on, hot), F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int")).otherwise(one))
    repeated = same.withColumn("_salt", F.explode(F.when(_is_hot(on, hot), F.sequence(one, F.lit(salts - 1))).otherwise(F.array(one))))
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")


def _same_types(big: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """``small`` with its keys in the types of ``big``, since equal numbers of different types differ in hash."""
    return small.withColumns({c: F.col(c).try_cast(big.schema[c].dataType) for c in on if big.schema[c].dataType != small.schema[c].dataType})


def slice_bounds(df: DataFrame, by: str, rows_per_slice: int = ROWS_PER_SLICE, keys: Sequence[str] = (),
                 hot_rows: int = HOT_ROWS) -> list[float]:
    """Split points of ``by``, approximate quantiles over all rows.

    Between two points lie about ``rows_per_slice`` rows whichever keys they
    belong to, so a window over (key, slice) is bounded however large the key
    is. Compute them once from a stored table and hand them to every operator
    that orders by the same instant; counting a stored table reads metadata only.
    With ``keys`` there are none where no key has so many rows that its history must be cut.
    """
    wanted = -(-df.count() // rows_per_slice)
    if wanted <= 1 or (keys and not hot_buckets(df, keys, hot_rows)):
        return []
    shares = [i / wanted for i in range(1, wanted)]
    keyed = df.select(_number(df, by).alias("_by"))
    return sorted(set(keyed.approxQuantile("_by", shares, 1 / (4 * wanted))))


def _number(df: DataFrame, by: str) -> Column:
    instant = isinstance(df.schema[by].dataType, (T.TimestampType, T.TimestampNTZType))
    return (F.unix_micros(F.col(by).cast("timestamp")) if instant else F.col(by)).cast("double")


def with_slices(df: DataFrame, by: str, bounds: Sequence[float]) -> DataFrame:
    """Add ``_slice``, the order-preserving bucket of ``by`` between ``bounds``; nulls come first."""
    if not bounds:
        return df.withColumn("_slice", F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    numbered = df.withColumn("_by", _number(df, by))
    bucketed = Bucketizer(splits=splits, inputCol="_by", outputCol="_bucket", handleInvalid="keep").transform(numbered)
    sliced = F.when(F.col("_by").isNull(), NULL_SLICE).otherwise(F.col("_bucket").cast("int"))
    return bucketed.withColumn("_slice", sliced).drop("_by", "_bucket")


def _neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
               bounds: Sequence[float], backwards: bool, hot_rows: int) -> DataFrame:
    names = list(values)
    valued = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    hot = hot_buckets(df, keys, hot_rows) if bounds else []
    sorting = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    if not hot:
        found, inside = valued, W.partitionBy(*keys).orderBy(*sorting)
    else:
        # A row at the head of each slice carries what the slices before it end with, so the rows themselves move once.
        sliced = with_slices(valued, order[0], bounds).withColumn("_hot", _is_hot(keys, hot))
        cut = sliced.withColumn("_slice", F.when(F.col("_hot"), F.col("_slice")).otherwise(0))
        position = F.struct(*[F.col(c) for c in order])
        pick = F.min_by if backwards else F.max_by
        ends = cut.where("_hot").groupBy(*keys, "_slice").agg(*[
            pick(F.col(f"_v_{k}"), F.when(F.col(f"_v_{k}").isNotNull(), position)).alias(f"_end_{k}") for k in names])
        slice_order = F.col("_slice").desc() if backwards else F.col("_slice").asc()
        across = W.partitionBy(*keys).orderBy(slice_order).rowsBetween(W.unboundedPreceding, -1)
        heads = ends.select(*keys, "_slice", F.lit(0).alias("_real"), *[
            F.last(f"_end_{k}", ignorenulls=True).over(across).alias(f"_v_{k}") for k in names])
        found = cut.drop("_hot").withColumn("_real", F.lit(1)).unionByName(heads, allowMissingColumns=True)
        inside = W.partitionBy(*keys, "_slice").orderBy("_real", *sorting)
    inside = inside.rowsBetween(W.unboundedPreceding, -1)
    looked = found.withColumns({f"_in_{k}": F.last(f"_v_{k}", ignorenulls=True).over(inside) for k in names})
    rows = looked.where("_real = 1") if hot else looked
    return rows.withColumns({k: F.col(f"_in_{k}") for k in names}).drop(
        "_slice", "_real", *[f"_v_{k}" for k in names], *[f"_in_{k}" for k in names])


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                bounds: Sequence[float] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add, per row, the last non-null value strictly before it within its key.

    ``order`` must be total within a key; null keys are one key and null
    instants come before all others, with and without bounds. ``bounds`` are :func:`slice_bounds` of the first order column. They cut
    the keys of buckets with more than ``hot_rows`` rows: within a
    slice a window answers; the values at the slice ends, one row per key and
    slice, carry over to later slices. Without such keys one window does it all.
    """
    return _neighbour(df, keys, order, values, bounds, False, hot_rows)


def first_after(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                bounds: Sequence[float] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add, per row, the first non-null value strictly after it within its key."""
    return _neighbour(df, keys, order, values, bounds, True, hot_rows)


def number_rows(df: DataFrame, by: str, bounds: Sequence[float] = (), name: str = "row_no") -> DataFrame:
    """Add ``name``, the place from 0 of each row in the order of ``by``, nulls first; equal values share no place.

    A window inside each slice between ``bounds`` counts on from the rows of
    the slices before, of which there are as many as slices.
    """
    sliced = with_slices(df, by, bounds) if bounds else df.withColumn(
        "_slice", F.when(F.col(by).isNull(), NULL_SLICE).otherwise(0))
    sizes = {r["_slice"]: r["count"] for r in sliced.groupBy("_slice").count().collect()}
    before, start = [], 0
    for at in sorted(sizes):
        before += [F.lit(at), F.lit(start).cast("bigint")]
        start += sizes[at]
    inside = F.row_number().over(W.partitionBy("_slice").orderBy(F.col(by).asc_nulls_first()))
    offset = F.create_map(*before)[F.col("_slice")] if before else F.lit(0).cast("bigint")
    return sliced.withColumn(name, offset + inside - 1).drop("_slice")
