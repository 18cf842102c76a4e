"""Comparison of two tables by stored digest trees.

Each table is written once as key and row digest, dealt by the hash of the
key, with the digests of all blocks at every level beside it. A comparison
descends from the root: only below blocks that differ is the next level read,
and only there are rows joined. Equal tables cost one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import identity
from .inventory import ordered_digest
from .skew import fits_broadcast

#: Hexadecimal digits of a block of the first level, which is a partition on disk.
TOP = 2
#: Hexadecimal digits of a leaf; choose it so that rows / 16^LEAF fit a task. Both trees must agree.
LEAF = 4


def _top(place: str) -> Column:
    """The first digits behind a letter, so that no partition looks like a number."""
    return F.concat(F.lit("b"), F.substring(place, 1, TOP))


def write_tree(rows: DataFrame, path: str, key: str, canonical: Column, leaf: int = LEAF) -> None:
    """Store ``rows`` below ``path`` as a digest tree; ``canonical`` is the text of a row that is compared.

    Null keys are a key. Rows that repeat a key are compared together.
    """
    spark = rows.sparkSession
    place = F.sha2(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), 256)
    hashed = rows.select(F.col(key).alias("key"), place.alias("place"), identity.content_hash(canonical).alias("content"))
    one = hashed.groupBy("place", "key").agg(F.array_sort(F.collect_list("content")).alias("all")).select(
        "key", "place", F.when(F.size("all") == 1, F.element_at("all", 1)).otherwise(F.sha2(F.array_join("all", ""), 256)).alias("content"))
    placed = one.withColumns({"leaf": F.substring("place", 1, leaf), "top": _top("place")})
    # an empty table leaves its key's type here
    placed.select("key", "place", "content", "leaf", "top").limit(0).write.parquet(f"{path}/kind")
    placed.hint("rebalance", "top").sortWithinPartitions("top", "leaf", "place").write.partitionBy("top").parquet(f"{path}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    level = ordered_digest(stored.select("leaf", "place", F.concat("place", "content").alias("content")), ["leaf"], "place", "content") \
        .withColumnRenamed("leaf", "prefix").select("prefix", "digest")
    for digits in (leaf, TOP, 0):
        if digits < leaf:
            level = ordered_digest(level.withColumn("up", F.substring("prefix", 1, digits)), ["up"], "prefix", "digest").select(
                F.col("up").alias("prefix"), "digest")
        out = f"{path}/level_{'leaf' if digits == leaf else digits}"
        level.write.parquet(out)
        level = spark.read.parquet(out)


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    other = right.withColumnRenamed("digest", "_other")
    return left.join(other, "prefix", "full_outer").where(~F.col("digest").eqNullSafe(F.col("_other"))).select("prefix")


def differences(spark: SparkSession, left: str, right: str) -> DataFrame:
    """``key, state`` where the trees at ``left`` and ``right`` differ: ``lost``, ``added`` or ``changed``.

    At most 16^TOP block names pass through the driver.
    """
    def level(path: str, name: object) -> DataFrame:
        return spark.read.schema("prefix string, digest string").parquet(f"{path}/level_{name}")

    blocks = []
    if _differing(level(left, 0), level(right, 0)).take(1):
        blocks = [r["prefix"] for r in _differing(level(left, TOP), level(right, TOP)).collect()]
    tops = [f"b{b}" for b in blocks]
    inside = _top("prefix").isin(tops) if blocks else F.lit(False)
    leaves = _differing(level(left, "leaf").where(inside), level(right, "leaf").where(inside)).withColumnRenamed("prefix", "leaf")
    small = fits_broadcast(leaves)

    def rows(path: str, name: str) -> DataFrame:
        found = spark.read.schema(spark.read.parquet(f"{path}/kind").schema).parquet(f"{path}/rows").where(F.col("top").isin(tops) if blocks else F.lit(False))
        kept = found.join(F.broadcast(leaves) if small else leaves, "leaf", "left_semi")
        return kept.select("place", F.col("key").alias(f"_{name}_key"), F.col("content").alias(f"_{name}"))

    both = rows(left, "left").join(rows(right, "right"), "place", "full_outer")
    state = F.when(F.col("_right").isNull(), "lost").when(F.col("_left").isNull(), "added").otherwise("changed")
    return both.where(~F.col("_left").eqNullSafe(F.col("_right"))).select(
        F.when(F.col("_left").isNull(), F.col("_right_key")).otherwise(F.col("_left_key")).alias("key"), state.alias("state"))
