"""File and row inventories, their differences, and content digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import identity

DIGEST_FANOUT = 1024


def diff(declared: DataFrame, actual: DataFrame, *, key: str = "path", digest: str = "sha256") -> DataFrame:
    """One row per key with its state: match, missing, unexpected or mismatched."""
    d = declared.select(key, F.col(digest).alias("declared_sha256"))
    a = actual.select(key, F.col(digest).alias("actual_sha256"))
    state = F.when(F.col("actual_sha256").isNull(), "missing").when(
        F.col("declared_sha256").isNull(), "unexpected").when(
        F.col("declared_sha256") != F.col("actual_sha256"), "mismatched").otherwise("match")
    return d.join(a, key, "full_outer").select(key, "declared_sha256", "actual_sha256", state.alias("state"))


def summary(differences: DataFrame) -> DataFrame:
    """Counts per state and the overall status."""
    count = lambda s: F.count_if(F.col("state") == s)
    return differences.agg(
        F.count_if(F.col("state") != "unexpected").alias("declared"),
        F.count_if(F.col("state") != "missing").alias("checked"),
        count("match").alias("matched"), count("missing").alias("missing"),
        count("mismatched").alias("mismatched"), count("unexpected").alias("unexpected"),
    ).withColumn("status", F.when(
        (F.col("matched") == F.col("declared")) & (F.col("unexpected") == 0), "pass").otherwise("fail"))


def ordered_digest(entries: DataFrame, by: list[str], order: str, content: str) -> DataFrame:
    """SHA-256 over the concatenated contents of each group, in key order.

    Only for groups whose size is bounded by what they are, such as the files
    of one release or the blocks of :func:`block_digests`.
    """
    parts = F.array_sort(F.collect_list(F.struct(order, content)))
    joined = F.array_join(F.transform(parts, lambda p: p[content]), "")
    return entries.groupBy(*by).agg(F.sha2(joined, 256).alias("digest"), F.count("*").alias("entries"))


def logical_hash(rows: DataFrame, key: str, canonical: Column, by: list[str]) -> DataFrame:
    """Digest of canonical rows, each ended by a line feed, in key order, per group."""
    lines = rows.select(*by, key, F.concat(canonical, F.lit("\n")).alias("_line"))
    return ordered_digest(lines, by, key, "_line")


def _block(key: Column | str, fanout: int) -> Column:
    """The block of an integer key, rounded down, in integers."""
    k, n = (F.col(key) if isinstance(key, str) else key).cast("bigint"), F.lit(fanout).cast("bigint")
    return F.call_function("div", k, n) - F.when(k % n < 0, 1).otherwise(0)


def block_digests(rows: DataFrame, key: str, canonical: Column, fanout: int = DIGEST_FANOUT) -> DataFrame:
    """Digest of each block of ``fanout`` consecutive keys of a unique integer key.

    Rows are hashed where they lie; only key and hash are shuffled, and a block
    holds at most ``fanout`` of them.
    """
    hashed = rows.select(_block(key, fanout).alias("block"), key,
                         identity.content_hash(canonical).alias("_h"))
    return ordered_digest(hashed, ["block"], key, "_h")


def tree_digest(rows: DataFrame, key: str, canonical: Column, fanout: int = DIGEST_FANOUT, levels: int = 7) -> DataFrame:
    """One digest for a table of any size, as a tree of block digests.

    Seven levels of 1024 cover every 64-bit key (a negative one ends in the block -1); each level shrinks the data
    by up to the fan-out, and no task sees more than ``fanout`` hashes of a block.
    """
    level = block_digests(rows, key, canonical, fanout).withColumnRenamed("entries", "rows")
    for _ in range(levels - 1):
        parent = level.select(_block("block", fanout).alias("parent"), "block", "digest", "rows")
        parts = F.array_sort(F.collect_list(F.struct("block", "digest")))
        joined = F.array_join(F.transform(parts, lambda p: p["digest"]), "")
        level = parent.groupBy("parent").agg(F.sha2(joined, 256).alias("digest"), F.sum("rows").alias("rows")) \
            .withColumnRenamed("parent", "block")
    return level


def keyed_tree_digest(rows: DataFrame, key: str, canonical: Column, digits: int = 4) -> DataFrame:
    """One digest for a table with a unique key of any type, as a tree over the digits of the key's hash.

    A leaf holds the rows whose key hash begins with the same ``digits``
    hexadecimal digits, in the order of the hash; every level above joins at
    most sixteen digests. Choose ``digits`` so that rows / 16^digits fit a task;
    it is part of what the digest means.
    """
    hashed = rows.select(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256).alias("_k"), identity.content_hash(canonical).alias("_h"))
    level = ordered_digest(hashed.withColumn("prefix", F.substring("_k", 1, digits)), ["prefix"], "_k", "_h").withColumnRenamed("entries", "rows")
    for size in range(digits - 1, -1, -1):
        parts = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
        joined = F.array_join(F.transform(parts, lambda p: p["digest"]), "")
        level = level.groupBy(F.substring("prefix", 1, size).alias("parent")).agg(
            F.sha2(joined, 256).alias("digest"), F.sum("rows").alias("rows")).withColumnRenamed("parent", "prefix")
    return level.select("digest", "rows")
