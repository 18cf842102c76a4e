"""Markdown archives: member scan, checks and a verified members table."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import inventory
from ..session import scratch_path, scratch_scope
from . import files

# What a complete source archive holds.
MEMBER_COUNT = 225
AGGREGATE_NAME = "00_Tong_hop_Tat_ca_Chinh_sach_Tin_tuc.md"
AUDITED_ARTICLES = (154, 151, 5, 23, 172, 26)

_MEMBER = "archive string, archive_sha256 string, member string, is_dir boolean, content binary"


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, digest, content in zip(batch["path"], batch["sha256"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as source:
                for info in source.infolist():
                    yield pd.DataFrame({
                        "archive": [path], "archive_sha256": [digest], "member": [info.filename],
                        "is_dir": [info.is_dir()], "content": [b"" if info.is_dir() else source.read(info)]})


def members(spark: SparkSession, root: str, pattern: str = "*.zip") -> DataFrame:
    """One row per member of every archive below ``root``; archives are read in parallel."""
    scanned = files.scan_files(spark, root, pattern)
    return scanned.select("path", "sha256", "content").mapInPandas(_unzip, _MEMBER)


def markdown(member_rows: DataFrame) -> DataFrame:
    """The Markdown members with base name, numeric prefix and hash."""
    return member_rows.where(~F.col("is_dir") & files.is_markdown("member")).select(
        "archive", "archive_sha256", files.base_name("member").alias("name"),
        files.numeric_prefix("member").alias("prefix"), F.sha2("content", 256).alias("sha256"), "content")


def violations(member_rows: DataFrame, expected_sha256: str | None = None) -> DataFrame:
    """(archive, violation): unsafe paths, duplicate names, bad or missing prefixes, no aggregate."""
    unsafe = member_rows.where(~files.safe_member("member")).select("archive", F.lit("a member's path leaves the archive").alias("violation"))
    md = markdown(member_rows)
    twice = md.groupBy("archive", "name").count().where("count > 1").select(
        "archive", F.lit("two Markdown members share a name").alias("violation"))
    invalid = md.where("prefix is null").select("archive", F.lit("a Markdown member without a number").alias("violation"))
    totals = member_rows.groupBy("archive", "archive_sha256").agg(F.count("*").alias("_all")).join(
        md.groupBy("archive").agg(
            F.count("*").alias("n"), F.countDistinct("prefix").alias("d"), F.min("prefix").alias("lo"),
            F.max("prefix").alias("hi"), F.bool_or(F.col("name") == AGGREGATE_NAME).alias("agg")), "archive", "left")
    complete = (F.col("n") == MEMBER_COUNT) & (F.col("d") == MEMBER_COUNT) & (F.col("lo") == 0) & (F.col("hi") == MEMBER_COUNT - 1)
    partial = totals.where(~F.coalesce(complete, F.lit(False))).select(
        "archive", F.lit("the numbers 00 to 224 are not all there once").alias("violation"))
    lacking = totals.where(~F.coalesce("agg", F.lit(False))).select(
        "archive", F.lit("the collected file is not there").alias("violation"))
    found = unsafe.unionByName(twice).unionByName(invalid).unionByName(partial).unionByName(lacking)
    if expected_sha256 is not None:
        found = found.unionByName(totals.where(F.col("archive_sha256") != expected_sha256).select(
            "archive", F.lit("the archive is not the pinned one").alias("violation")))
    return found.distinct()


def article_counts(md: DataFrame, audited: tuple[int, ...] = AUDITED_ARTICLES) -> DataFrame:
    """Individual articles, excluded aggregates and audited articles per archive."""
    article = F.col("name") != AGGREGATE_NAME
    return md.groupBy("archive").agg(
        F.count_if(article).alias("real_articles"), F.count_if(~article).alias("aggregate_excluded"),
        F.count_if(article & F.col("prefix").isin(*audited)).alias("audited"))


def member_digest(md: DataFrame) -> DataFrame:
    """Digest per archive over name, NUL, hash and line feed, in prefix order."""
    line = F.concat("name", F.lit("\u0000"), "sha256", F.lit("\n"))
    return inventory.ordered_digest(md.select("archive", "prefix", line.alias("_line")), ["archive"], "prefix", "_line")


def differing(written: DataFrame) -> DataFrame:
    """Written members whose bytes do not have their declared hash."""
    return written.where(F.sha2("content", 256) != F.col("sha256"))


def materialize(spark: SparkSession, root: str, output: str, expected_sha256: str, pattern: str = "*.zip") -> DataFrame:
    """Check the pinned archive, then write its Markdown members as a table.

    The table is written beside its place, its bytes are hashed again, and only
    then does a rename make it visible; an existing target is refused. Returns
    one report row per archive. The error names every kind of violation;
    :func:`violations` has the archives.
    """
    with scratch_scope(spark) as scope:
        try:
            return _materialized(spark, _once(members(spark, root, pattern)), root, output, expected_sha256, pattern)
        finally:
            scope.release()


def _once(member_rows: DataFrame) -> DataFrame:
    """The members stored, so that checks and copies do not unzip the archives again."""
    path = scratch_path(member_rows.sparkSession, "members")
    member_rows.write.parquet(path)
    return member_rows.sparkSession.read.schema(member_rows.schema).parquet(path)


def _materialized(spark: SparkSession, rows: DataFrame, root: str, output: str, expected_sha256: str, pattern: str) -> DataFrame:
    broken = violations(rows, expected_sha256).select("violation").distinct().collect()
    if broken:
        raise ValueError("; ".join(sorted(b["violation"] for b in broken)))
    if rows.limit(1).count() == 0:
        raise FileNotFoundError(f"missing pinned source archive: {root}/{pattern}")
    place = spark._jvm.org.apache.hadoop.fs.Path(output)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(place):
        raise FileExistsError(f"{output} already exists")
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{output.rstrip('/')}.{uuid.uuid4().hex}")
    try:
        markdown(rows).write.parquet(beside.toString())
        if differing(spark.read.parquet(beside.toString())).limit(1).count():
            raise OSError("the written bytes are not those of the archive")
        if not store.rename(beside, place):
            raise OSError(f"{output} could not be put in place")
    finally:
        store.delete(beside, True)
    written = spark.read.parquet(output)
    digest = member_digest(written).select("archive", F.col("digest").alias("member_digest"))
    return written.groupBy("archive", "archive_sha256").agg(
        F.count("*").alias("markdown_files"),
        F.count_if(F.col("name") != AGGREGATE_NAME).alias("individual_articles"),
        F.count_if(F.col("name") == AGGREGATE_NAME).alias("aggregate_files"),
    ).join(digest, "archive").withColumn("status", F.lit("pass"))
