"""JSON lines, file inventories and Markdown scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import identity


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed JSON lines; empty lines are skipped and a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Canonical JSON lines. With ``order`` the part files are globally sorted in name order."""
    rows = df.orderBy(*order) if order else df
    whole = F.struct(*df.columns)
    dtype = T.StructType(list(df.schema.fields))
    rows.select(identity.canonical_json(whole, dtype).alias("value")).write.mode("errorifexists").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """A DataFrame of exactly one row as one canonical JSON document."""
    if df.limit(2).count() != 1:
        raise ValueError("a JSON document is exactly one row")
    write_jsonl(df.coalesce(1), path)


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path below ``root``, length, SHA-256 and bytes of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/")
    marker = base[base.index(":") + 1:] if ":" in base else base
    below = F.substring_index(F.col("path"), marker.rstrip("/") + "/", -1)
    return files.select(below.alias("path"), "length", F.sha2("content", 256).alias("sha256"), "content")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    return scan_files(spark, root).select("path", "sha256")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files with exact text: line ends stay as they are in the bytes."""
    files = scan_files(spark, root, "*.md")
    return files.select("path", "sha256", F.decode("content", "UTF-8").alias("text"),
                        F.contains(F.decode("content", "UTF-8"), F.lit("\r\n")).alias("crlf"))


def safe_member(name: Column | str) -> Column:
    """Whether an archive member name stays inside the target folder."""
    path = F.replace(F.col(name) if isinstance(name, str) else name, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return ~(path.startswith("/") | (F.size(parts) == 0) | F.array_contains(parts, "..")
             | F.coalesce(F.get(parts, F.lit(0)).endswith(":"), F.lit(False)))


def base_name(name: Column | str) -> Column:
    path = F.replace(F.col(name) if isinstance(name, str) else name, F.lit("\\"), F.lit("/"))
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def is_markdown(name: Column | str) -> Column:
    return F.lower(base_name(name)).rlike(r"[^.].*\.md$")


def numeric_prefix(name: Column | str) -> Column:
    """Leading number of ``NN_rest``; null when there is none."""
    return F.try_to_number(F.substring_index(base_name(name), "_", 1), F.lit("999999999")).cast("int")
