"""A public corpus on disk as the input of the chunker.

Below ``root``: ``corpus_profiles/<id>/manifest.json``, ``documents/catalog.jsonl``,
``documents/normalized/<revision>.md``, ``documents/raw/<snapshot or revision>.md``,
``definitions/catalog.jsonl`` and ``definitions/<id>.md``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import catalog
from . import files

PROFILE = ("corpus_profile_version string, real_snapshot_ids array<string>, shared_document_revision_ids array<string>, "
           "definition_ids array<string>")
DOCUMENT = ("snapshot_id string, document_revision_id string, normalized_sha256 string, raw_sha256 string, "
            "clauses array<struct<clause_id:string,span_start:int,span_end:int>>")
DEFINITION = "definition_id string, content_sha256 string"


def read_profile(spark: SparkSession, root: str, profile_id: str) -> DataFrame:
    path = f"{root}/corpus_profiles/{profile_id}/manifest.json"
    return spark.read.schema(PROFILE).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def _named(files_found: DataFrame, name: str) -> DataFrame:
    return files_found.select(F.regexp_replace("path", r"\.md$", "").alias(name), *[c for c in files_found.columns if c != "path"])


def corpus_sources(spark: SparkSession, root: str, profile_id: str) -> DataFrame:
    """Documents and definitions of a profile with their texts, ready for ``construct_chunks``.

    A definition the catalog does not have, a file that is missing and a raw
    hash that differs are errors. Raw files are read for line ends and hash only.
    """
    profile = read_profile(spark, root, profile_id)
    listed = lambda column, name: profile.select(F.explode(column).alias(name))
    documents = catalog.profile_members(
        files.read_jsonl(spark, f"{root}/documents/catalog.jsonl", DOCUMENT),
        listed("real_snapshot_ids", "snapshot_id"), listed("shared_document_revision_ids", "document_revision_id"))
    texts = _named(files.read_markdown(spark, f"{root}/documents/normalized").select("path", "text"), "document_revision_id")
    documents = catalog.require(documents, texts, ["document_revision_id"], "normalized document")
    raw = _named(files.read_markdown(spark, f"{root}/documents/raw").select("path", F.col("sha256").alias("_raw"), "crlf"), "_name")
    named = documents.withColumn("_name", F.coalesce("snapshot_id", "document_revision_id"))
    differs = F.col("raw_sha256").isNotNull() & F.col("_raw").isNotNull() & (F.col("raw_sha256") != F.col("_raw"))
    documents = named.join(raw, "_name", "left").withColumn("crlf", F.when(differs, F.raise_error(
        F.concat(F.lit("raw hash mismatch: "), "_name")).cast("boolean")).otherwise(F.coalesce("crlf", F.lit(False))))

    known = files.read_jsonl(spark, f"{root}/definitions/catalog.jsonl", DEFINITION)
    # Of repeated ids the last line counts: splits by their offset, lines by
    # their order within a split.
    ordered = known.withColumn("_line", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()))
    definitions = catalog.require(listed("definition_ids", "definition_id").distinct(),
                                  catalog.last_wins(ordered, ["definition_id"], "_line").drop("_line"), ["definition_id"], "definition")
    bodies = _named(files.read_markdown(spark, f"{root}/definitions").select("path", "text"), "definition_id")
    definitions = catalog.require(definitions, bodies, ["definition_id"], "definition file")
    return catalog.sources_of_profile(documents, definitions)
