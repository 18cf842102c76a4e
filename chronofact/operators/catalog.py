"""Source catalogs: profile membership and last-wins look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def profile_members(catalog: DataFrame, real_snapshots: DataFrame, shared_revisions: DataFrame) -> DataFrame:
    """Catalog rows whose snapshot or revision the profile names.

    One row per catalog row: two left joins on distinct ids, one OR.
    """
    real = real_snapshots.select("snapshot_id").distinct().withColumn("_real", F.lit(True))
    shared = shared_revisions.select("document_revision_id").distinct().withColumn("_shared", F.lit(True))
    flagged = catalog.join(real, "snapshot_id", "left").join(shared, "document_revision_id", "left")
    return flagged.where(F.coalesce("_real", F.lit(False)) | F.coalesce("_shared", F.lit(False))).select(
        *catalog.columns)


def sources_of_profile(documents: DataFrame, definitions: DataFrame) -> DataFrame:
    """Documents and definitions as one input of the chunker."""
    docs = documents.withColumns({
        "kind": F.lit("document"), "source_id": F.coalesce("snapshot_id", "document_revision_id")})
    defs = definitions.withColumns({
        "kind": F.lit("definition"), "source_id": F.col("definition_id"), "document_revision_id": F.col("definition_id"),
        "normalized_sha256": F.col("content_sha256")})
    wanted = ["kind", "source_id", "document_revision_id", "text", "normalized_sha256", "raw_sha256", "crlf", "clauses"]
    return docs.select(*[c for c in wanted if c in docs.columns]).unionByName(
        defs.select(*[c for c in wanted if c in defs.columns]), allowMissingColumns=True)


def last_wins(catalog: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``.

    An aggregation, not a window: copies of one key combine before the shuffle.
    """
    rest = [c for c in catalog.columns if c not in key]
    best = catalog.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def require(requested: DataFrame, catalog: DataFrame, key: list[str], what: str) -> DataFrame:
    """Inner look-up in which an unknown key is an error, not a dropped row."""
    marked = catalog.withColumn("_hit", F.lit(True))
    found = requested.join(marked, key, "left")
    named = F.concat(F.lit(f"unknown {what}: "), F.concat_ws("/", *key))
    # The checked flag is filtered on, so the check cannot be pruned away.
    ok: Column = F.when(F.col("_hit").isNull(), F.raise_error(named).cast("boolean")).otherwise(F.lit(True))
    return found.where(ok).drop("_hit")
