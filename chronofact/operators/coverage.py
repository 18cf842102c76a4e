"""Coverage recipes: which members a scope has, and what follows from them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from ..functions import exact, identity
from .skew import BROADCAST_ROWS, fits_broadcast, lookup_join


def members(recipes: DataFrame, events: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Events inside the scope of each recipe.

    ``recipes``: recipe_key, subject_id, window_start, window_end, source_set.
    ``events``: member_id, subject_id, source_id, event_time, outcome. Windows
    are half open. A subject with very many events is spread over tasks.
    """
    scope = recipes.select("recipe_key", "subject_id", "window_start", "window_end", "source_set")
    fits = fits_broadcast(scope, broadcast_rows)
    pairs = lookup_join(events, scope, ["subject_id"], "inner", small_fits=fits, salt=F.col("member_id"))
    return pairs.where(
        (F.col("window_start") <= F.col("event_time")) & (F.col("event_time") < F.col("window_end"))
        & F.array_contains("source_set", F.col("source_id"))
    ).select("recipe_key", "member_id", "subject_id", "outcome")


def outcomes(recipes: DataFrame, found: DataFrame) -> DataFrame:
    """Members per outcome; an empty scope keeps its row with zero members."""
    counted = found.groupBy("recipe_key", "outcome").agg(F.count("*").alias("members"))
    return recipes.select("recipe_key").join(counted, "recipe_key", "left").select(
        "recipe_key", "outcome", F.coalesce("members", F.lit(0).cast("bigint")).alias("members"))


#: The member digest of an empty scope: the content hash of an empty list.
EMPTY_DIGEST = hashlib.sha256(b"[]\n").hexdigest()


def digests(recipes: DataFrame, found: DataFrame) -> DataFrame:
    """Member and content digest of each recipe, and the id of its artifact.

    The member digest is a tree: members fall into buckets by their hash, each
    bucket hashes its members in order, and the digest hashes the buckets in
    order, so a scope of any number of members is hashed in parts. The content
    digest includes the scope, so two empty scopes share the member digest and
    differ in content and artifact id.
    """
    hashed = found.select("recipe_key", F.sha2(F.col("member_id").cast("string"), 256).alias("_h"))
    bucket = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    parts = hashed.groupBy("recipe_key", bucket.alias("_b")).agg(
        F.count("*").alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_d"))
    whole = parts.groupBy("recipe_key").agg(
        F.sum("_n").alias("members"), F.array_sort(F.collect_list(F.struct("_b", "_d"))).alias("_l"))
    listed = F.array_join(F.transform("_l", lambda p: p["_d"]), "")
    joined = recipes.join(whole, "recipe_key", "left").withColumns({
        "members": F.coalesce("members", F.lit(0).cast("bigint")),
        "members_digest": F.when(F.col("_l").isNull(), EMPTY_DIGEST).otherwise(F.sha2(listed, 256))})
    content = identity.content_hash(identity.canonical_row({
        "members_digest": F.col("members_digest"),
        "source_set": F.array_join(F.array_sort("source_set"), ","),
        "subject_id": F.col("subject_id").cast("string"),
        "window_end": F.col("window_end").cast("string"), "window_start": F.col("window_start").cast("string"),
    }))
    return joined.withColumn("content_digest", content).select(
        "recipe_key", "members", "members_digest", "content_digest",
        identity.stable_id("coverage_artifact", F.col("content_digest")).alias("artifact_id"))


def recipe_violations(recipes: DataFrame, events: DataFrame, registered: DataFrame) -> DataFrame:
    """Recipes that break their contract: a row per recipe, rule and, for sources, source.

    A recipe must be registered with the same subject, window and sources; its
    window must have bounds and not be one that merely spans what was observed
    (``bounds``, where there is such a column, must be ``half-open``); and
    every source it names must have delivered something. Nulls break the rule.
    """
    known = registered.select("recipe_key", F.lit(True).alias("_known"), F.col("subject_id").alias("_subject"),
                              F.col("window_start").alias("_start"), F.col("window_end").alias("_end"),
                              F.array_sort(F.array_distinct("source_set")).alias("_sources"))
    rows = recipes.join(known, "recipe_key", "left")
    here, sources = F.col("_known").isNotNull(), F.coalesce("source_set", F.array().cast("array<string>"))
    checks = {
        "recipe is not registered": ~here,
        "subject differs": here & ~F.col("subject_id").eqNullSafe(F.col("_subject")),
        "window starts late": here & ~F.coalesce(F.col("window_start") <= F.col("_start"), F.lit(False)),
        "window ends early": here & ~F.coalesce(F.col("window_end") >= F.col("_end"), F.lit(False)),
        "window is wider": here & ((F.col("window_start") < F.col("_start")) | (F.col("window_end") > F.col("_end"))),
        "window is empty": ~F.coalesce(F.col("window_start") < F.col("window_end"), F.lit(False)),
        "no source is named": F.size(sources) == 0,
        "sources differ": here & ~F.array_sort(F.array_distinct(sources)).eqNullSafe(F.col("_sources")),
    }
    if "bounds" in recipes.columns:
        checks["window is not declared half-open"] = ~F.col("bounds").eqNullSafe(F.lit("half-open"))
    failed = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks.items()]))
    own = rows.select("recipe_key", F.explode(failed).alias("violation"), F.lit(None).cast("string").alias("source_id"))
    delivered = events.select(F.col("source_id").cast("string").alias("source_id")).distinct()
    named = recipes.select("recipe_key", F.explode(F.array_distinct("source_set")).alias("source_id"))
    silent = named.join(delivered, "source_id", "left_anti").select("recipe_key", F.lit("source delivered nothing").alias("violation"), "source_id")
    return own.unionByName(silent)


def cancel_rates(requests: DataFrame, recipes: DataFrame, found: DataFrame) -> DataFrame:
    """Exact cancel rate per requested recipe.

    Without a recipe the status is ``missing_coverage`` and there is no value.
    With one it is ``complete``; the value is null when no member finished.
    """
    counts = found.groupBy("recipe_key").agg(
        F.count("*").alias("enumerated_members"),
        F.count_if(F.col("outcome") == "cancelled").alias("c"), F.count_if(F.col("outcome") == "completed").alias("k"))
    covered = recipes.select("recipe_key", F.lit(True).alias("_covered"))
    zero = F.lit(0).cast("bigint")
    rows = requests.select("recipe_key").join(covered, "recipe_key", "left").join(counts, "recipe_key", "left")
    rate = exact.cancel_rate(F.coalesce("c", zero), F.coalesce("k", zero))
    return rows.withColumn("_r", rate).select(
        "recipe_key", F.when(F.col("_covered"), "complete").otherwise("missing_coverage").alias("status"),
        F.coalesce("enumerated_members", zero).alias("enumerated_members"),
        F.when(F.col("_covered"), F.col("_r.n")).alias("rate_n"), F.when(F.col("_covered"), F.col("_r.d")).alias("rate_d"))
