"""Offline evaluation: recall, selection loss, traces, latency, formulas on facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from ..functions import exact


def attribute_support(atoms: DataFrame, candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """Each required support atom with whether it was available, found and selected.

    ``atoms``: query_id, role, modality, evidence_id, available. The others:
    query_id, evidence_id.
    """
    keys = ["query_id", "evidence_id"]
    flag = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    no = F.lit(False)
    return atoms.join(flag(candidates, "_c"), keys, "left").join(flag(selected, "_s"), keys, "left").select(
        *atoms.columns, F.coalesce("_c", no).alias("in_candidates"), F.coalesce("_s", no).alias("in_selected"))


def query_completeness(attributed: DataFrame) -> DataFrame:
    """Per query: completeness at each stage and the earliest stage that lost evidence.

    Stages in order: intentionally_unavailable, missing_from_candidates,
    selection_dropped_required_evidence, none.
    """
    hidden = ~F.col("available")
    lost = F.col("available") & ~F.col("in_candidates")
    dropped = F.col("in_candidates") & ~F.col("in_selected")
    grouped = attributed.groupBy("query_id").agg(
        F.count("*").alias("atoms"), F.count_if(hidden).alias("unavailable"), F.count_if(lost).alias("missing"),
        F.count_if(dropped).alias("dropped"), F.bool_and("in_candidates").alias("candidate_complete"),
        F.bool_and(F.col("in_candidates") & F.col("in_selected")).alias("selected_complete"))
    stage = F.when(F.col("unavailable") > 0, "intentionally_unavailable").when(
        F.col("missing") > 0, "missing_from_candidates").when(
        F.col("dropped") > 0, "selection_dropped_required_evidence").otherwise("none")
    loss = F.col("candidate_complete") & ~F.col("selected_complete")
    return grouped.withColumns({"selection_loss": loss, "earliest_failing_stage": stage})


def missing_roles(attributed: DataFrame) -> DataFrame:
    """Per query and role, how many required atoms were lost and where: one row per reason."""
    reason = F.when(~F.col("available"), "intentionally_unavailable").when(~F.col("in_candidates"), "missing_from_candidates").otherwise(
        "selection_dropped_required_evidence")
    lost = attributed.where(~(F.col("available") & F.col("in_candidates") & F.col("in_selected")))
    return lost.groupBy("query_id", "role", reason.alias("reason")).agg(F.count("*").alias("atoms"))


def modality_recall(attributed: DataFrame) -> DataFrame:
    """Exact recall fractions per modality."""
    return attributed.groupBy("modality").agg(
        F.count("*").alias("required"), F.count_if("in_candidates").alias("candidate_hits"),
        F.count_if(F.col("in_candidates") & F.col("in_selected")).alias("selected_hits"),
    ).withColumns({
        "candidate_recall": F.round(F.col("candidate_hits") / F.col("required"), 9),
        "selected_recall": F.round(F.col("selected_hits") / F.col("required"), 9),
    })


def terminal_traces(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Exactly one trace per query; a query without a result keeps its row."""
    return queries.select("query_id").join(results, "query_id", "left").withColumn(
        "runtime_status", F.coalesce("runtime_status", F.lit("no_result")))


def stage_traces(queries: DataFrame, stages: Mapping[str, DataFrame], limits: Mapping[str, int] | None = None) -> DataFrame:
    """One terminal trace per query with what each stage had for it.

    ``stages`` names frames that have ``query_id``; their rows are tagged, put
    into one union and counted once per query, so no stage is computed twice.
    ``limits`` names the most rows a stage may give a query: a stage that gave
    as many may have lost some, which ``truncated`` says and ``<stage>_limit``
    shows. A query without any row is ``no_result``.
    """
    limits = limits or {}
    tagged = reduce(DataFrame.unionByName, [rows.select("query_id", F.lit(name).alias("_stage")) for name, rows in stages.items()])
    counted = tagged.groupBy("query_id").agg(*[F.count_if(F.col("_stage") == name).alias(f"{name}_count") for name in stages])
    zero = F.lit(0).cast("bigint")
    counts = {f"{name}_count": F.coalesce(f"{name}_count", zero) for name in stages}
    full = reduce(lambda a, b: a | b, [F.coalesce(f"{n}_count", zero) >= most for n, most in limits.items()], F.lit(False))
    seen = reduce(lambda a, b: a | b, [c > 0 for c in counts.values()])
    return queries.select("query_id").join(counted, "query_id", "left").select(
        "query_id", *[c.alias(n) for n, c in counts.items()], *[F.lit(most).cast("bigint").alias(f"{n}_limit") for n, most in limits.items()],
        full.alias("truncated"), F.when(seen, "completed_retrieval").otherwise("no_result").alias("runtime_status"))


def with_run_totals(traces: DataFrame, stages: Sequence[str]) -> tuple[DataFrame, Observation]:
    """``traces`` and the totals of the run, counted beside whatever action reads the traces first."""
    totals = Observation()
    watched = traces.observe(totals, F.count("*").alias("queries"), F.count_if(F.col("runtime_status") == "no_result").alias("no_result"),
                             F.count_if("truncated").alias("truncated"), *[F.sum(f"{n}_count").alias(n) for n in stages])
    return watched, totals


#: Durations in a range of the latency histogram.
TICKS = 1_024


def latency_statistics(timings: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Count, sum, extremes and nearest-rank percentiles per stage.

    ``timings``: stage, ticks (integer durations). Equal durations are counted
    first, then ranges of ``TICKS`` durations: a window over ranges and one
    inside each range find the ranks, so neither sees all of a stage.
    """
    histogram = timings.groupBy("stage", "ticks").agg(F.count("*").alias("n")).withColumn("_range", F.floor(F.col("ticks") / TICKS))
    ranges = histogram.groupBy("stage", "_range").agg(F.sum("n").alias("_n"))
    earlier = W.partitionBy("stage").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    placed = ranges.select("stage", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    totals = ranges.groupBy("stage").agg(F.sum("_n").alias("denominator"))
    inside = F.sum("n").over(W.partitionBy("stage", "_range").orderBy("ticks"))
    ranked = (histogram.withColumn("_inside", inside).join(placed, ["stage", "_range"]).join(totals, "stage")
              .withColumn("upto", F.col("_before") + F.col("_inside")))
    pick = {
        f"p{round(p * 100)}_ticks": F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("denominator")), F.col("ticks")))
        for p in shares
    }
    return ranked.groupBy("stage", "denominator").agg(
        F.sum(F.col("ticks") * F.col("n")).alias("total_ticks"), F.min("ticks").alias("min_ticks"),
        F.max("ticks").alias("max_ticks"), *[c.alias(n) for n, c in pick.items()])


def revenue_case(day: DataFrame, revenue: DataFrame, keys: list[str]) -> DataFrame:
    """Revenue charge per subject, read only when the subject operated that day.

    Both inputs are results of ``select_fact`` with a typed ``value`` column:
    boolean for ``day``, integer for ``revenue``.
    """
    d = day.select(*keys, F.col("status").alias("_ds"), F.col("value").alias("_dv"))
    r = revenue.select(*keys, F.col("status").alias("_rs"), F.col("value").alias("_rv"))
    closed: Column = F.col("_ds") != "accepted"
    unread = F.col("_rs").isNull() | (F.col("_rs") != "accepted")
    idle = (F.col("_ds") == "accepted") & ~F.col("_dv")
    unknown = lambda s: F.when(F.col(s) == "unresolved_conflict", "unresolved_conflict").otherwise("insufficient_evidence")
    status = F.when(closed, unknown("_ds")).when(idle, "answerable").when(unread, unknown("_rs")).otherwise("answerable")
    return d.join(r, keys, "left").select(
        *keys, status.alias("status"),
        F.when(closed, None).when(idle, "not_applicable").when(~unread, "charge").alias("verdict"),
        F.when(~closed & ~idle & ~unread, exact.revenue_charge(F.col("_rv"))).alias("amount"))


def rational_case(fact: DataFrame, keys: list[str], condition) -> DataFrame:
    """A rational fact compared exactly; anything but an accepted value is insufficient evidence."""
    usable = (F.col("status") == "accepted") & F.col("value").isNotNull()
    return fact.select(
        *keys, F.when(usable, "answerable").otherwise("insufficient_evidence").alias("status"),
        F.when(usable, condition(F.col("value"))).alias("condition_met"))
