"""Answers at many instants and effects of removals against plain replays."""

import random

import pytest
from pyspark.sql import functions as F

from chronofact.operators import asof, counterfactual, ledger
from chronofact.plans import ledgers as plans
from test_ledger import SOURCES, claim, day, frames, record


def history(seed, steps, names=8):
    """A valid ledger of two facts with sources of three ranks; records open, replace and retract several assertions at once."""
    rng, open_, rows, made = random.Random(seed), {}, [], 0
    for n in range(steps):
        source = rng.choice("abc")
        targets = [a for a, (s, _) in open_.items() if s in SOURCES[source][2] and rng.random() < 0.3]
        opened = []
        for _ in range(rng.choice([0, 1, 1, 2])):
            name = f"a{rng.randrange(names)}" if rng.random() < 0.5 else f"n{(made := made + 1)}"
            if name not in [o[0] for o in opened] and (name not in open_ or name in targets):
                opened.append(claim(name, rng.randrange(3), rng.choice(["fact", "other"])))
        if not targets and not opened:
            continue
        operation = "retract" if not opened else "replace" if targets else "assert"
        rows.append(record("L", f"r{n}", source, n, n, operation, opened, targets, order=n))
        for t in targets:
            open_.pop(t)
        open_.update({o[0]: (source, o) for o in opened})
    return rows


def replay(rows, at=None, without=None):
    """Status and value of both facts after the records known at ``at``, one of them left out."""
    last = {}
    for row in rows:
        if row[1] == without or (at is not None and row[3] > at):
            continue
        for target in row[7]:
            last[target] = None
        for a in row[8]:
            last[a[0]] = (row[2], a)
    out = {}
    for fact in ("fact", "other"):
        live = [(SOURCES[s][0], a[3]) for s, a in filter(None, last.values()) if a[1] == fact]
        best = {v for r, v in live if r == min(live)[0]}
        out[fact] = ("missing", None) if not live else ("accepted", best.pop()) if len(best) == 1 else ("unresolved_conflict", None)
    return out


@pytest.mark.parametrize("per_cell", [asof.PER_CELL, 4])
def test_answers_at_many_instants_equal_replays(spark, per_cell):
    rows = history(3, 60)
    frame, sources = frames(spark, rows)
    asked = [(n, "L", fact, day(t)) for n, (fact, t) in enumerate((f, t / 2) for f in ("fact", "other", "none") for t in range(-2, 130))]
    asked += [(9_000, "L", "fact", day(5)), (9_001, "L", "fact", None), (9_002, None, "fact", day(9)), (9_003, "M", "fact", day(9))]
    requests = spark.createDataFrame(asked, "id long, ledger_id string, logical_fact_id string, known_as_of timestamp_ntz")
    found = asof.answer_requests(asof.open_intervals(frame), sources, requests, per_cell=per_cell).collect()
    assert len(found) == len(asked)
    got = {r["id"]: (r["status"], r["value"]) for r in found}
    for n, lid, fact, at in asked:
        known = lid == "L" and at is not None and fact != "none"
        assert got[n] == (replay(rows, at)[fact] if known else ("missing", None)), (n, fact, at)
    assert asof.answer_requests(asof.open_intervals(frame), sources, requests.limit(0)).count() == 0
    assert {r["status"] for r in asof.answer_requests(asof.open_intervals(frame.limit(0)), sources, requests).collect()} == {"missing"}


def test_an_interval_lies_in_few_nodes_and_meets_a_request_once(spark):
    depth, leaves = 6, 64
    spans = [(i, j) for i in range(0, 64, 3) for j in range(i, 65, 5)]
    rows = spark.createDataFrame(spans, "i int, j int").select("i", "j", asof._covering(F.col("i"), F.col("j"), leaves, depth).alias("nodes")).collect()
    for row in rows:
        covered = [leaf for n in row["nodes"] for leaf in range(64) if any((leaf + 64) >> h == n for h in range(depth + 1))]
        assert sorted(covered) == list(range(row["i"], row["j"])) and len(row["nodes"]) <= 2 * depth


def test_requests_meet_intervals_by_equality_only(spark):
    plan = plans.ledger_as_of_requests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_hot_fact_is_dealt_over_nodes(spark):
    n, cell = 4_000, 200
    intervals = spark.range(n).select(
        F.lit("L").alias("ledger_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("logical_fact_id"),
        F.col("id").cast("string").alias("assertion_id"), F.lit("a").alias("source_id"), F.lit("1").alias("object"),
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("known_from"),
        F.when(F.col("id") % 2 == 0, F.timestamp_seconds(F.col("id") * 60 + 90).cast("timestamp_ntz")).alias("known_to"))
    asked = spark.range(0, n, 7).select(F.lit("L").alias("ledger_id"), F.lit("hot").alias("logical_fact_id"),
                                        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("known_as_of"))
    cut = asof.open_at(intervals, asked, per_cell=cell)
    plain = asof.open_at(intervals, asked)
    assert cut.count() == plain.count() == cut.select("assertion_id", "known_as_of").distinct().count() > n


@pytest.mark.parametrize("seed", range(4))
def test_removals_equal_replays_without_each_record(spark, seed):
    rows = history(seed, 40)
    frame, sources = frames(spark, rows)
    found = counterfactual.removal_effects(frame, sources).collect()
    got = {(r["logical_fact_id"], r["record_id"]): (r["status_before"], r["value_before"], r["status_after"], r["value_after"]) for r in found}
    whole, want = replay(rows), {}
    for row in rows:
        for fact, answer in replay(rows, without=row[1]).items():
            if answer != whole[fact]:
                want[fact, row[1]] = (*whole[fact], *answer)
    assert got == want and want


def test_prefix_retraction_conflict_and_reopening(spark):
    """A retraction undone, a conflict resolved, a lower rank promoted, a reopened assertion that falls back."""
    rows = [record("L", "r1", "a", 0, 1, "assert", [claim("x", 1)]), record("L", "r2", "b", 1, 2, "assert", [claim("y", 2)]),
            record("L", "r3", "c", 2, 3, "assert", [claim("z", 3), claim("q", 4, "other")]), record("L", "r4", "c", 3, 4, "retract", [], ["q"])]
    frame, sources = frames(spark, rows)
    got = {(r[1], r[2]): (r["status_after"], r["value_after"]) for r in counterfactual.removal_effects(frame, sources).collect()}
    assert got == {("fact", "r1"): ("accepted", claim("", 2)[3]), ("fact", "r2"): ("accepted", claim("", 1)[3]), ("other", "r4"): ("accepted", claim("", 4)[3])}
    again = [*rows, record("L", "r5", "a", 4, 5, "replace", [claim("x", 9)], ["x"]), record("L", "r6", "b", 5, 6, "retract", [], ["y"])]
    frame, sources = frames(spark, again)
    got = {(r[1], r[2]): (r["status_after"], r["value_after"]) for r in counterfactual.removal_effects(frame, sources).collect()}
    assert got[("fact", "r5")] == ("accepted", claim("", 1)[3]) and got[("fact", "r6")] == ("unresolved_conflict", None)
    unknown = [record("L", "r1", "nobody", 0, 1, "assert", [claim("x", 1)]), record("L", "r2", "a", 1, 2, "assert", [claim("y", 2)])]
    frame, sources = frames(spark, unknown)
    got = counterfactual.removal_effects(frame, sources).collect()
    assert [(r["record_id"], r["status_before"], r["status_after"]) for r in got] == [("r1", "unknown_source", "accepted")]


def test_a_rejected_ledger_without_id_has_no_state(spark):
    rows = [record(None, "r1", "a", 0, 1, "assert", [claim("x", 1)]), record(None, "r2", "b", 1, 2, "retract", [], ["x"]),
            record("L", "r1", "a", 0, 1, "assert", [claim("x", 1)])]
    frame, sources = frames(spark, rows)
    state, rejected = ledger.reduce_prefix(frame, sources, F.lit(day(9)).cast("timestamp_ntz"))
    assert [r["ledger_id"] for r in state.collect()] == ["L"] and [r["ledger_id"] for r in rejected.collect()] == [None]


def test_intervals_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passing(text):
        seen.add(1)
        return text

    intervals = spark.range(50).select(
        F.lit("L").alias("ledger_id"), passing((F.col("id") % 5).cast("string")).alias("logical_fact_id"), F.col("id").cast("string").alias("assertion_id"),
        F.lit("a").alias("source_id"), F.lit("1").alias("object"), F.lit("2024-01-01").cast("timestamp_ntz").alias("known_from"),
        F.lit(None).cast("timestamp_ntz").alias("known_to"))
    sources = spark.sql("SELECT 'a' AS source_id, 1 AS authority_rank")
    requests = spark.range(6).select(F.lit("L").alias("ledger_id"), F.col("id").cast("string").alias("logical_fact_id"),
                                     F.lit("2024-02-01").cast("timestamp_ntz").alias("known_as_of"))
    got = {r["logical_fact_id"]: (r["status"], r["support"]) for r in asof.answer_requests(intervals, sources, requests).collect()}
    assert got == {**{str(i): ("accepted", 10) for i in range(5)}, "5": ("missing", 0)}
    assert seen.value == 50
