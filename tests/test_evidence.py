import random

import pytest
from pyspark.sql import functions as F

from chronofact.operators import coverage, evaluation, evidence, inventory

ITEM = "query_id string, evidence_id string, source_kind string, score double, rank int, eligibility string, token_cost int"


def greedy(items, budget, cap):
    picks = []
    for item in sorted((i for i in items if i[5] == "eligible"), key=lambda i: (-i[3], i[4], i[1])):
        same_kind = [p for p in picks if p[2] == item[2]]
        if len(same_kind) < cap and sum(p[6] for p in [*picks, item]) <= budget:
            picks.append(item)
    return [p[1] for p in picks]


def test_select_evidence_equals_the_sequential_scan_on_hot_queries(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "q1", "q2", "q3"]), f"e{i}", rng.choice("xyz"), float(rng.randrange(9)), rng.randrange(3),
             rng.choice(["eligible"] * 4 + ["expired"]), rng.choice([0, 1, 2, 3, 5, 8, 40])) for i in range(900)]
    df = spark.createDataFrame(rows, ITEM)
    for budget, cap in ((30, 3), (7, 10), (0, 2), (1000, 50)):
        got = {}
        for r in sorted(evidence.select_evidence(df, token_budget=budget, per_source_cap=cap).collect(), key=lambda r: r["pick"]):
            got.setdefault(r["query_id"], []).append(r["evidence_id"])
        for q in {r[0] for r in rows}:
            assert got.get(q, []) == greedy([r for r in rows if r[0] == q], budget, cap)


def test_budget_and_cap_keep_both_kinds(spark):
    kinds = ["document"] * 3 + ["kg"] * 2
    rows = [("q", str(i), k, 10.0 - i, i, "eligible", 10) for i, k in enumerate(kinds)]
    got = evidence.select_evidence(spark.createDataFrame(rows, ITEM), token_budget=30, per_source_cap=2).collect()
    assert sorted(r["evidence_id"] for r in got) == ["0", "1", "3"] and max(r["spent"] for r in got) == 30


PUBLIC = "query_id string, evidence_id string, source_kind string, score double, rank int, token_cost int, pinned boolean"


def balanced(items, budget, most):
    left, taken, spent = list(items), [], 0
    while len(taken) < most:
        fits = [c for c in left if spent + c[5] <= budget]
        if not fits:
            break
        best = min(fits, key=lambda c: (not c[6], sum(t[2] == c[2] for t in taken), c[2], -c[3], c[4], c[1]))
        taken.append(best)
        left.remove(best)
        spent += best[5]
    return [t[1] for t in taken], spent, {c[1]: "token_budget_exceeded" if spent + c[5] > budget else "selected_item_cap_reached" for c in left}


@pytest.mark.parametrize("budget,most", [(30, 4), (12, 50), (100, 3), (5, 0)])
def test_select_public_equals_the_sequential_choice(spark, budget, most):
    rng = random.Random(budget)
    rows = [(rng.choice(["hot", "hot", "q1"]), f"e{i}", rng.choice("xyz"), float(rng.randrange(5)), rng.randrange(3),
             rng.choice([1, 2, 3, 7, 200]), rng.random() < 0.05) for i in range(240)]
    chosen, excluded = evidence.select_public(spark.createDataFrame(rows, PUBLIC), token_budget=budget, max_items=most)
    picks, out = sorted(chosen.collect(), key=lambda r: r["pick"]), excluded.collect()
    for q in ("hot", "q1"):
        ids, spent, reasons = balanced([r for r in rows if r[0] == q], budget, most)
        assert [r["evidence_id"] for r in picks if r["query_id"] == q] == ids
        assert {r["evidence_id"]: r["reason"] for r in out if r["query_id"] == q} == reasons
        assert all((r["tokens_spent"], r["selected_items"]) == (spent, len(ids)) for r in out if r["query_id"] == q)


def test_public_selector_keeps_the_pin_and_reports_the_budget(spark):
    rows = [("q", "doc", "document", 1.0, 1, 10, False), ("q", "definition", "definition", 1.0, 1, 10, True),
            ("q", "kg", "kg", 1.0, 1, 10, False), ("q", "coverage", "coverage", 1.0, 1, 10, False)]
    chosen, excluded = evidence.select_public(spark.createDataFrame(rows, PUBLIC), token_budget=30, max_items=3)
    got = chosen.collect()
    assert sum(r["token_cost"] for r in got) <= 30 and len({r["source_kind"] for r in got}) == 3
    assert "definition" in {r["evidence_id"] for r in got}
    left = excluded.first()
    assert (left["reason"], left["tokens_spent"]) == ("token_budget_exceeded", 30)


def test_union_drops_only_identical_locators_and_pins_stay(spark):
    schema = "query_id string, evidence_id string, locator string"
    left = spark.createDataFrame([("q", "original", "L1")], schema)
    right = spark.createDataFrame([("q", "duplicate", "L1"), ("q", "distinct", "L2"), ("r", "other", "L1")], schema)
    assert {r["evidence_id"] for r in evidence.hybrid_union(left, right).collect()} == {"original", "distinct", "other"}
    ranked = spark.createDataFrame([("q", "s1", 2.5, 1, "bm25")], "query_id string, source_id string, score double, rank int, origin_stage string")
    pins = spark.createDataFrame([("q", "s1"), ("q", "pin"), ("q", "pin")], "query_id string, source_id string")
    got = sorted(tuple(r) for r in evidence.pin_fallback(ranked, pins).collect())
    assert got == [("q", "pin", 0.0, None, "public_pin_fallback"), ("q", "s1", 2.5, 1, "bm25")]


RECIPE = "recipe_key string, subject_id string, window_start timestamp_ntz, window_end timestamp_ntz, source_set array<string>"
EVENT = "member_id string, subject_id string, source_id string, event_time timestamp_ntz, outcome string"


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_coverage_members_outcomes_digests_and_rates(spark, broadcast_rows):
    from datetime import datetime, timedelta
    day = lambda n: datetime(2026, 8, 1) + timedelta(days=n)
    recipes = spark.createDataFrame([
        ("trips_b", "B", day(0), day(30), ["t"]), ("trips_h", "H", day(0), day(30), ["t"]),
        ("incidents_b", "B", day(0), day(10) + timedelta(microseconds=1), ["i"])], RECIPE)
    rows = [(f"m{i}", "B", "t", day(i), "completed" if i < 8 else "cancelled") for i in range(10)]
    rows += [("end", "B", "t", day(30), "completed"), ("other", "B", "u", day(1), "completed"), ("edge", "B", "x", day(10), "open")]
    found = coverage.members(recipes, spark.createDataFrame(rows, EVENT), broadcast_rows=broadcast_rows)
    counts = {(r["recipe_key"], r["outcome"]): r["members"] for r in coverage.outcomes(recipes, found).collect()}
    assert counts == {("trips_b", "completed"): 8, ("trips_b", "cancelled"): 2, ("trips_h", None): 0, ("incidents_b", None): 0}
    digests = {r["recipe_key"]: r for r in coverage.digests(recipes, found).collect()}
    assert digests["trips_h"]["members_digest"] == digests["incidents_b"]["members_digest"] != digests["trips_b"]["members_digest"]
    assert digests["trips_h"]["members_digest"].startswith("37517e5f3dc66819") and digests["trips_h"]["members"] == 0
    assert len({r["content_digest"] for r in digests.values()}) == 3 == len({r["artifact_id"] for r in digests.values()})
    asked = spark.createDataFrame([("trips_b",), ("trips_h",), ("unknown",)], "recipe_key string")
    rates = {r["recipe_key"]: tuple(r)[1:] for r in coverage.cancel_rates(asked, recipes, found).collect()}
    assert rates == {"trips_b": ("complete", 10, 1, 5), "trips_h": ("complete", 0, None, None), "unknown": ("missing_coverage", 0, None, None)}


def test_evaluation_attributes_each_loss_to_its_stage(spark):
    atoms = spark.createDataFrame([
        ("lost", "r", "document", "d1", True), ("dropped", "r", "document", "d2", True), ("hidden", "operating_day", "kg", "k1", False),
        ("fine", "r", "document", "d3", True)], "query_id string, role string, modality string, evidence_id string, available boolean")
    pair = "query_id string, evidence_id string"
    candidates = spark.createDataFrame([("dropped", "d2"), ("fine", "d3"), ("lost", "zz")], pair)
    chosen = spark.createDataFrame([("fine", "d3")], pair)
    rows = evaluation.attribute_support(atoms, candidates, chosen)
    stages = {r["query_id"]: (r["earliest_failing_stage"], r["selection_loss"]) for r in evaluation.query_completeness(rows).collect()}
    assert stages == {"lost": ("missing_from_candidates", False), "dropped": ("selection_dropped_required_evidence", True),
                      "hidden": ("intentionally_unavailable", False), "fine": ("none", False)}
    recall = {r["modality"]: (r["required"], r["candidate_hits"], r["selected_hits"]) for r in evaluation.modality_recall(rows).collect()}
    assert recall == {"document": (3, 2, 1), "kg": (1, 0, 0)}


def test_traces_latency_and_cases(spark):
    queries = spark.createDataFrame([("a",), ("b",)], "query_id string")
    results = spark.createDataFrame([("a", "completed_retrieval")], "query_id string, runtime_status string")
    assert dict(evaluation.terminal_traces(queries, results).collect()) == {"a": "completed_retrieval", "b": "no_result"}
    values = [5, 5, 5, 5, 5, 5, 5, 5, 5, 100]
    stats = evaluation.latency_statistics(spark.createDataFrame([("s", v) for v in values], "stage string, ticks long")).first()
    assert (stats["denominator"], stats["p50_ticks"], stats["p95_ticks"], stats["total_ticks"]) == (10, 5, 100, 145)
    day = spark.createDataFrame([("1", "accepted", True), ("2", "accepted", False), ("3", "unresolved_conflict", None), ("4", "missing", None),
                                 ("5", "accepted", True), ("6", "accepted", True)], "s string, status string, value boolean")
    revenue = spark.createDataFrame([("1", "accepted", 200000), ("2", "unresolved_conflict", None), ("5", "missing", None),
                                     ("6", "unresolved_conflict", None)], "s string, status string, value long")
    got = {r["s"]: tuple(r)[1:] for r in evaluation.revenue_case(day, revenue, ["s"]).collect()}
    assert got == {"1": ("answerable", "charge", 16000), "2": ("answerable", "not_applicable", None), "3": ("unresolved_conflict", None, None),
                   "4": ("insufficient_evidence", None, None), "5": ("insufficient_evidence", None, None), "6": ("unresolved_conflict", None, None)}
    from chronofact.functions import exact
    facts = spark.createDataFrame([("1", "accepted", (49, 10)), ("2", "unresolved_conflict", None)], "s string, status string, value struct<n:long,d:long>")
    assert {r["s"]: (r["status"], r["condition_met"]) for r in evaluation.rational_case(facts, ["s"], exact.rating_condition).collect()} == {
        "1": ("answerable", True), "2": ("insufficient_evidence", None)}


def test_logical_hash_and_tree_digest(spark):
    import hashlib
    rows = [(i, f"v{i}é") for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, "k int, v string").withColumn("g", F.lit(0))
    line = F.to_json(F.struct("k", "v"))
    want = hashlib.sha256("".join('{"k":%d,"v":"v%dé"}\n' % (i, i) for i in (1, 2, 3)).encode()).hexdigest()
    assert inventory.logical_hash(df, "k", line, ["g"]).first()["digest"] == want
    big = spark.range(5000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    first = inventory.tree_digest(big, "k", F.col("v"), fanout=16, levels=5).collect()
    again = inventory.tree_digest(big.repartition(7, "v"), "k", F.col("v"), fanout=16, levels=5).collect()
    other = inventory.tree_digest(big.where("k <> 77"), "k", F.col("v"), fanout=16, levels=5).collect()
    assert len(first) == 1 and first == again and first[0]["rows"] == 5000 and other[0]["digest"] != first[0]["digest"]


def test_recipes_that_break_their_contract(spark):
    from datetime import datetime, timedelta
    day = lambda n: datetime(2026, 8, 1) + timedelta(days=n)
    registered = spark.createDataFrame([("r", "B", day(0), day(30), ["t", "i"])], RECIPE)
    events = spark.createDataFrame([("m", "B", "t", day(1), "completed"), ("n", "B", "i", day(2), "open")], EVENT)

    def broken(*recipe, bounds="half-open", seen=events):
        asked = spark.createDataFrame([recipe], RECIPE).withColumn("bounds", F.lit(bounds))
        return sorted(r["violation"] for r in coverage.recipe_violations(asked, seen, registered).collect())

    good = ("r", "B", day(0), day(30), ["i", "t", "t"])
    assert broken(*good) == []
    assert broken("r", "H", *good[2:]) == ["subject differs"]
    assert broken("r", "B", day(1), day(30), ["t", "i"]) == ["window starts late"]
    assert broken("r", "B", day(0), day(29), ["t", "i"]) == ["window ends early"]
    assert broken("r", "B", day(-1), day(30), ["t", "i"]) == ["window is wider"]
    assert broken("r", "B", None, day(30), ["t", "i"]) == ["window is empty", "window starts late"]
    assert broken("r", "B", day(0), day(30), None) == ["no source is named", "sources differ"]
    assert broken(*good, bounds="observed-member-min-max") == ["window is not declared half-open"]
    assert broken(*good, seen=events.where("source_id = 't'")) == ["source delivered nothing"]
    assert broken("x", *good[1:]) == ["recipe is not registered"]


def test_digests_of_any_key(spark):
    keys = [0, 1, 1023, 1024, 2**53 + 1, 2**62 + 1023, 2**62 + 1024, -1, -1024, -1025, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    blocks = {r["block"]: r["entries"] for r in inventory.block_digests(rows, "k", F.col("k").cast("string")).collect()}
    want = {}
    for k in keys:
        want[k // 1024] = want.get(k // 1024, 0) + 1
    assert blocks == want
    named = rows.select(F.col("k").cast("string").alias("k"))
    digest = lambda df: tuple(inventory.keyed_tree_digest(df, "k", F.col("k")).first())
    assert digest(named) == digest(named.repartition(7)) and digest(named)[1] == len(keys)
    assert digest(named.where("k <> '0'"))[0] != digest(named)[0]


def test_stage_traces_count_every_stage_once(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    found = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9), ("zz", 1)], "query_id string, item int")
    chosen = spark.createDataFrame([("a", 1), ("a", 2)], "query_id string, item int")
    traced = evaluation.stage_traces(queries, {"candidate": found, "selection": chosen}, {"candidate": 5})
    watched, totals = evaluation.with_run_totals(traced, ["candidate", "selection"])
    got = {r["query_id"]: (r["candidate_count"], r["selection_count"], r["candidate_limit"], r["truncated"], r["runtime_status"]) for r in watched.collect()}
    assert got == {"a": (5, 2, 5, True, "completed_retrieval"), "b": (1, 0, 5, False, "completed_retrieval"), "c": (0, 0, 5, False, "no_result")}
    assert totals.get == {"queries": 3, "no_result": 1, "truncated": 1, "candidate": 6, "selection": 2}
    assert traced._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 3


def test_rows_are_numbered_across_slices(spark):
    from chronofact.operators.skew import number_rows

    rows = spark.createDataFrame([(x,) for x in [5, 3, None, 9, 3, 7, None, 1]], "v int")
    for bounds in ((), (3.0, 6.0)):
        got = sorted((r["n"], r["v"]) for r in number_rows(rows, "v", bounds, "n").collect())
        assert [n for n, _ in got] == list(range(8)) and [v for _, v in got] == [None, None, 1, 3, 3, 5, 7, 9]
    assert number_rows(rows.limit(0), "v").count() == 0
