import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronofact.operators import ledger
from chronofact.operators.skew import first_after, last_before, slice_bounds
from chronofact.plans import ledgers as plans

RECORD = ("ledger_id string, record_id string, source_id string, known_at timestamp_ntz, commit_seq long, input_order long, "
          "operation string, target_assertion_ids array<string>, "
          "assertions array<struct<assertion_id:string,logical_fact_id:string,predicate:string,object:string>>, raw_payload string, payload_hash string")
SOURCE = "source_id string, authority_rank int, allowed_predicates array<string>, can_correct_source_ids array<string>"
SOURCES = {"a": (10, ["P"], ["a"]), "b": (10, ["P"], ["b"]), "c": (20, ["P", "Q"], ["a", "b", "c"])}
START = datetime(2026, 1, 1)


def day(n):
    return START + timedelta(days=n)


def record(lid, rid, sid, at, seq, op, assertions, targets=(), ok=True, order=0):
    payload = {"record_id": rid, "text": "left out", "source": sid, "commit_seq": seq}
    kept = json.dumps({"record_id": rid, "source": sid}, sort_keys=True, separators=(",", ":")) + "\n"
    return (lid, rid, sid, day(at), seq, order, op, list(targets), assertions, json.dumps(payload),
            hashlib.sha256(kept.encode()).hexdigest() if ok else None if seq % 2 else "0" * 64)


def claim(aid, value, fact="fact", predicate="P"):
    return (aid, fact, predicate, '{"type":"integer","value":%d}' % value)


def frames(spark, records):
    sources = spark.createDataFrame([(k, *v) for k, v in SOURCES.items()], SOURCE)
    return spark.createDataFrame(records, RECORD), sources


def facts(spark, *ids):
    return spark.createDataFrame([("L", i) for i in ids], "ledger_id string, logical_fact_id string")


def decide(spark, records, at, *ids):
    rows, sources = frames(spark, records)
    view = ledger.as_of_view(rows, F.lit(day(at)).cast("timestamp_ntz"))
    return {r["logical_fact_id"]: (r["status"], r["value"]) for r in ledger.select_fact(view, sources, facts(spark, *ids)).collect()}


def test_replace_and_historical_prefix(spark):
    rows = [record("L", "r1", "a", 0, 1, "assert", [claim("a1", 200)]),
            record("L", "r2", "a", 1, 2, "replace", [claim("a2", 240)], ["a1"])]
    assert decide(spark, rows, 0.5, "fact", "other") == {"fact": ("accepted", claim("", 200)[3]), "other": ("missing", None)}
    assert decide(spark, rows, 1, "fact")["fact"] == ("accepted", claim("", 240)[3])


def test_equal_rank_conflict_lower_rank_loses_and_unauthorized_revision(spark):
    rows = [record("L", "r1", "a", 0, 1, "assert", [claim("a1", 200)]), record("L", "r2", "b", 1, 2, "assert", [claim("a2", 240)]),
            record("L", "r3", "c", 1, 3, "assert", [claim("a3", 999), claim("a4", 5, "low", "Q")])]
    assert decide(spark, rows, 2, "fact", "low") == {"fact": ("unresolved_conflict", None), "low": ("accepted", claim("", 5)[3])}
    bad = rows + [record("L", "r4", "b", 2, 4, "retract", [], ["a1"])]
    frame, sources = frames(spark, bad)
    assert ledger.validate_ledger(frame, sources).first()["violation"] == "unauthorized correction"
    view = ledger.as_of_view(frames(spark, rows)[0], F.lit(day(2)).cast("timestamp_ntz"))
    made = ledger.select_fact(view, sources, facts(spark, "fact"))
    assert {r["assertion_id"] for r in ledger.supporting_assertions(view, sources, made).collect()} == {"a1", "a2"}


def test_bitemporal_incident_probe(spark):
    """Open, open, resolved, open: a resolution reported late, then withdrawn."""
    rows = [record("L", "r1", "c", 0, 1, "assert", [claim("i1", 1)]), record("L", "r2", "c", 2, 2, "replace", [claim("i2", 0)], ["i1"]),
            record("L", "r3", "c", 4, 3, "replace", [claim("i3", 1)], ["i2"])]
    got = [decide(spark, rows, at, "fact")["fact"][1] for at in (0, 1, 2, 4)]
    assert got == [claim("", v)[3] for v in (1, 1, 0, 1)]


def latest(trail, aid):
    """Last event of an assertion: (aid, opened?, at, source, record)."""
    return next((e for e in reversed(trail) if e[0] == aid), None)


def breaks(record, accepted, trail):
    """Names of the rules a record breaks, in order; extends the trail as far as it is judged."""
    _, rid, sid, at, seq, _, op, targets, opened, _, declared = record
    whole = {
        "duplicate record_id": any(r[1] == rid for r in accepted),
        "replay order is not strict": any((r[3], r[4]) >= (at, seq) for r in accepted),
        "payload hash mismatch": declared in (None, "0" * 64),
        "assert cannot target": op == "assert" and targets,
        "retract cannot assert": op == "retract" and opened,
        "revision requires targets": op in ("replace", "retract") and not targets,
        "unknown source": sid not in SOURCES,
    }
    yield from (name for name, broken in whole.items() if broken)
    _, predicates, corrects = SOURCES[sid]
    for target in targets:
        before = latest(trail, target)
        if not (before and before[1]):
            yield "target is not active"
        if before[2] >= at:
            yield "target must be known strictly earlier"
        if before[3] not in corrects:
            yield "unauthorized correction"
        trail.append((target, False, at, sid, rid))
    for aid, _, predicate, _ in opened:
        before = latest(trail, aid)
        if before and before[1]:
            yield "duplicate active assertion"
        if predicate not in predicates:
            yield "source predicate not authorized"
        trail.append((aid, True, at, sid, rid))


def sequential(records):
    """First violation of one ledger, or its final state, one record at a time."""
    accepted, trail = [], []
    for record in sorted(records, key=lambda r: (r[3], r[4], r[5])):
        broken = next(breaks(record, accepted, trail), None)
        if broken:
            return broken, record[1]
        accepted.append(record)
    state = {}
    for aid in {e[0] for e in trail}:
        opening = next(e for e in reversed(trail) if e[0] == aid and e[1])
        end = latest(trail, aid)
        state[aid] = (opening[4], opening[2], None if end[1] else end[2])
    return state


def random_ledger(rng, lid):
    out, made = [], []
    for i in range(rng.randrange(1, 9)):
        sid = rng.choice(["a", "a", "b", "c", "c"]) if rng.random() > 0.03 else "x"
        op = rng.choice(["assert", "replace", "retract"])
        targets = rng.sample(made, min(len(made), rng.randrange(1, 3))) if op != "assert" else []
        opened = [] if op == "retract" else [
            claim(f"n{rng.randrange(6)}", rng.randrange(3), predicate=rng.choice(["P", "P", "P", "Q"])) for _ in range(rng.choice([1, 1, 2]))]
        if rng.random() < 0.05:
            op = rng.choice(["assert", "retract", "replace"])
        made = list({*made, *[a[0] for a in opened]})
        rid = f"r{i}" if rng.random() > 0.03 else "r0"
        at = i if rng.random() > 0.1 else max(i - 1, 0)
        out.append(record(lid, rid, sid, at, i if rng.random() > 0.05 else 0, op, opened, targets, rng.random() > 0.02, i))
    return out


@pytest.mark.parametrize("rows_per_slice", [10**6, 400])
def test_random_ledgers_equal_a_sequential_replay(spark, rows_per_slice):
    rng = random.Random(11)
    ledgers = {f"L{i}": random_ledger(rng, f"L{i}") for i in range(700)}
    want = {lid: sequential(rows) for lid, rows in ledgers.items()}
    rows, sources = frames(spark, [r for rows in ledgers.values() for r in rows])
    bounds = slice_bounds(rows, "known_at", rows_per_slice)
    found = ledger.validate_ledger(rows, sources, bounds).collect()
    bad = {lid: v for lid, v in want.items() if isinstance(v, tuple)}
    assert {v for v, _ in bad.values()} == set(ledger.CHECKS)
    assert {r["ledger_id"]: (r["violation"], r["record_id"]) for r in found} == bad
    view = ledger.as_of_view(rows, F.lit(day(99)).cast("timestamp_ntz")).collect()
    got = {}
    for r in view:
        if r["ledger_id"] not in bad:
            got.setdefault(r["ledger_id"], {})[r["assertion_id"]] = (r["record_id"], r["known_from"], r["known_to"])
    assert got == {lid: v for lid, v in want.items() if lid not in bad and v}


def test_every_copy_after_the_first_is_a_violation(spark):
    rows = [record("L", "r1", "a", i, i, "assert", [claim(f"a{i}", i)], order=i) for i in range(4)]
    rows += [record("M", f"m{i}", "a", 1, 1, "assert", [claim(f"b{i}", i)], order=i) for i in range(3)]
    frame, sources = frames(spark, rows)
    found = [(r["ledger_id"], r["violation"]) for r in ledger.violations(frame, sources).collect()]
    assert sorted(found) == [("L", "duplicate record_id")] * 3 + [("M", "replay order is not strict")] * 2


def test_null_lists_and_unknown_sources(spark):
    rows = [record("L", "r1", "a", 0, 1, "assert", [claim("a1", 200)]), record("L", "r2", "z", 1, 2, "assert", [claim("a2", 1, "other")])]
    rows[0] = (*rows[0][:7], None, *rows[0][8:])
    assert decide(spark, rows, 2, "fact", "other", "none") == {
        "fact": ("accepted", claim("", 200)[3]), "other": ("unknown_source", None), "none": ("missing", None)}
    frame, sources = frames(spark, rows)
    assert {r["violation"] for r in ledger.violations(frame, sources).collect()} == {"unknown source"}


def test_a_declared_hash_is_compared_with_the_record(spark):
    rows = [record("L", f"r{i}", "a", i, i, "assert", [claim(f"a{i}", i)], ok=i == 0, order=i) for i in range(3)]
    frame, sources = frames(spark, rows)
    assert sorted(r["record_id"] for r in ledger.violations(frame, sources).collect()) == ["r1", "r2"]
    assert ledger.violations(frame, sources, check_payload=False).count() == 0
    with pytest.raises(Exception, match="payload_hash"):
        ledger.violations(frame.drop("payload_hash"), sources).count()


@pytest.mark.parametrize("rows_per_slice", [10**6, 400])
def test_reduced_prefix_equals_a_sequential_replay(spark, rows_per_slice):
    rng = random.Random(5)
    ledgers = {f"L{i}": random_ledger(rng, f"L{i}") for i in range(300)}
    want = {lid: sequential([r for r in rows if r[3] <= day(3)]) for lid, rows in ledgers.items()}
    rows, sources = frames(spark, [r for rows in ledgers.values() for r in rows])
    view, rejected = ledger.reduce_prefix(rows, sources, F.lit(day(3)).cast("timestamp_ntz"), slice_bounds(rows, "known_at", rows_per_slice))
    got = {}
    for r in view.collect():
        got.setdefault(r["ledger_id"], {})[r["assertion_id"]] = (r["record_id"], r["known_from"], r["known_to"])
    assert got == {lid: v for lid, v in want.items() if isinstance(v, dict) and v}
    assert {r["ledger_id"]: (r["violation"], r["record_id"]) for r in rejected.collect()} == {
        lid: v for lid, v in want.items() if isinstance(v, tuple)}


def test_later_records_neither_close_nor_invalidate_an_earlier_view(spark):
    rows = [record("L", "r1", "a", 0, 1, "assert", [claim("a1", 1)]), record("L", "r1", "b", 5, 2, "retract", [], ["a1"])]
    frame, sources = frames(spark, rows)
    early = ledger.known_prefix(frame, F.lit(day(1)).cast("timestamp_ntz"))
    assert ledger.validate_ledger(early, sources).count() == 0
    assert ledger.as_of_view(frame, F.lit(day(1)).cast("timestamp_ntz")).first()["known_to"] is None


@pytest.mark.parametrize("rows_per_slice", [10**6, 50])
def test_neighbours_cross_slices_and_a_hot_key(spark, rows_per_slice):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, None]), day(rng.randrange(200)) if rng.random() < 0.9 else None, rng.choice([None, i]))
            for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k int, t timestamp_ntz, v int")
    bounds = slice_bounds(df, "t", rows_per_slice)
    assert (len(bounds) > 5) is (rows_per_slice == 50)
    back = {r["i"]: (r["p"], r["q"]) for r in last_before(
        df, ["k"], ["t", "i"], {"p": F.col("v"), "q": F.col("i")}, bounds).collect()}
    ahead = {r["i"]: r["p"] for r in first_after(df, ["k"], ["t", "i"], {"p": F.col("v")}, bounds).collect()}
    assert len(back) == len(ahead) == 600
    for i, k, t, _ in rows:
        group = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or day(0), r[0]))
        at = [r[0] for r in group].index(i)
        earlier, later = group[:at], group[at + 1:]
        assert back[i] == (next((r[3] for r in reversed(earlier) if r[3] is not None), None), earlier[-1][0] if earlier else None)
        assert ahead[i] == next((r[3] for r in later if r[3] is not None), None)


def test_event_ledger_is_the_same_in_one_slice_and_in_many(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    bounds = slice_bounds(events, "ts", 90)
    one, many = plans.event_records(events), plans.event_records(events, bounds)
    assert bounds
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert ledger.validate_ledger(one, plans.sources(spark), bounds, check_payload=False).count() == 0
