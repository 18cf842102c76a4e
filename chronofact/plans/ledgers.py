"""Bitemporal queries over a ledger that the event table implies.

Each event of a user is a ledger record. Events other than errors assert the
user's value as that event type reports it and replace the type's previous
assertion; an error retracts whatever of the user is still active.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import exact, identity, instants
from ..operators import asof, counterfactual, evaluation, ledger
from ..operators.skew import first_after, last_before, slice_bounds
from ..sources.tables import table
from .registry import query

AS_OF = "2024-01-20 00:00:00"
REPORTERS = {"purchase": 10, "signup": 10, "view": 20, "click": 30}
PREDICATE = "REPORTED_MEASURE"
OBJECT = """'{"type":"integer","value":' || CAST(round(value * 100) AS BIGINT) || '}'"""


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def sources(spark: SparkSession) -> DataFrame:
    """The source registry: one row per event type, a fixed few."""
    rows = [f"('{name}', {rank}, array('{PREDICATE}'), array('{name}'))" for name, rank in REPORTERS.items()]
    names = ", ".join(f"'{name}'" for name in [*REPORTERS, "error"])
    rows.append(f"('error', 0, cast(array() AS array<string>), array({names}))")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} "
                     "AS s(source_id, authority_rank, allowed_predicates, can_correct_source_ids)")


def _stamp(condition: Column) -> Column:
    return F.when(condition, F.struct("ts", "event_id"))


def event_records(events: DataFrame, bounds: Sequence[float] = ()) -> DataFrame:
    """Ledger records of the events, with ``prev`` (the user's previous event) for fault seeding."""
    seen = {f"_{s}": _stamp(F.col("event_type") == s) for s in REPORTERS}
    looked = last_before(events, ["user_id"], ["ts", "event_id"],
                         {**seen, "_error": _stamp(F.col("event_type") == "error"), "prev": _stamp(F.lit(True))}, bounds)

    def active(s: str) -> Column:
        alive = F.col("_error").isNull() | (F.col(f"_{s}") > F.col("_error"))
        wanted = F.col("event_type").isin("error", s)
        return F.when(alive & wanted, F.col(f"_{s}.event_id").cast("string"))

    targets = F.filter(F.array(*[active(s) for s in REPORTERS]), lambda t: t.isNotNull())
    error = F.col("event_type") == "error"
    number = F.round(F.col("value") * 100).cast("bigint").cast("string")
    assertion = F.struct(
        F.col("event_id").cast("string").alias("assertion_id"), F.col("user_id").cast("string").alias("logical_fact_id"),
        F.col("user_id").cast("string").alias("subject_id"), F.lit(PREDICATE).alias("predicate"),
        F.concat(F.lit('{"type":"integer","value":'), number, F.lit("}")).alias("object"),
        F.col("ts").alias("event_time"))
    none = F.array_except(F.array(assertion), F.array(assertion))
    shaped = looked.withColumn("target_assertion_ids", targets)
    operation = F.when(error, "retract").when(F.size("target_assertion_ids") > 0, "replace").otherwise("assert")
    records = shaped.select(
        F.lit("events").alias("ledger_id"), F.col("event_id").cast("string").alias("record_id"),
        F.col("event_type").alias("source_id"), F.col("ts").alias("known_at"), F.col("event_id").alias("commit_seq"),
        F.col("event_id").alias("input_order"), operation.alias("operation"), "target_assertion_ids",
        F.when(error, none).otherwise(F.array(assertion)).alias("assertions"), "user_id", "props", "prev", "ts")
    # An error with nothing to retract is no ledger record.
    return records.where(~((F.col("operation") == "retract") & (F.size("target_assertion_ids") == 0)))


def ledger_records(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return event_records(events, slice_bounds(events, "ts", keys=["user_id"])).drop("user_id", "props", "prev", "ts")


VIEW = f"""
e AS (SELECT * FROM events WHERE ts <= TIMESTAMP '{AS_OF}'),
nx AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next_same,
         min(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_error FROM e),
v AS (SELECT CAST(event_id AS VARCHAR) AS assertion_id, CAST(user_id AS VARCHAR) AS logical_fact_id, event_type AS source_id,
        ts AS known_from, least(next_same, next_error) AS known_to, {OBJECT} AS object,
        CASE event_type WHEN 'purchase' THEN 10 WHEN 'signup' THEN 10 WHEN 'view' THEN 20 ELSE 30 END AS authority_rank
      FROM nx WHERE event_type <> 'error')
"""

DECISIONS = VIEW + """,
facts AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS logical_fact_id FROM events),
o AS (SELECT *, min(authority_rank) OVER (PARTITION BY logical_fact_id) AS best FROM v WHERE known_to IS NULL),
b AS (SELECT logical_fact_id, best, count(DISTINCT object) AS n, min(object) AS value, count(*) AS support,
             min(assertion_id) AS first_assertion_id FROM o WHERE authority_rank = best GROUP BY ALL),
decisions AS (SELECT logical_fact_id, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'accepted'
         ELSE 'unresolved_conflict' END AS status, CASE WHEN n = 1 THEN value END AS value, best AS authority_rank,
         coalesce(support, 0) AS support, first_assertion_id FROM facts LEFT JOIN b USING (logical_fact_id))
"""


def view(spark: SparkSession, sf: str) -> DataFrame:
    """The as-of view; later events are left out in the scan, since no record depends on them."""
    events = table(spark, sf, "events")
    records = event_records(events.where(F.col("ts") <= as_of()), slice_bounds(events, "ts", keys=["user_id"]))
    return ledger.as_of_view(records.drop("user_id", "props", "prev", "ts"), as_of())


@query("ledger_as_of", f"""WITH {VIEW}
SELECT assertion_id, logical_fact_id, source_id, object, strftime(known_from, '%Y-%m-%dT%H:%M:%S.%fZ') AS known_from,
       strftime(known_to, '%Y-%m-%dT%H:%M:%S.%fZ') AS known_to FROM v""")
def ledger_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf).select(
        "assertion_id", "logical_fact_id", "source_id", F.col("assertion.object").alias("object"),
        instants.utc_text("known_from").alias("known_from"), instants.utc_text("known_to").alias("known_to"))


@query("next_change", """
SELECT event_id, min(CASE WHEN event_type = 'error' THEN ts END) OVER w AS next_error, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def next_change(spark: SparkSession, sf: str) -> DataFrame:
    """First later event and first later error of the same user."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    error = F.when(F.col("event_type") == "error", F.col("ts"))
    found = first_after(events, ["user_id"], ["ts", "event_id"], {"next_error": error, "next_ts": F.col("ts")},
                        slice_bounds(events, "ts", keys=["user_id"]))
    return found.select("event_id", "next_error", "next_ts")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "events").select(
        F.lit("events").alias("ledger_id"), F.col("user_id").cast("string").alias("logical_fact_id")).distinct()
    return ledger.select_fact(view(spark, sf), sources(spark), facts)


@query("select_fact", f"WITH {DECISIONS} SELECT * FROM decisions")
def select_fact(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf).drop("ledger_id")


@query("fact_support", f"""WITH {DECISIONS}
SELECT d.logical_fact_id, d.status, o.assertion_id, o.object FROM decisions d JOIN o USING (logical_fact_id)
WHERE o.authority_rank = o.best""")
def fact_support(spark: SparkSession, sf: str) -> DataFrame:
    """Assertions behind every accepted or conflicting fact."""
    current = view(spark, sf)
    facts = table(spark, sf, "events").select(
        F.lit("events").alias("ledger_id"), F.col("user_id").cast("string").alias("logical_fact_id")).distinct()
    made = ledger.select_fact(current, sources(spark), facts)
    return ledger.supporting_assertions(current, sources(spark), made).drop("ledger_id")


RANKS = "CASE source_id WHEN 'purchase' THEN 10 WHEN 'signup' THEN 10 WHEN 'view' THEN 20 ELSE 30 END"


@query("ledger_as_of_requests", f"""WITH
nx AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next_same,
  min(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_error
  FROM events),
iv AS (SELECT user_id, event_id, event_type AS source_id, ts AS known_from, least(next_same, next_error) AS known_to, {OBJECT} AS object
  FROM nx WHERE event_type <> 'error'),
q AS (SELECT o_orderkey, o_custkey // 10 AS user_id, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey * 7919 % 43200) AS known_as_of FROM orders),
o AS (SELECT o_orderkey, {RANKS} AS authority_rank, object FROM q JOIN iv USING (user_id)
  WHERE known_from <= known_as_of AND (known_to IS NULL OR known_as_of < known_to)),
b AS (SELECT o_orderkey, authority_rank, count(DISTINCT object) AS n, min(object) AS value, count(*) AS support FROM o GROUP BY o_orderkey, authority_rank
  QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY authority_rank) = 1)
SELECT o_orderkey, known_as_of, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'accepted' ELSE 'unresolved_conflict' END AS status,
  CASE WHEN n = 1 THEN value END AS value, authority_rank, coalesce(support, 0) AS support FROM q LEFT JOIN b USING (o_orderkey)""")
def ledger_as_of_requests(spark: SparkSession, sf: str) -> DataFrame:
    """What was known of a user at the instant of each order's question."""
    events = table(spark, sf, "events")
    bounds = slice_bounds(events, "ts", keys=["user_id"])
    records = event_records(events, bounds).drop("user_id", "props", "prev", "ts")
    minutes = (F.col("o_orderkey") * 7919 % 43200).cast("int")
    requests = table(spark, sf, "orders").select(
        "o_orderkey", F.lit("events").alias("ledger_id"), F.call_function("div", F.col("o_custkey"), F.lit(10)).cast("string").alias("logical_fact_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("known_as_of"))
    answered = asof.answer_requests(asof.open_intervals(records, bounds), sources(spark), requests)
    return answered.select("o_orderkey", "known_as_of", "status", "value", "authority_rank", "support")


@query("counterfactual_effects", f"""WITH e AS (SELECT * FROM events WHERE ts <= TIMESTAMP '{AS_OF}'),
nx AS (SELECT *, lead((ts, event_id)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS ns,
  min(CASE WHEN event_type = 'error' THEN (ts, event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ne FROM e),
a AS (SELECT user_id, event_id, event_type AS source_id, {OBJECT} AS object, CASE WHEN ns IS NULL OR ne < ns THEN ne ELSE ns END AS ended
  FROM nx WHERE event_type <> 'error'),
c AS (SELECT user_id, event_id, {RANKS} AS authority_rank, object, ended[2] AS closer FROM a),
r AS (SELECT user_id, event_id AS r FROM c UNION SELECT user_id, closer FROM c WHERE closer IS NOT NULL UNION SELECT DISTINCT user_id, NULL::BIGINT FROM c),
o AS (SELECT user_id, r, authority_rank, object FROM r JOIN c USING (user_id) WHERE (closer IS NULL OR closer = r) AND event_id IS DISTINCT FROM r),
b AS (SELECT user_id, r, count(DISTINCT object) AS n, min(object) AS value FROM o GROUP BY user_id, r, authority_rank
  QUALIFY row_number() OVER (PARTITION BY user_id, r ORDER BY authority_rank) = 1),
s AS (SELECT r.user_id, r.r, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'accepted' ELSE 'unresolved_conflict' END AS status,
  CASE WHEN n = 1 THEN value END AS value FROM r LEFT JOIN b ON b.user_id = r.user_id AND b.r IS NOT DISTINCT FROM r.r)
SELECT CAST(x.user_id AS VARCHAR) AS logical_fact_id, CAST(x.r AS VARCHAR) AS record_id, y.status AS status_before, y.value AS value_before,
  x.status AS status_after, x.value AS value_after FROM s x JOIN s y ON y.user_id = x.user_id AND y.r IS NULL
WHERE x.r IS NOT NULL AND (x.status <> y.status OR x.value IS DISTINCT FROM y.value)""")
def counterfactual_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Per fact, the records without which its answer would be another."""
    events = table(spark, sf, "events")
    records = event_records(events.where(F.col("ts") <= as_of()), slice_bounds(events, "ts", keys=["user_id"])).drop("user_id", "props", "prev", "ts")
    return counterfactual.removal_effects(records, sources(spark)).drop("ledger_id")


# Faults are seeded by the number in an event's properties; each breaks one rule.
FAULTED = f"""
p AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k,
        max(CASE WHEN event_type = 'error' THEN ts END) OVER b AS le,
        {", ".join(f"max(CASE WHEN event_type = '{s}' THEN ts END) OVER b AS t_{s}, "
                   f"max(CASE WHEN event_type = '{s}' THEN event_id END) OVER b AS i_{s}" for s in REPORTERS)},
        lag(event_id) OVER o AS pid, lag(ts) OVER o AS pts
      FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id),
        b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT *, [x FOR x IN [{", ".join(
    f"CASE WHEN (le IS NULL OR t_{s} > le) AND event_type IN ('error', '{s}') THEN CAST(i_{s} AS VARCHAR) END"
    for s in REPORTERS)}] IF x IS NOT NULL] AS targets FROM p),
r AS (SELECT CAST(user_id AS VARCHAR) AS ledger_id, event_id AS input_order,
        CASE WHEN k = 0 AND pid IS NOT NULL THEN CAST(pid AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS record_id,
        CASE WHEN k = 6 THEN 'mystery' WHEN k = 9 AND event_type <> 'error' THEN 'view' ELSE event_type END AS source_id,
        CASE WHEN k IN (1, 8) AND pts IS NOT NULL THEN pts ELSE ts END AS known_at,
        CASE WHEN k = 1 AND pid IS NOT NULL THEN pid ELSE event_id END AS commit_seq,
        CASE WHEN k = 3 THEN 'assert' WHEN k = 4 THEN 'retract' WHEN k = 5 THEN 'replace'
             WHEN event_type = 'error' THEN 'retract' WHEN len(targets) > 0 THEN 'replace' ELSE 'assert' END AS operation,
        CASE WHEN k = 5 THEN [] WHEN k = 7 THEN ['none'] ELSE targets END AS targets,
        CASE WHEN event_type = 'error' THEN [] WHEN k = 10 AND pid IS NOT NULL THEN [CAST(pid AS VARCHAR)]
             ELSE [CAST(event_id AS VARCHAR)] END AS opened,
        CASE WHEN k = 11 THEN 'FORBIDDEN' ELSE '{PREDICATE}' END AS predicate,
        sha256('{{"event":' || event_id || ',"k":' || k || '}}' || chr(10)) AS computed,
        CASE WHEN k = 2 AND event_id % 2 = 0 THEN NULL ELSE sha256('{{"event":' || event_id || ',"k":' || (CASE WHEN k = 2 THEN -2 ELSE k END) || '}}' || chr(10)) END AS declared
      FROM tg WHERE NOT (event_type = 'error' AND len(targets) = 0)),
src AS (SELECT * FROM (VALUES ('purchase', TRUE), ('signup', TRUE), ('view', TRUE), ('click', TRUE), ('error', FALSE)) t(source_id, may_assert)),
h AS (SELECT ledger_id, record_id, source_id, known_at, commit_seq, input_order, predicate,
             unnest(range(0, len(targets))) AS pos, 'close' AS event, unnest(targets) AS assertion_id FROM r
      UNION ALL
      SELECT ledger_id, record_id, source_id, known_at, commit_seq, input_order, predicate,
             len(targets) + unnest(range(0, len(opened))), 'open', unnest(opened) FROM r),
hp AS (SELECT *, lag(event) OVER w AS pe, lag(known_at) OVER w AS pk, lag(source_id) OVER w AS ps FROM h
       WINDOW w AS (PARTITION BY ledger_id, assertion_id ORDER BY known_at, commit_seq, input_order, pos)),
found AS (
  SELECT ledger_id, record_id, known_at, commit_seq, input_order, -1 AS pos, 0 AS c, 'duplicate record_id' AS violation
  FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, record_id ORDER BY known_at, commit_seq, input_order) AS n FROM r) WHERE n > 1
  UNION ALL SELECT ledger_id, record_id, known_at, commit_seq, input_order, -1, 1, 'replay order is not strict'
  FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, known_at, commit_seq ORDER BY input_order) AS n FROM r) WHERE n > 1
  UNION ALL SELECT ledger_id, record_id, known_at, commit_seq, input_order, -1, 2, 'payload hash mismatch' FROM r WHERE declared IS DISTINCT FROM computed
  UNION ALL SELECT ledger_id, record_id, known_at, commit_seq, input_order, -1, 3, 'assert cannot target' FROM r
    WHERE operation = 'assert' AND len(targets) > 0
  UNION ALL SELECT ledger_id, record_id, known_at, commit_seq, input_order, -1, 4, 'retract cannot assert' FROM r
    WHERE operation = 'retract' AND len(opened) > 0
  UNION ALL SELECT ledger_id, record_id, known_at, commit_seq, input_order, -1, 5, 'revision requires targets' FROM r
    WHERE operation IN ('replace', 'retract') AND len(targets) = 0
  UNION ALL SELECT ledger_id, record_id, known_at, commit_seq, input_order, -1, 6, 'unknown source' FROM r ANTI JOIN src USING (source_id)
  UNION ALL SELECT ledger_id, record_id, known_at, commit_seq, input_order, pos, 7, 'target is not active' FROM hp
    WHERE event = 'close' AND pe IS DISTINCT FROM 'open'
  UNION ALL SELECT ledger_id, record_id, known_at, commit_seq, input_order, pos, 8, 'target must be known strictly earlier' FROM hp
    WHERE event = 'close' AND pk >= known_at
  UNION ALL SELECT ledger_id, record_id, known_at, commit_seq, input_order, pos, 9, 'unauthorized correction' FROM hp SEMI JOIN src USING (source_id)
    WHERE event = 'close' AND source_id <> ps AND NOT (source_id = 'error' AND ps IN ('purchase', 'signup', 'view', 'click', 'error'))
  UNION ALL SELECT ledger_id, record_id, known_at, commit_seq, input_order, pos, 10, 'duplicate active assertion' FROM hp
    WHERE event = 'open' AND pe = 'open'
  UNION ALL SELECT ledger_id, record_id, known_at, commit_seq, input_order, pos, 11, 'source predicate not authorized' FROM hp JOIN src USING (source_id)
    WHERE event = 'open' AND NOT (may_assert AND predicate = '{PREDICATE}'))
"""


def faulted_records(events: DataFrame, bounds: Sequence[float] = (), sound: Column | None = None) -> DataFrame:
    """One ledger per user, with rule breaks seeded by the events' own property number; users that are ``sound`` break none."""
    k = F.get_json_object("props", "$.k").cast("int")
    k = k if sound is None else F.when(sound, -1).otherwise(k)
    shown = lambda n: F.concat(F.lit('{"event":'), "input_order", F.lit(',"k":'), n, F.lit("}"))
    declared = F.sha2(F.concat(shown(F.when(k == 2, -2).otherwise(k)), F.lit("\n")), 256)
    has_prev = F.col("prev").isNotNull()
    error = F.size("assertions") == 0
    strings = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    reopened = F.transform("assertions", lambda a: F.when(
        (k == 10) & has_prev, a.withField("assertion_id", F.col("prev.event_id").cast("string"))).otherwise(a))
    relabelled = F.transform(reopened, lambda a: F.when(k == 11, a.withField("predicate", F.lit("FORBIDDEN"))).otherwise(a))
    return event_records(events, bounds).select(
        F.col("user_id").cast("string").alias("ledger_id"), "input_order",
        F.when((k == 0) & has_prev, F.col("prev.event_id").cast("string")).otherwise(F.col("record_id")).alias("record_id"),
        F.when(k == 6, "mystery").when((k == 9) & ~error, "view").otherwise(F.col("source_id")).alias("source_id"),
        F.when(k.isin(1, 8) & has_prev, F.col("prev.ts")).otherwise(F.col("known_at")).alias("known_at"),
        F.when((k == 1) & has_prev, F.col("prev.event_id")).otherwise(F.col("commit_seq")).alias("commit_seq"),
        F.when(k == 3, "assert").when(k == 4, "retract").when(k == 5, "replace").otherwise(F.col("operation")).alias("operation"),
        F.when(k == 5, strings()).when(k == 7, strings("none")).otherwise(F.col("target_assertion_ids")).alias("target_assertion_ids"),
        relabelled.alias("assertions"), shown(k).alias("raw_payload"),
        F.when((k != 2) | (F.col("input_order") % 2 != 0), declared).alias("payload_hash"))


@query("validate_ledger", f"""WITH {FAULTED}
SELECT ledger_id, violation, record_id, known_at, commit_seq FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id
  ORDER BY known_at, commit_seq, input_order, pos, c) AS n FROM found) WHERE n = 1""")
def validate_ledger(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    bounds = slice_bounds(events, "ts", keys=["user_id"])
    return ledger.validate_ledger(faulted_records(events, bounds), sources(spark), bounds)


@query("ledger_violations", f"""WITH {FAULTED}
, firsts AS (SELECT *, row_number() OVER (PARTITION BY input_order, pos, least(c, 2) ORDER BY c) AS nth FROM found)
SELECT violation, count(*) AS n, count(DISTINCT ledger_id) AS ledgers FROM firsts WHERE nth = 1 GROUP BY violation""")
def ledger_violations(spark: SparkSession, sf: str) -> DataFrame:
    """How often each rule is the first one that a record, or one of its closings and openings, breaks."""
    events = table(spark, sf, "events")
    bounds = slice_bounds(events, "ts", keys=["user_id"])
    found = ledger.violations(faulted_records(events, bounds), sources(spark), bounds)
    return found.groupBy("violation").agg(F.count("*").alias("n"), F.countDistinct("ledger_id").alias("ledgers"))


SOUND = FAULTED.replace("CAST(json_extract(props, '$.k') AS INT) AS k", "CASE WHEN user_id % 4 <> 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS INT) END AS k")


@query("reduce_prefix", f"""WITH {SOUND}, bad AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id
    ORDER BY known_at, commit_seq, input_order, pos, c) AS n FROM found WHERE known_at <= TIMESTAMP '{AS_OF}') WHERE n = 1),
x AS (SELECT *, (known_at, commit_seq, pos) AS place FROM h WHERE known_at <= TIMESTAMP '{AS_OF}' AND ledger_id NOT IN (SELECT ledger_id FROM bad)),
o AS (SELECT ledger_id, assertion_id, max(place) AS place, arg_max(known_at, place) AS known_from, arg_max(record_id, place) AS record_id
  FROM x WHERE event = 'open' GROUP BY ALL),
e AS (SELECT ledger_id, assertion_id, max(place) AS place, arg_max(known_at, place) AS known_to FROM x WHERE event = 'close' GROUP BY ALL)
SELECT ledger_id, o.assertion_id, o.record_id, known_from, CASE WHEN e.place > o.place THEN known_to END AS known_to, NULL::VARCHAR AS violation
FROM o LEFT JOIN e USING (ledger_id, assertion_id)
UNION ALL SELECT ledger_id, NULL, record_id, known_at, NULL, violation FROM bad""")
def reduce_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The validated state of every ledger at the as-of time, or why a ledger has none; a quarter of the users break rules."""
    events = table(spark, sf, "events")
    bounds = slice_bounds(events, "ts", keys=["user_id"])
    records = faulted_records(events, bounds, sound=F.col("user_id") % 4 != 0)
    current, rejected = ledger.reduce_prefix(records, sources(spark), as_of(), bounds)
    return current.select("ledger_id", "assertion_id", "record_id", "known_from", "known_to", F.lit(None).cast("string").alias("violation")).unionByName(
        rejected.select("ledger_id", F.lit(None).cast("string").alias("assertion_id"), "record_id", F.col("known_at").alias("known_from"),
                        F.lit(None).cast("timestamp_ntz").alias("known_to"), "violation"))


@query("ledger_payload_check", """SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_type = 'error' THEN 'absent'
  WHEN event_type = 'view' THEN 'differs' ELSE 'equal' END AS payload FROM events""")
def ledger_payload_check(spark: SparkSession, sf: str) -> DataFrame:
    """Declared against computed hashes of records that spell the same content in another order and with other spaces."""
    content = lambda value: F.concat(F.lit('{"id":'), "event_id", F.lit(',"type":"'), value, F.lit('","user":'), "user_id", F.lit("}\n"))
    spelled = F.concat(F.lit('{ "user" : '), "user_id", F.lit(', "commit_seq": 5, "type": "'), "event_type", F.lit('", "text":"t", "id": '),
                       "event_id", F.lit(', "payload_hash": "old"}'))
    declared = F.when(F.col("event_type") != "error", F.sha2(content(F.when(F.col("event_type") == "view", "x").otherwise(F.col("event_type"))), 256))
    rows = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("record_id"), spelled.alias("raw_payload"),
                                             declared.alias("payload_hash"))
    state = F.when(F.col("payload_hash").isNull(), "absent").when(ledger.payload_differs(), "differs").otherwise("equal")
    return rows.select("record_id", state.alias("payload"))


PROBES = ("('1997-01-01', '1997-01-01'), ('1997-01-01', '1999-01-01'), ('1999-01-01', '1997-01-01'), ('1999-01-01', '2000-01-01')")


@query("interval_eligible", f"""
WITH probes AS (SELECT CAST(a AS TIMESTAMP) AS probe_at, CAST(b AS TIMESTAMP) AS as_of FROM (VALUES {PROBES}) t(a, b)),
s AS (SELECT o_orderkey, l_linenumber, o_orderdate AS valid_from, CASE WHEN l_shipdate > o_orderdate THEN l_shipdate END AS valid_to,
        o_orderdate AS known_from, CASE WHEN l_returnflag = 'R' THEN greatest(l_shipdate, o_orderdate) END AS known_to
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey, l_linenumber, probe_at, as_of FROM s, probes
WHERE valid_from <= probe_at AND (valid_to IS NULL OR probe_at < valid_to) AND known_from <= as_of AND (known_to IS NULL OR as_of < known_to)""")
def interval_eligible(spark: SparkSession, sf: str) -> DataFrame:
    """State intervals order to shipment, probed at four (valid, known) pairs."""
    pairs = [tuple(p.strip(" '") for p in pair.split(",")) for pair in PROBES.strip("()").split("), (")]
    stamp = lambda text: F.lit(text).cast("timestamp_ntz")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate", "l_returnflag")
    states = orders.join(lines, "o_orderkey").select(
        "o_orderkey", "l_linenumber", F.col("o_orderdate").alias("valid_from"),
        F.when(F.col("l_shipdate") > F.col("o_orderdate"), F.col("l_shipdate")).alias("valid_to"),
        F.col("o_orderdate").alias("known_from"),
        F.when(F.col("l_returnflag") == "R", F.greatest("l_shipdate", "o_orderdate")).alias("known_to"))
    probes = F.array(*[F.struct(stamp(a).alias("probe_at"), stamp(b).alias("as_of")) for a, b in pairs])
    holds = lambda p: instants.interval_eligible(
        F.col("valid_from"), F.col("valid_to"), F.col("known_from"), F.col("known_to"), p["probe_at"], p["as_of"])
    return states.select("o_orderkey", "l_linenumber", F.explode(F.filter(probes, holds)).alias("p")).select(
        "o_orderkey", "l_linenumber", "p.probe_at", "p.as_of")


@query("point_eligible", f"""
SELECT event_id, user_id, ts FROM events e WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15'
AND ts <= TIMESTAMP '{AS_OF}' AND (event_type <> 'error' OR TIMESTAMP '{AS_OF}' < ts + INTERVAL 7 DAY)""")
def point_eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Point events in a half-open window; an error report is withdrawn after seven days."""
    stamp = lambda text: F.lit(text).cast("timestamp_ntz")
    withdrawn = F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    return table(spark, sf, "events").where(instants.point_eligible(
        F.col("ts"), stamp("2024-01-10"), stamp("2024-01-15"), F.col("ts"), withdrawn, as_of())).select("event_id", "user_id", "ts")


@query("evaluate_cases", f"""WITH {VIEW},
oo AS (SELECT logical_fact_id, source_id, object FROM v WHERE known_to IS NULL AND source_id IN ('signup', 'purchase')),
users AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS logical_fact_id FROM events),
d AS (SELECT logical_fact_id, CAST(json_extract(object, '$.value') AS BIGINT) % 2 = 1 AS operating FROM oo WHERE source_id = 'signup'),
r AS (SELECT logical_fact_id, CAST(json_extract(object, '$.value') AS BIGINT) * 10 AS revenue FROM oo WHERE source_id = 'purchase')
SELECT logical_fact_id, CASE WHEN operating IS NULL THEN 'insufficient_evidence' WHEN NOT operating THEN 'answerable'
    WHEN revenue IS NULL THEN 'insufficient_evidence' ELSE 'answerable' END AS status,
  CASE WHEN operating IS NULL THEN NULL WHEN NOT operating THEN 'not_applicable' WHEN revenue IS NOT NULL THEN 'charge' END AS verdict,
  CASE WHEN operating AND revenue IS NOT NULL THEN greatest(280000 - revenue, 0) // 5 END AS amount
FROM users LEFT JOIN d USING (logical_fact_id) LEFT JOIN r USING (logical_fact_id)""")
def evaluate_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Operating-day fact first, revenue second, then the charge: one case per user.

    The sign-up source reports the operating day (an odd number means yes), the
    purchase source the revenue.
    """
    current = view(spark, sf)
    facts = table(spark, sf, "events").select(
        F.lit("events").alias("ledger_id"), F.col("user_id").cast("string").alias("logical_fact_id")).distinct()
    number = F.get_json_object("value", "$.value").cast("bigint")
    reported = lambda s: ledger.select_fact(current.where(F.col("source_id") == s), sources(spark), facts)
    day = reported("signup").withColumn("value", number % 2 == 1)
    revenue = reported("purchase").withColumn("value", number * 10)
    return evaluation.revenue_case(day, revenue, ["logical_fact_id"])


@query("evaluate_rational_cases", f"""WITH {VIEW},
n AS (SELECT logical_fact_id, source_id, CAST(json_extract(object, '$.value') AS BIGINT) AS x FROM v WHERE known_to IS NULL),
users AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS logical_fact_id, user_id FROM events),
a AS (SELECT logical_fact_id, count(DISTINCT x) AS k, min(x) AS x FROM n WHERE source_id IN ('signup', 'purchase') GROUP BY ALL),
r AS (SELECT logical_fact_id, count(DISTINCT x) AS k, min(x) AS x FROM n WHERE source_id = 'view' GROUP BY ALL),
c AS (SELECT logical_fact_id, count(DISTINCT x) AS k, min(x) AS x FROM n WHERE source_id = 'click' GROUP BY ALL),
b AS (SELECT logical_fact_id, coalesce(r.k, c.k) AS k, coalesce(r.x, c.x) AS x FROM r FULL JOIN c USING (logical_fact_id))
SELECT logical_fact_id, CASE WHEN a.k = 1 THEN 'answerable' ELSE 'insufficient_evidence' END AS acceptance_status,
  CASE WHEN a.k = 1 THEN user_id % 2 = 0 AND 2 * (a.x % 101) < 100 END AS auto_accept,
  CASE WHEN b.k = 1 THEN 'answerable' ELSE 'insufficient_evidence' END AS rating_status,
  CASE WHEN b.k = 1 THEN 20 * (80 + b.x % 21) > 97 * 20 END AS rating_met
FROM users LEFT JOIN a USING (logical_fact_id) LEFT JOIN b USING (logical_fact_id)""")
def evaluate_rational_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Acceptance and rating decided from ledger facts: exact fractions against their bounds, conflicts and gaps as missing evidence.

    Sign-ups and purchases, of equal authority, report the acceptance in
    hundredths; views, and clicks where there is none, the rating in twentieths.
    """
    current = view(spark, sf)
    facts = table(spark, sf, "events").select(
        F.lit("events").alias("ledger_id"), F.col("user_id").cast("string").alias("logical_fact_id")).distinct()
    number = F.get_json_object("value", "$.value").cast("bigint")

    def reported(names: Sequence[str], fraction: Column) -> DataFrame:
        found = ledger.select_fact(current.where(F.col("source_id").isin(*names)), sources(spark), facts)
        return found.select("logical_fact_id", "status", F.when(F.col("value").isNotNull(), fraction).alias("value"))

    program = F.when(F.col("logical_fact_id").cast("bigint") % 2 == 0, exact.ACCEPT_PROGRAM).otherwise("taxi_driver")
    acceptance = evaluation.rational_case(reported(("signup", "purchase"), exact.rational(number % 101, F.lit(100))), ["logical_fact_id"],
                                          lambda value: exact.auto_accept(program, value))
    rating = evaluation.rational_case(reported(("view", "click"), exact.rational(number % 21 + 80, F.lit(20))), ["logical_fact_id"], exact.rating_condition)
    return acceptance.select("logical_fact_id", F.col("status").alias("acceptance_status"), F.col("condition_met").alias("auto_accept")).join(
        rating.select("logical_fact_id", F.col("status").alias("rating_status"), F.col("condition_met").alias("rating_met")), "logical_fact_id")


@query("ledger_record_hash", f"""WITH {VIEW}
SELECT assertion_id, sha256('{{"assertion_id":"' || assertion_id || '","known_from":"' ||
  strftime(known_from, '%Y-%m-%dT%H:%M:%S.%fZ') || '","object":' || object || ',"source_id":"' || source_id || '"}}' || chr(10)) AS payload_hash FROM v""")
def ledger_record_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Payload hash of each record's JSON, which omits commit_seq, text and a declared hash."""
    rows = view(spark, sf).select(
        "assertion_id", F.to_json(F.struct(
            "source_id", F.parse_json("assertion.object").alias("object"), F.lit("x").alias("text"),
            F.lit(7).alias("commit_seq"), instants.utc_text("known_from").alias("known_from"), "assertion_id",
        )).alias("json"))
    return rows.select("assertion_id", identity.payload_hash("json").alias("payload_hash"))
