"""Append-only bitemporal ledger: history, validation, as-of view, authority.

Records: ledger_id, record_id, source_id, known_at, commit_seq, input_order,
operation (assert | replace | retract), target_assertion_ids array<string>,
assertions array<struct<assertion_id, logical_fact_id, predicate, object, ...>>
where ``object`` is canonical JSON text. ``input_order`` is the arrival number
of the record; a DataFrame has no order of its own.

Sources: source_id, authority_rank (lower wins), allowed_predicates,
can_correct_source_ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import payload_hash
from .skew import last_before

CLOSE, OPEN = "close", "open"
#: Ranks beside the registered ones: before all, of a source that is not registered; after all, of one without a rank.
_UNKNOWN, _NO_RANK = -(1 << 31), (1 << 31) - 1

# Violations in the order in which a record is checked.
CHECKS = (
    "duplicate record_id",
    "replay order is not strict",
    "payload hash mismatch",
    "assert cannot target",
    "retract cannot assert",
    "revision requires targets",
    "unknown source",
    "target is not active",
    "target must be known strictly earlier",
    "unauthorized correction",
    "duplicate active assertion",
    "source predicate not authorized",
)
_CHECK_NO = {name: i for i, name in enumerate(CHECKS)}


def known_prefix(records: DataFrame, as_of: Column) -> DataFrame:
    """Records known at ``as_of``, inclusive.

    Apply this before :func:`history`: a record that arrives later must
    neither close an assertion nor invalidate the earlier state.
    """
    return records.where(F.col("known_at") <= as_of)


def _targets() -> Column:
    return F.coalesce("target_assertion_ids", F.array().cast("array<string>"))


def _assertions(records: DataFrame) -> Column:
    return F.coalesce("assertions", F.array().cast(records.schema["assertions"].dataType))


def history(records: DataFrame) -> DataFrame:
    """One row per closing or opening of an assertion, in replay position.

    Within a record every target is closed before any assertion is opened.
    A null list counts as empty.
    """
    body = records.schema["assertions"].dataType.elementType
    none = F.lit(None).cast(body)
    targets, asserted = _targets(), _assertions(records)
    closes = F.transform(targets, lambda t, i: F.struct(
        i.alias("pos"), F.lit(CLOSE).alias("event"), t.alias("assertion_id"), none.alias("assertion")))
    opens = F.transform(asserted, lambda a, i: F.struct(
        (F.size(targets) + i).alias("pos"), F.lit(OPEN).alias("event"),
        a["assertion_id"].alias("assertion_id"), a.alias("assertion")))
    keep = ["ledger_id", "record_id", "source_id", "known_at", "commit_seq", "input_order"]
    return records.select(*keep, F.explode(F.concat(closes, opens)).alias("e")).select(
        *keep, "e.pos", "e.event", "e.assertion_id", "e.assertion")


def as_of_view(records: DataFrame, as_of: Column) -> DataFrame:
    """Every assertion known at ``as_of`` with its known interval.

    A closed assertion has ``known_to``; one opened again shows its latest
    opening only. Expects a valid ledger. One aggregation with map-side
    combine, whatever the length of a single assertion's history.
    """
    events = history(known_prefix(records, as_of))
    position = F.struct("known_at", "commit_seq", "pos")
    opened = F.col("event") == OPEN
    latest = events.groupBy("ledger_id", "assertion_id").agg(
        F.max_by(F.struct("assertion", "record_id", "source_id"), F.when(opened, position)).alias("o"),
        F.max(F.when(opened, position)).alias("opened"),
        F.max(F.when(~opened, position)).alias("closed"),
    )
    return latest.where("opened is not null").select(
        "ledger_id", "assertion_id", F.col("o.assertion.logical_fact_id").alias("logical_fact_id"),
        F.col("o.assertion").alias("assertion"), F.col("o.record_id").alias("record_id"),
        F.col("o.source_id").alias("source_id"), F.col("opened.known_at").alias("known_from"),
        F.when(F.col("closed") > F.col("opened"), F.col("closed.known_at")).alias("known_to"),
    )


def decide(open_rows: DataFrame, sources: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status of each of ``facts``, which has ``keys``, by its ``open_rows``: keys, assertion_id, source_id, object.

    Two partial aggregations; assertions of one fact are never gathered in one place.
    """
    keys = list(keys)
    per_rank = with_authority(open_rows, sources).groupBy(*keys, "authority_rank").agg(
        F.min("object").alias("low"), F.max("object").alias("high"),
        F.count("*").alias("support"), F.min("assertion_id").alias("first_assertion_id"))
    best = per_rank.groupBy(*keys).agg(F.min_by(F.struct(
        "authority_rank", "low", "high", "support", "first_assertion_id"), "authority_rank").alias("b"))
    unknown = F.col("b.authority_rank") == _UNKNOWN
    agreed = (F.col("b.low") == F.col("b.high")) & ~unknown
    return facts.join(best, keys, "left").select(
        *keys,
        F.when(F.col("b").isNull(), "missing").when(unknown, "unknown_source").when(agreed, "accepted")
        .otherwise("unresolved_conflict").alias("status"),
        F.when(agreed, F.col("b.low")).alias("value"),
        F.when(~unknown, F.col("b.authority_rank")).alias("authority_rank"),
        F.coalesce("b.support", F.lit(0).cast("bigint")).alias("support"),
        F.col("b.first_assertion_id").alias("first_assertion_id"),
    )


def with_authority(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the ``authority_rank`` of their source; one that is not registered comes before all ranks."""
    known = sources.select("source_id", F.coalesce("authority_rank", F.lit(_NO_RANK)).alias("authority_rank"))
    return rows.join(known, "source_id", "left").withColumn("authority_rank", F.coalesce("authority_rank", F.lit(_UNKNOWN)))


def select_fact(view: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """Status of each requested (ledger_id, logical_fact_id).

    ``accepted`` with the value when the open assertions of the best authority
    agree, ``unresolved_conflict`` when they differ, ``missing`` when none is
    open, ``unknown_source`` when an open assertion comes from a source that is
    not registered, since no authority can then be the best. Objects compare
    by their canonical text.
    """
    open_rows = view.where("known_to is null").select(
        "ledger_id", "logical_fact_id", "assertion_id", "source_id", F.col("assertion.object").alias("object"))
    return decide(open_rows, sources, facts, ["ledger_id", "logical_fact_id"])


def supporting_assertions(view: DataFrame, sources: DataFrame, decisions: DataFrame) -> DataFrame:
    """The open assertions of the best authority behind each decision, one row each."""
    ranked = view.where("known_to is null").join(sources.select("source_id", "authority_rank"), "source_id")
    chosen = decisions.where("status <> 'missing'").select("ledger_id", "logical_fact_id", "authority_rank", "status")
    return ranked.join(chosen, ["ledger_id", "logical_fact_id", "authority_rank"]).select(
        "ledger_id", "logical_fact_id", "status", "assertion_id", F.col("assertion.object").alias("object"))


def _first_check(checks: dict[str, Column]) -> Column:
    """The number of the first check that fails; null where all hold."""
    return F.coalesce(*[F.when(failing, F.lit(_CHECK_NO[name])) for name, failing in checks.items()])


def payload_differs(declared: str = "payload_hash", payload: str = "raw_payload") -> Column:
    """Whether the declared hash is not that of the record's own JSON; a missing hash differs."""
    return ~F.coalesce(F.col(declared) == payload_hash(payload), F.lit(False))


RECORD, PLACE = "record", "place"


def violations(records: DataFrame, sources: DataFrame, bounds: Sequence[float] = (), *, check_payload: bool = True) -> DataFrame:
    """Every row-level violation, assuming the rows before it were accepted.

    Copies of a record id or of a place in the replay order are violations
    each, from the second on. Of a record's own checks, and of those of each
    closing and opening, the first failing one counts. The hash of
    ``raw_payload`` is compared with ``payload_hash`` unless ``check_payload``
    is false. ``bounds`` are ``slice_bounds`` of ``known_at``, for ledgers in
    which one assertion may have a very long history.

    One pass: a record adds two rows of position -1 to its closings and
    openings, keyed by its id and by its place, so the same look-back finds
    repeated ids, repeated places and the state of assertions.
    """
    before = last_before(
        keyed_events(records, sources, check_payload=check_payload), ["ledger_id", "key"], ["known_at", "commit_seq", "input_order", "pos"],
        {"_prior": F.struct(F.col("event").alias("event"), F.col("known_at").alias("known_at"),
                            F.col("source_id").alias("source_id"))}, bounds)
    return judged_events(before)


def keyed_events(records: DataFrame, sources: DataFrame, *, check_payload: bool = True) -> DataFrame:
    """Every closing and opening by its assertion, and every record by its id and by its place, with what each breaks by itself.

    Row by row, so ``records`` may be a stream.
    """
    known = sources.select("source_id", F.lit(True).alias("_known"), "allowed_predicates", "can_correct_source_ids")
    shape = records.join(known, "source_id", "left")
    targets, asserted = _targets(), _assertions(records)
    own = {
        "assert cannot target": (F.col("operation") == "assert") & (F.size(targets) > 0),
        "retract cannot assert": (F.col("operation") == "retract") & (F.size(asserted) > 0),
        "revision requires targets": F.col("operation").isin("replace", "retract") & (F.size(targets) == 0),
        "unknown source": F.col("_known").isNull(),
    }
    if check_payload:
        own = {"payload hash mismatch": payload_differs(), **own}

    def entry(pos: Column, event: str, key: Column, check: Column, correct: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), F.lit(event).alias("event"), key.alias("key"), check.cast("int").alias("check"),
                        correct.alias("can_correct"))

    no_check, nobody = F.lit(None).cast("int"), F.lit(None).cast("array<string>")
    kind = records.schema["known_at"].dataType.simpleString()
    place = F.concat_ws("|", F.lit("place"), F.coalesce(F.col("known_at").cast("string"), F.lit(kind)), F.col("commit_seq").cast("string"))
    marks = F.array(
        entry(F.lit(-1), RECORD, F.concat(F.lit("record|"), F.coalesce("record_id", F.lit(""))), _first_check(own), nobody),
        entry(F.lit(-1), PLACE, place, no_check, nobody))
    # An unknown source has no rights to judge by; the other checks still apply.
    closes = F.transform(targets, lambda t, i: entry(i, CLOSE, F.concat(F.lit("a|"), t), no_check, F.col("can_correct_source_ids")))
    opens = F.transform(asserted, lambda a, i: entry(
        F.size(targets) + i, OPEN, F.concat(F.lit("a|"), a["assertion_id"]),
        F.when(~F.array_contains("allowed_predicates", a["predicate"]), _CHECK_NO["source predicate not authorized"]), nobody))
    keep = ["ledger_id", "record_id", "source_id", "known_at", "commit_seq", "input_order"]
    return shape.select(*keep, F.explode(F.concat(marks, closes, opens)).alias("e")).select(*keep, "e.*")


def judged_events(before: DataFrame, late: Column | None = None) -> DataFrame:
    """The violations of events that know ``_prior``, the event of their key before them; ``late`` ones break the replay order."""
    active = F.coalesce(F.col("_prior.event") == OPEN, F.lit(False))
    closing, opening = F.col("event") == CLOSE, F.col("event") == OPEN
    repeated = F.col("_prior").isNotNull()
    replay = _first_check({
        "target is not active": closing & ~active,
        "target must be known strictly earlier": closing & (F.col("_prior.known_at") >= F.col("known_at")),
        "unauthorized correction": closing & ~F.array_contains("can_correct", F.col("_prior.source_id")),
        "duplicate active assertion": opening & active,
    })
    failed = F.array_compact(F.array(
        F.when((F.col("event") == RECORD) & repeated, _CHECK_NO["duplicate record_id"]),
        F.when((F.col("event") == PLACE) & (repeated if late is None else repeated | late), _CHECK_NO["replay order is not strict"]),
        F.coalesce(replay, F.col("check"))))
    return before.select(
        "ledger_id", "record_id", "known_at", "commit_seq", "input_order", "pos", F.explode(failed).alias("check")).withColumn(
        "violation", F.element_at(F.array(*[F.lit(c) for c in CHECKS]), F.col("check") + 1))


def validate_ledger(records: DataFrame, sources: DataFrame, bounds: Sequence[float] = (), *, check_payload: bool = True) -> DataFrame:
    """The first violation of each ledger in replay order; valid ledgers have no row."""
    found = violations(records, sources, bounds, check_payload=check_payload)
    first = found.groupBy("ledger_id").agg(F.min(F.struct(
        "known_at", "commit_seq", "input_order", "pos", "check", "violation", "record_id")).alias("v"))
    return first.select("ledger_id", "v.violation", "v.record_id", "v.known_at", "v.commit_seq")


def reduce_prefix(records: DataFrame, sources: DataFrame, as_of: Column, bounds: Sequence[float] = (), *,
                  check_payload: bool = True) -> tuple[DataFrame, DataFrame]:
    """The as-of view of the ledgers whose prefix known at ``as_of`` is valid, and the first violation of each other ledger.

    A ledger is in exactly one of the two, also one whose id is null, so an invalid history never looks like a state.
    """
    prefix = known_prefix(records, as_of)
    rejected = validate_ledger(prefix, sources, bounds, check_payload=check_payload)
    bad = rejected.select(F.col("ledger_id").alias("_bad"))
    return as_of_view(prefix, as_of).join(bad, F.col("ledger_id").eqNullSafe(F.col("_bad")), "left_anti"), rejected
