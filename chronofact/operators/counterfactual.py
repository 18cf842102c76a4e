"""Which records an answer depends on: the effect of leaving out each one.

An assertion is open if its last event is an opening. Leaving out a record
only changes assertions whose last event is the record's own; the state is
then that of the last event of any other record. So two events of each
assertion say what every removal does, and no ledger is replayed. A fact's
answer without a record follows from the few best groups of (authority,
value) that are left, of which one more is kept than removals can empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import ledger
from .skew import fits_broadcast, lookup_join

FACT = ["ledger_id", "logical_fact_id"]


def last_two(records: DataFrame) -> DataFrame:
    """Per assertion: its last event, and the last event of another record than that one's."""
    events = ledger.history(records)
    at = F.struct("known_at", "commit_seq", "input_order", "pos")
    body = F.struct("record_id", "source_id", (F.col("event") == ledger.OPEN).alias("open"),
                    F.col("assertion.logical_fact_id").alias("fact"), F.col("assertion.object").alias("object"))
    own = events.groupBy("ledger_id", "assertion_id", "record_id").agg(F.max(at).alias("at"), F.max_by(body, at).alias("e"))
    order = W.partitionBy("ledger_id", "assertion_id").orderBy(F.desc("at"), "record_id")
    top = own.withColumn("n", F.row_number().over(order)).where("n <= 2")
    return top.groupBy("ledger_id", "assertion_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("e"))).alias("last"), F.max(F.when(F.col("n") == 2, F.col("e"))).alias("other"))


def _answer(groups: Column) -> Column:
    """Status and value by groups of (rank, object) in order, as :func:`ledger.select_fact` decides."""
    first, second = F.get(groups, F.lit(0)), F.get(groups, F.lit(1))
    conflict = second.isNotNull() & (second["rank"] == first["rank"])
    status = F.when(first.isNull(), "missing").when(first["rank"] == ledger._UNKNOWN, "unknown_source").when(
        conflict, "unresolved_conflict").otherwise("accepted")
    return F.struct(status.alias("status"), F.when(status == "accepted", first["object"]).alias("value"))


def removal_effects(records: DataFrame, sources: DataFrame) -> DataFrame:
    """``ledger_id, logical_fact_id, record_id`` with status and value before and after, where leaving the record out changes them.

    The closings of a record that is left out do not happen; closings of what
    it opened close nothing. ``records`` is used up to its last one: apply
    :func:`ledger.known_prefix` first.
    """
    pairs = last_two(records)

    def shown(side: str, change: int, who: Column) -> Column:
        e = F.col(side)
        return F.when(e["open"], F.struct(e["fact"].alias("logical_fact_id"), e["source_id"].alias("source_id"), e["object"].alias("object"),
                                          F.lit(change).alias("change"), who.alias("record_id")))

    none = F.lit(None).cast("string")
    entries = F.array_compact(F.array(shown("last", 0, none), shown("last", -1, F.col("last.record_id")), shown("other", 1, F.col("last.record_id"))))
    rows = ledger.with_authority(pairs.select("ledger_id", F.explode(entries).alias("e")).select("ledger_id", "e.*"), sources)
    group = [*FACT, F.col("authority_rank").alias("rank"), "object"]
    held = rows.where("change = 0").groupBy(*group).agg(F.count("*").alias("n"))
    changes = rows.where("change <> 0").groupBy(*FACT, "record_id", F.col("authority_rank").alias("rank"), "object").agg(
        F.sum("change").alias("n")).where("n <> 0")
    # a record lies in one row, so what it changes is bounded
    moved = changes.groupBy(*FACT, "record_id").agg(F.collect_list(F.struct("rank", "object", "n")).alias("moved"))
    emptied = moved.agg(F.max(F.size(F.filter("moved", lambda m: m["n"] < 0)))).first()[0] or 0
    order = W.partitionBy(*FACT).orderBy("rank", "object")
    best = (held.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= emptied + 2)
            .groupBy(*FACT).agg(F.array_sort(F.collect_list(F.struct("rank", "object", "n"))).alias("best")))
    both = lookup_join(moved, best, FACT, "left", small_fits=fits_broadcast(best), salt=F.col("record_id"))
    before = F.coalesce(F.col("best"), F.array().cast(best.schema["best"].dataType))

    def same(a: Column, b: Column) -> Column:
        return (a["rank"] == b["rank"]) & a["object"].eqNullSafe(b["object"])

    def left(g: Column) -> Column:
        return g["n"] + F.aggregate(F.filter("moved", lambda m: same(m, g)), F.lit(0).cast("bigint"), lambda t, m: t + m["n"])

    kept = F.filter(before, lambda g: left(g) > 0)
    added = F.filter("moved", lambda m: (m["n"] > 0) & ~F.exists(before, lambda g: same(g, m)))
    strip = lambda a: F.transform(a, lambda g: F.struct(g["rank"].alias("rank"), g["object"].alias("object")))
    after = F.array_sort(F.concat(strip(kept), strip(added)))
    judged = both.select(*FACT, "record_id", _answer(strip(before)).alias("b"), _answer(after).alias("a"))
    return judged.where(~F.col("a").eqNullSafe(F.col("b"))).select(
        *FACT, "record_id", F.col("b.status").alias("status_before"), F.col("b.value").alias("value_before"),
        F.col("a.status").alias("status_after"), F.col("a.value").alias("value_after"))
