"""As-of answers for many requests, each with an instant of its own.

One replay gives the intervals in which assertions are open. A request meets
those of its fact by an equality join; facts with a long history are cut along
time first. Time is dealt into bins of about equal numbers of intervals, and
the bins are the leaves of a binary tree: an interval is kept at the two
leaves where it begins and ends and at the few nodes that cover what lies
between, a request asks the nodes above its leaf. So an interval that spans
all of time costs no more than one that spans a day, and each request meets
each interval at most once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path
from . import ledger
from .skew import fits_broadcast, first_after, lookup_join, with_slices

FACT = ("ledger_id", "logical_fact_id")
#: Intervals and requests of one fact that one task may join.
PER_CELL = 200_000
#: Time is cut into 2^16 bins at most.
DEEPEST = 16


def open_intervals(records: DataFrame, bounds: Sequence[float] = ()) -> DataFrame:
    """Each opening with the half-open interval in which it is known and open.

    It ends with the next closing or opening of the same assertion, whoever
    reports it. ``bounds`` are ``slice_bounds`` of ``known_at``.
    """
    events = ledger.history(records)
    ended = first_after(events, ["ledger_id", "assertion_id"], ["known_at", "commit_seq", "pos"], {"known_to": F.col("known_at")}, bounds)
    return ended.where((F.col("event") == ledger.OPEN) & F.col("known_at").isNotNull()).select(
        "ledger_id", F.col("assertion.logical_fact_id").alias("logical_fact_id"), "assertion_id", "record_id", "source_id",
        F.col("assertion.object").alias("object"), F.col("known_at").alias("known_from"), "known_to")


def _covering(first: Column, end: Column, leaves: int, depth: int) -> Column:
    """The nodes that together cover the leaves from ``first`` to before ``end``; node 1 is the root, the children of n are 2n and 2n + 1."""
    start = F.struct((first + leaves).cast("bigint").alias("lo"), (end + leaves).cast("bigint").alias("hi"),
                     F.array().cast("array<bigint>").alias("nodes"))

    def climb(s: Column, _: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        live = lo < hi
        left, right = live & (lo % 2 == 1), live & (hi % 2 == 1)
        found = F.array_compact(F.array(F.when(left, lo), F.when(right, hi - 1)))
        return F.struct(F.shiftright(F.when(left, lo + 1).otherwise(lo), 1).alias("lo"),
                        F.shiftright(F.when(right, hi - 1).otherwise(hi), 1).alias("hi"), F.concat(s["nodes"], found).alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, climb)["nodes"]


def open_at(intervals: DataFrame, asked: DataFrame, at: str = "known_as_of", keys: Sequence[str] = FACT,
            per_cell: int = PER_CELL) -> DataFrame:
    """Every (asked, interval) pair of equal ``keys`` whose interval holds ``at``.

    ``asked`` has ``keys`` and ``at``, each combination once. Both sides are
    counted, so hand over stored tables where they are costly.
    """
    keys = list(keys)
    holds = (F.col("known_from") <= F.col(at)) & (F.col("known_to").isNull() | (F.col(at) < F.col("known_to")))
    both = (intervals.select(*keys, F.col("known_from").alias("_at")).unionByName(asked.select(*keys, F.col(at).alias("_at"))))
    hot = both.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > per_cell).withColumn("_hot", F.lit(True))
    largest = hot.agg(F.max("_n"), F.sum("_n")).first()
    if not largest[0]:
        return asked.join(intervals, keys).where(holds)
    depth = min(DEEPEST, max(1, math.ceil(math.log2(largest[1] / per_cell))))
    marks = both.join(hot.select(*keys, "_hot"), keys).select(F.unix_micros(F.col("_at").cast("timestamp")).cast("double").alias("_m"))
    shares = [i / (1 << depth) for i in range(1, 1 << depth)]
    bounds = sorted(set(marks.approxQuantile("_m", shares, 1 / (4 << depth))))
    leaves, bins = 1 << depth, len(bounds) + 1
    few = hot.select(*keys, "_hot")
    small = fits_broadcast(few)

    def marked(rows: DataFrame, *salt: str) -> DataFrame:
        found = lookup_join(rows, few, keys, "left", small_fits=small, salt=F.struct(*salt))
        return found.withColumn("_hot", F.coalesce("_hot", F.lit(False)))

    def binned(rows: DataFrame, name: str, into: str) -> DataFrame:
        return with_slices(rows, name, bounds).withColumnRenamed("_slice", into)

    root = F.array(F.lit(0).cast("bigint"))
    cut = binned(binned(marked(intervals, "known_from"), "known_from", "_i"), "known_to", "_j")
    ends = F.array_distinct(F.array_compact(F.array(F.col("_i"), F.when(F.col("known_to").isNotNull(), F.col("_j")))))
    last = F.when(F.col("known_to").isNotNull(), F.col("_j")).otherwise(F.lit(bins))
    nodes = F.concat(F.transform(ends, lambda x: (x + leaves).cast("bigint")), _covering(F.col("_i") + 1, last, leaves, depth))
    kept = cut.withColumn("_node", F.explode(F.when(F.col("_hot"), nodes).otherwise(root))).drop("_i", "_j", "_hot")
    leaf = binned(marked(asked, at), at, "_leaf")
    above = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda h: F.call_function("shiftright", (F.col("_leaf") + leaves).cast("bigint"), h))
    asks = leaf.withColumn("_node", F.explode(F.when(F.col("_hot"), above).otherwise(root))).drop("_leaf", "_hot")
    return asks.join(kept, [*keys, "_node"]).where(holds).drop("_node")


def _stored(rows: DataFrame, label: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def answer_requests(intervals: DataFrame, sources: DataFrame, requests: DataFrame, at: str = "known_as_of",
                    per_cell: int = PER_CELL) -> DataFrame:
    """``requests`` with status, value, authority rank and support of their fact at their own instant ``at``.

    ``requests`` has ledger_id, logical_fact_id and ``at``; none is lost. Equal
    questions are answered once. A null instant or key finds nothing and is
    ``missing``.
    """
    keys = [*FACT, at]
    # Each is read several times, to count, to measure and to join.
    intervals, asked = _stored(intervals, "intervals"), _stored(requests.select(*keys).distinct(), "asked")
    decided = ledger.decide(open_at(intervals, asked, at, per_cell=per_cell), sources, asked, keys)
    known = _stored(decided.where("status <> 'missing'"), "decided")
    found = lookup_join(requests, known, keys, "left", small_fits=fits_broadcast(known), salt=F.struct(*requests.columns))
    return found.withColumns({"status": F.coalesce("status", F.lit("missing")), "support": F.coalesce("support", F.lit(0).cast("bigint"))})
