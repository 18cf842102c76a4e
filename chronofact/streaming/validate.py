"""Ledger rules on a stream, one record at a time as it arrives.

What a record, a closing or an opening may do depends on the event of the same
key before it. That event, one small row per key, is the only state: for an
assertion what happened to it last, for a record id and for a place in the
replay order that it has been seen. Records have to arrive in replay order;
one that arrives behind a later record of its key does not change the state
and is reported. A restarted query continues with the state of its checkpoint.

Most keys have an event or two, so they are dealt into buckets by hash and a
bucket is one group of the stream: its state is the table of its keys' last events.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ledger

#: Buckets of keys; stored states depend on the number.
BUCKETS = 4096
HELD = pa.schema([("ledger_id", pa.string()), ("key", pa.string()), ("event", pa.string()), ("micros", pa.int64()), ("source_id", pa.string()),
                  ("commit_seq", pa.int64()), ("input_order", pa.int64()), ("pos", pa.int32())])
STATE = "held binary"
EVENT = ("ledger_id string, key string, record_id string, source_id string, micros bigint, commit_seq bigint, input_order bigint, pos int, "
         "event string, check int, can_correct array<string>")
PRIOR = f"{EVENT}, prior_event string, prior_micros bigint, prior_source string, late boolean"
NAMES = [part.split()[0] for part in EVENT.split(", ")]
#: Stand for null instants and numbers, which come first, and for no failed check; pandas has no null integers.
NO_INSTANT, NO_CHECK = -(1 << 62), -1


def _follow(rows: list[tuple], prior: tuple | None) -> tuple[list[tuple], tuple | None]:
    """The sorted events of one key, each with the one before it, and the last one in replay order."""
    out = []
    for row in rows:
        late = prior is not None and row[4:8] < (prior[1], prior[3], prior[4], prior[5])
        out.append((*row, *((prior[0], prior[1], prior[2]) if prior else (None, NO_INSTANT, None)), late))
        if not late:
            prior = (row[8], row[4], row[3], row[5], row[6], row[7])
    return out, prior


def _rows(parts: Iterator[pd.DataFrame]) -> list[tuple]:
    return [row for part in parts for row in part[NAMES].itertuples(index=False, name=None)]


def _found(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[*NAMES, "prior_event", "prior_micros", "prior_source", "late"])


def look_back(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The events of one key, each with the one before it; the last one stays as state."""
    out, prior = _follow(sorted(_rows(parts), key=lambda r: r[4:8]), state.get if state.exists else None)
    state.update(prior)
    yield _found(out)


def look_back_bucket(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """:func:`look_back` for all keys of a bucket at once; their last events stay as state, as one compressed Arrow table."""
    held = {}
    if state.exists:
        with pa.ipc.open_stream(state.get[0]) as stored:
            held = {row[:2]: row[2:] for batch in stored for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    out = []
    rows = sorted(_rows(parts), key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or "", r[4:8]))
    for key, group in groupby(rows, key=lambda r: r[:2]):
        found, held[key] = _follow(list(group), held.get(key))
        out += found
    columns = zip(*((*key, *last) for key, last in held.items()), strict=True)
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, HELD, strict=True)], schema=HELD)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))
    yield _found(out)


def violations(records: DataFrame, sources: DataFrame, *, check_payload: bool = True) -> DataFrame:
    """:func:`ledger.violations` of a stream of records."""
    events = ledger.keyed_events(records, sources, check_payload=check_payload)
    kind = records.schema["known_at"].dataType.simpleString()
    plain = events.withColumn("micros", F.coalesce(F.unix_micros(F.col("known_at").cast("timestamp")), F.lit(NO_INSTANT))).withColumn(
        "check", F.coalesce("check", F.lit(NO_CHECK))).withColumns({n: F.coalesce(n, F.lit(NO_INSTANT)) for n in ("commit_seq", "input_order")})
    bucket = F.pmod(F.xxhash64("ledger_id", "key"), F.lit(BUCKETS)).cast("int").alias("bucket")
    kept = plain.select(*NAMES, bucket).groupBy("bucket").applyInPandasWithState(look_back_bucket, PRIOR, STATE, "append", GroupStateTimeout.NoTimeout)

    def instant(name: str):
        return F.when(F.col(name) != NO_INSTANT, F.timestamp_micros(name)).cast(kind)

    def number(name: str):
        return F.when(F.col(name) != NO_INSTANT, F.col(name)).alias(name)

    before = kept.select(
        "ledger_id", "record_id", "source_id", instant("micros").alias("known_at"), number("commit_seq"), number("input_order"), "pos", "event",
        F.when(F.col("check") != NO_CHECK, F.col("check")).alias("check"), "can_correct", "late",
        F.when(F.col("prior_event").isNotNull(), F.struct(F.col("prior_event").alias("event"), instant("prior_micros").alias("known_at"),
                                                          F.col("prior_source").alias("source_id"))).alias("_prior"))
    return ledger.judged_events(before, F.col("late"))


def report(records: DataFrame, sources: DataFrame, path: str, checkpoint: str, *, check_payload: bool = True) -> StreamingQuery:
    """Append the violations of everything available to the table at ``path``, exactly once, then stop."""
    return (violations(records, sources, check_payload=check_payload).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
