"""Streaming ledger ingest.

Arrival is append only: a correction is a new record, never an update, so the
stream only has to store what arrives, and the as-of view stays a batch query
over what was stored. No watermark is used: a record that arrives very late is
still part of the ledger. A restarted query continues after the last committed
batch of its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import one_copy


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything available to a table of files, exactly once, then stop."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stored_once(records: DataFrame, key: str) -> DataFrame:
    """One copy of each record, the same in every run, for senders that repeat themselves."""
    return one_copy(records, key)
