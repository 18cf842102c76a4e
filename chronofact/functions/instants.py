"""UTC instants and bitemporal eligibility."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

_HAS_OFFSET = r"(?i)(z|[+-]\d{2}:?\d{2})$"


def _shown(ntz: Column) -> Column:
    """Zone-less timestamp as text with six digits and ``Z``."""
    text = ntz.cast("string")
    digits = F.rpad(F.coalesce(F.substring(text, 21, 6), F.lit("")), 6, "0")
    return F.concat(F.translate(F.substring(text, 1, 19), " ", "T"), F.lit("."), digits, F.lit("Z"))


def _in_utc(ts: Column) -> Column:
    """The UTC clock at an instant, from its distance to the epoch, so whatever the zone of the session."""
    seconds = (F.unix_micros(ts.cast("timestamp")).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def utc(text: Column | str) -> Column:
    """Offset-carrying timestamp text as UTC text with six digits and ``Z``.

    Text without an offset is an error. The time zone of the session does not matter.
    """
    text = col(text)
    checked = F.when(text.rlike(_HAS_OFFSET), text).otherwise(
        F.raise_error(F.lit("timestamp must be timezone-aware"))
    )
    return F.when(text.isNotNull(), _shown(_in_utc(F.to_timestamp(checked))))


def utc_text(ts: Column | str) -> Column:
    """Canonical text of a timestamp column; zone-less values count as UTC."""
    ts = col(ts)
    return _shown(F.when(F.typeof(ts) == "timestamp_ntz", ts.cast("timestamp_ntz")).otherwise(_in_utc(ts)))


def _known(known_from: Column, known_to: Column, as_of: Column) -> Column:
    return (known_from <= as_of) & (known_to.isNull() | (as_of < known_to))


def interval_eligible(valid_from: Column, valid_to: Column, known_from: Column, known_to: Column,
                      at: Column, as_of: Column) -> Column:
    """A state holds at ``at`` and is known at ``as_of``; both intervals half open."""
    return (valid_from <= at) & (valid_to.isNull() | (at < valid_to)) & _known(known_from, known_to, as_of)


def point_eligible(event_time: Column, window_start: Column, window_end: Column, known_from: Column,
                   known_to: Column, as_of: Column) -> Column:
    """A point event lies in the half-open window and is known at ``as_of``."""
    return (window_start <= event_time) & (event_time < window_end) & _known(known_from, known_to, as_of)
