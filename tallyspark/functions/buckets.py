"""Time bucket arithmetic of the history queries."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment


def instant(moment: datetime) -> Column:
    """A datetime (naive means UTC) as a TIMESTAMP literal."""
    return F.timestamp_micros(F.lit(micros(moment)))


def micros(moment: datetime) -> int:
    return (as_utc(moment) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def bucket_seconds(start: datetime, end: datetime, width_hours: int | None = None) -> int:
    """Automatic: as many hours as the range has whole days, from 1 to 24.

    Explicit: the given hours, at most the range. Never below one second.
    """
    span = as_utc(end) - as_utc(start)
    if width_hours is None:
        return 3600 * min(24, max(1, span.days))
    return max(1, min(3600 * width_hours, int(span.total_seconds())))


def bucket_start(moment: Column, origin: datetime, width: int) -> Column:
    """Start of the bucket of ``width`` seconds, counted from ``origin``."""
    t = F.unix_micros(moment)
    into = F.pmod(t - F.lit(micros(origin)), F.lit(width * 1_000_000))
    return F.timestamp_micros(t - into)


def range_or_default(start: datetime | None, end: datetime | None, days: int = 30):
    """Open bounds mean the last 30 days."""
    now = datetime.now(timezone.utc)
    return start or now - timedelta(days=days), end or now
