"""Event time from the two encodings messages use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def parse_event_time(text) -> Column:
    """ISO-8601 text or epoch seconds, both as text, to a timestamp; else NULL."""
    text = F.col(text) if isinstance(text, str) else text
    seconds = text.try_cast("double")
    return F.when(seconds.isNotNull(), F.timestamp_seconds(seconds)).otherwise(text.try_cast("timestamp"))


def iso_text(ts) -> Column:
    return F.date_format(ts, ISO_MICROS)


def micros(ts) -> Column:
    """Microseconds since the epoch of a zone-less timestamp (session zone UTC)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))
