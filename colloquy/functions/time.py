"""Timestamps: from epoch seconds and to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first second of year 1 and the last of year 9999.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def epoch_to_timestamp(*seconds: Column) -> Column:
    """The first non-null of ``seconds`` (doubles) cut to whole seconds; null where no timestamp can say it."""
    whole = F.coalesce(*seconds).try_cast("bigint")
    return F.when(whole.between(FIRST_SECOND, LAST_SECOND), F.timestamp_seconds(whole))


def rfc3339(ts: Column) -> Column:
    """``2023-11-14T22:13:21+00:00`` (session time zone UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
