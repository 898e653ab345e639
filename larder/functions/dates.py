"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone is."""
    c = F.col(ts) if isinstance(ts, str) else ts
    micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    seconds = F.hour(c).cast("bigint") * 3600 + F.minute(c).cast("bigint") * 60
    days = F.unix_date(c.cast("date")).cast("bigint") * 86400
    return (days + seconds) * 1_000_000 + micros


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def trial_end_default(created, days: int = 14) -> Column:
    c = F.col(created) if isinstance(created, str) else created
    return c + F.make_dt_interval(F.lit(days))


def ttl_live(created, now: Column, hours: int = 24) -> Column:
    """Row is younger than ``hours`` at ``now``."""
    c = F.col(created) if isinstance(created, str) else created
    return c > now - F.make_dt_interval(F.lit(0), F.lit(hours))


def days_left(end: Column, now: Column) -> Column:
    """Whole days until ``end``, rounded up."""
    return F.ceil((epoch_micros(end) - epoch_micros(now)) / F.lit(86_400_000_000))


def iso_duration_minutes(text) -> Column:
    """'PT1H30M' -> 90; null for null or for text without a PT mark."""
    c = F.col(text) if isinstance(text, str) else text
    pattern = "(?i)PT(?:(\\d+)H)?(?:(\\d+)M)?"
    part = lambda g: F.coalesce(F.regexp_extract(c, pattern, g).try_cast("int"), F.lit(0))
    return F.when(c.rlike("(?i)PT"), part(1) * 60 + part(2))
