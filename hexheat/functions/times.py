"""Valid hours, days and hour labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def valid_time(init_ts: Column, lead_h: Column) -> Column:
    return F.timestamp_add("HOUR", lead_h, init_ts)


def hour_label(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm'Z'")


def day_count(d0: Column, d1: Column) -> Column:
    """Days from d0 to d1, both counted."""
    return F.datediff(d1, d0) + 1


def clamp_day(day: Column, lo: Column, hi: Column) -> Column:
    """A NULL day stays NULL."""
    return F.when(day.isNotNull(), F.greatest(lo, F.least(hi, day)))
