"""Hour keys, cut-offs and zero-padded UTC parts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_key(prefix: str = "") -> Column:
    """``concat(year, month, day, hour)`` - partition-prunable derived key."""
    p = f"{prefix}." if prefix else ""
    return F.concat(F.col(f"{p}year"), F.col(f"{p}month"), F.col(f"{p}day"), F.col(f"{p}hour"))


def _utc(now: dt.datetime) -> dt.datetime:
    if now.tzinfo is not None:
        now = now.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return now


def view_cutoff(now: dt.datetime) -> str:
    """``date_format(date_trunc('hour', now - 15 min - 1 h), '%Y%m%d%H')``.

    Computed once per query on the driver (it is a constant of the plan,
    exactly what Catalyst's constant folding would produce from
    ``current_timestamp``); injectable for tests."""
    t = _utc(now) - dt.timedelta(minutes=15) - dt.timedelta(hours=1)
    return t.strftime("%Y%m%d%H")


def hour_parts(ts: dt.datetime) -> dict[str, str]:
    t = _utc(ts)
    return {"year": f"{t.year:04d}", "month": f"{t.month:02d}", "day": f"{t.day:02d}", "hour": f"{t.hour:02d}"}


def next_hour(now: dt.datetime) -> dict[str, str]:
    """D3: the hour after ``now`` (UTC now + 60 min)."""
    return hour_parts(_utc(now) + dt.timedelta(minutes=60))


def compaction_hour(now: dt.datetime) -> dict[str, str]:
    """The hour compacted at ``now`` (UTC now - 120 min)."""
    return hour_parts(_utc(now) - dt.timedelta(minutes=120))


def parts_of(ts: Column) -> dict[str, Column]:
    """Zero-padded UTC parts of a timestamp column."""
    return {"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"),
            "day": F.date_format(ts, "dd"), "hour": F.date_format(ts, "HH")}


def ntz_as_utc_instant(ts: Column) -> Column:
    """TIMESTAMP whose UTC wall clock is the given TIMESTAMP_NTZ, whatever the
    session time zone (a plain cast would read the wall clock in the session
    zone and misalign hourly windows in zones with half-hour offsets)."""
    secs = F.date_format(ts, "ss.SSSSSS").cast("decimal(8,6)")
    return F.make_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), secs, F.lit("UTC"))


def micros_to_ntz(micros: Column) -> Column:
    """TIMESTAMP_NTZ of an epoch-microsecond count, read as UTC wall clock."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))   # from text: no zone involved
    return epoch + F.make_dt_interval(secs=micros / F.lit(1_000_000.0))


def instant_to_ntz(ts: Column) -> Column:
    """Inverse of :func:`ntz_as_utc_instant`."""
    return micros_to_ntz(F.unix_micros(ts))
