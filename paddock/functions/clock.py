"""Clocks: civil time to UTC, GPS time, time of day, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of a GPS week, and of the GPS epoch in Unix time.
GPS_WEEK_MS, GPS_EPOCH_MS = 604_800_000, 315_964_800_000
DAY_NS = 86_400_000_000_000


def civil_to_utc_ns(ns: Column, zone: Column, known: tuple[str, ...]) -> Column:
    """True UTC of a civil instant that was counted as if UTC; null where the zone isn't ``known``.

    An hour that clocks show twice is the later one, as offsets are when it has passed.
    """
    seconds = F.floor(ns / 1_000_000_000).cast("long")
    ok = zone.isin(*known)
    place = F.when(ok, zone).otherwise(F.lit("UTC"))
    shown = lambda utc: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc), place))
    first = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(seconds), place))
    # what the offset a day on makes of it counts if the zone's clocks show the same then
    after = seconds + first + DAY_NS // 1_000_000_000 - shown(first + DAY_NS // 1_000_000_000)
    moved = F.when((after > first) & (shown(after) == seconds), after).otherwise(first)
    return F.when(ok, moved * 1_000_000_000 + F.pmod(ns, F.lit(1_000_000_000)))


def gps_ns(week: Column, itow_ms: Column) -> Column:
    return (week * GPS_WEEK_MS + itow_ms + GPS_EPOCH_MS) * 1_000_000


def utc_from_clock_ns(clock: Column, start_ns: Column, zone: Column, known: tuple[str, ...]) -> Column:
    """GPS clocks pass as they are, UTC-like civil clocks only with a known zone."""
    return F.when(clock == "gps", start_ns).when(clock == "utc", civil_to_utc_ns(start_ns, zone, known))


def time_of_day_ns(t_ns: Column, offset_ns: Column, clock: Column) -> Column:
    """Position in the day; clocks of the time of day aren't wrapped."""
    at = t_ns + offset_ns
    return F.when(clock == "time_of_day", at).otherwise(F.pmod(at, F.lit(DAY_NS)))


def period_ns(hz: Column) -> Column:
    """Nanoseconds of a sample: exact where the rate divides a second, else rounded."""
    return F.when(hz > 0, F.round(1e9 / F.when(hz > 0, hz)).cast("long"))
