"""Race times: milliseconds as M:SS.FFF or H:MM:SS.FFF and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 100 hours.
MOST_MS = 360_000_000
_SHAPE = r"^(?:(\d+):(\d{2}):(\d{2})|(\d+):(\d{2}))\.(\d{3})$"


def in_range(ms: Column) -> Column:
    return ms.between(0, MOST_MS)


def format_ms(ms: Column) -> Column:
    """M:SS.FFF, from an hour on H:MM:SS.FFF; null out of range."""
    h, m, s, f = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    long = F.format_string("%d:%02d:%02d.%03d", h.cast("long"), m.cast("long"), s.cast("long"), f.cast("long"))
    short = F.format_string("%d:%02d.%03d", m.cast("long"), s.cast("long"), f.cast("long"))
    return F.when(in_range(ms), F.when(h > 0, long).otherwise(short))


def parse_ms(text: Column) -> Column:
    """Milliseconds of M:SS.FFF or H:MM:SS.FFF, minutes without an hour unlimited; null if malformed or out of range."""
    g = lambda i: F.regexp_extract(text, _SHAPE, i)
    n = lambda i: F.coalesce(F.try_to_number(g(i), F.lit("9999999999")).cast("long"), F.lit(0))
    seconds = F.when(g(1) != "", n(3)).otherwise(n(5))
    minutes_ok = (g(1) == "") | (n(2) < 60)
    ms = ((n(1) * 60 + n(2) + n(4)) * 60 + seconds) * 1000 + n(6)
    return F.when(text.rlike(_SHAPE) & (seconds < 60) & minutes_ok & in_range(ms), ms.cast("int"))


def mean_ms(ms: Column) -> Column:
    """Aggregate: the mean, rounded half up to whole milliseconds."""
    n = F.count(ms)
    return F.when(n > 0, F.floor((F.sum(ms) + F.floor(n / 2)) / F.when(n > 0, n))).cast("long")


def format_ns(ns: Column) -> Column:
    """m:ss.mmm of a duration in nanoseconds, truncated."""
    ms = F.floor(ns / 1_000_000)
    return F.format_string("%d:%02d.%03d", F.floor(ms / 60_000).cast("long"), (F.floor(ms / 1000) % 60).cast("long"), (ms % 1000).cast("long"))
