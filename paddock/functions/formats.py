"""Strict small formats: plot tokens, hashes, colours, typed span values, visibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paddock.functions import timespan

# Plot classes and their short forms.
PLOTS = (("trace", "t"), ("gauge", "g"), ("compass", "c"))


def plot(token: Column) -> Column:
    """The plot class that a token names, by its long or short form; null if none."""
    found = F.lit(None).cast("string")
    for long, short in PLOTS:
        found = F.when(token.isin(long, short), long).otherwise(found)
    return found


def schema_hash(text: Column) -> Column:
    """Struct hash, error: sixteen lower-case hex digits; an empty text has neither."""
    good = text.rlike("^[0-9a-f]{16}$")
    return F.struct(F.when(good, text).alias("hash"), F.when((text != "") & ~good, "hash must be 16-digit lowercase hex").alias("error"))


def digest(text: Column) -> Column:
    """The 32 bytes that 64 hex digits of either case write; null otherwise."""
    return F.when(text.rlike("^[0-9A-Fa-f]{64}$"), F.unhex(text))


def colour(text: Column) -> Column:
    """Whether a text is # and six hex digits."""
    return F.coalesce(text.rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False))


def span_value(text: Column) -> Column:
    """Struct kind, ms, shown, unit of a span's value: race times are milliseconds and shown as such, all else is text."""
    ms = timespan.parse_ms(text)
    timed = ms.isNotNull()
    return F.struct(
        F.when(timed, "time").otherwise("text").alias("kind"), ms.cast("long").alias("ms"), F.when(timed, timespan.format_ms(ms)).otherwise(text).alias("shown"), F.when(timed, "timespan_ms").otherwise("").alias("unit")
    )


def visible(flags: Column, position: Column) -> Column:
    """Whether the channel at a position is shown: those beyond the flags are."""
    return F.coalesce(F.get(flags, position), F.lit(True))
