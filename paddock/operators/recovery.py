"""Laps of opened recordings by the best origin that each has, and one row of facts a recording."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions.clock import utc_from_clock_ns
from paddock.functions.names import ROLES, find, normalize
from paddock.operators import laps, report, runs, summary
from paddock.session import materialize

_BY, _KEY = ["recording_id"], ["recording_id", "channel_idx"]
_LAP = ("number", "start_ns", "end_ns", "duration_ns", "complete")
DAY_S = 86_400
#: What a format tells of a recording's origin; a clock's end is null where it follows from the duration.
ORIGIN = (
    "recording_id string, clock string, absolute_start_ns bigint, absolute_end_ns bigint, session_hint string, driver string, vehicle string, venue string, event string, session string, date string, time string, utc_start_ns bigint, timezone string"
)
TEXTS = ("driver", "vehicle", "venue", "event", "session", "date", "time", "timezone")


@cache
def _zones() -> tuple[str, ...]:
    import zoneinfo

    return tuple(sorted(zoneinfo.available_timezones()))


def recover(channels: DataFrame, samples: DataFrame, declared: DataFrame, closed: DataFrame) -> DataFrame:
    """recording_id, number, start_ns, end_ns, duration_ns, complete, origin.

    Declared laps come first, and recordings of ``closed`` (recording_id) have no others. Then come counters with a
    crossing, their boundaries moved to the timer's resets near them; then laps between resets, numbered by
    the counter where there is one and by place else; then the one lap of a counter that never moves.
    """
    rest = channels.join(declared.select(*_BY).union(closed.select(*_BY)).distinct(), _BY, "left_anti")
    ends = rest.groupBy(*_BY).agg(F.coalesce(F.max("duration_ns"), F.lit(0).cast("long")).alias("duration_ns"))
    name = normalize(F.col("name"))
    counters = rest.where(name.isin(*ROLES["lap_number"])).select(*_KEY, "name", F.col("duration_ns").alias("_own"), F.lit(False).alias("_timer"))
    timers = rest.join(find(rest, ROLES["lap_timer"]), _KEY).select(*_KEY, "name", F.col("duration_ns").alias("_own"), F.lit(True).alias("_timer"))
    # the few channels that tell laps are taken out of all samples once
    own = materialize(samples.join(counters.unionByName(timers), _KEY).join(ends, _BY).select(*_KEY, "name", "_own", "_timer", "duration_ns", "local_idx", "t_ns", "value"))
    counted = own.where("not _timer")
    found = laps.counter_laps(counted, _KEY, ["local_idx"], F.col("duration_ns"), laps.completed_counter(F.col("name")))
    counter = materialize(laps.select_counter(found, rest))
    resets = laps.timer_resets(own.where("_timer"), _BY, ["local_idx"], laps.is_progress(F.col("name")))
    timer = _numbered(laps.timer_laps(resets, ends, _BY), counted, counter)
    refined = laps.refine(counter.where("crossings > 0"), timer, _BY)
    return laps.pick(declared, counter, refined, timer, _BY)


def _numbered(timer: DataFrame, counted: DataFrame, counter: DataFrame) -> DataFrame:
    """``timer`` laps with the chosen counter's number at their start where it has one; numbers below one go."""
    chosen = counter.select(*_KEY).distinct()
    values = counted.join(chosen, _KEY).select(*_BY, F.lit(0).alias("chunk_idx"), "local_idx", "t_ns", "value")
    probes = timer.withColumn("t_ns", F.col("start_ns")).withColumnRenamed("number", "_place")
    told = counted.join(chosen, _KEY).groupBy(*_BY).agg(F.max("_own").alias("_own"), F.bool_or(laps.completed_counter(F.col("name"))).alias("_done"))
    met = report.counter_number_at(probes.join(told, _BY, "left"), values, _BY, F.coalesce("_own", F.lit(0).cast("long")), F.coalesce("_done", F.lit(False)))
    return met.withColumn("number", F.coalesce("number", "_place")).where("number > 0").select(*_BY, *_LAP)


def fastest(found: DataFrame, channels: DataFrame, samples: DataFrame, declared: DataFrame) -> DataFrame:
    """The fastest lap of each recording: the declared one (``declared``), else the shortest plausible of ``found``.

    A reference lap channel bounds what is plausible for laps that aren't declared.
    """
    reference = laps.reference_lap_ns(samples.join(find(channels, ROLES["reference_lap"]), _KEY), _BY, ["local_idx"])
    told = found.where("origin = 'authoritative'").select(*_BY).distinct()
    best = laps.fastest_lap(found, _BY, reference.join(told, _BY, "left_anti")).select(*_BY, *_LAP)
    return declared.select(*_BY, *_LAP).unionByName(best.join(declared.select(*_BY), _BY, "left_anti"))


def clocks(channels: DataFrame, samples: DataFrame, origins: DataFrame) -> DataFrame:
    """recording_id, clock, absolute_start_ns, absolute_end_ns, clock_offset_ns, session_hint by precedence: declared, GPS, Unix seconds."""
    ends = channels.groupBy(*_BY).agg(F.coalesce(F.max("duration_ns"), F.lit(0).cast("long")).alias("_lasts"))
    start = F.col("absolute_start_ns")
    cols = ("clock", "absolute_start_ns", "absolute_end_ns", "clock_offset_ns", "session_hint")
    own = origins.where("clock is not null").join(ends, _BY, "left")
    own = own.withColumns({"absolute_end_ns": F.coalesce("absolute_end_ns", start + F.coalesce("_lasts", F.lit(0).cast("long"))), "clock_offset_ns": start, "session_hint": F.coalesce("session_hint", F.lit(""))})
    gps = summary.gps_clock(channels, samples.withColumn("chunk_idx", F.lit(0))).withColumns({"clock": F.lit("gps"), "session_hint": F.concat(F.lit("gps:"), F.col("week").cast("string"))})
    unix = summary.unix_clock(samples.join(find(channels, ROLES["unix_time"]), _KEY), _BY, ["local_idx"])
    unix = unix.withColumns({"clock": F.lit("utc"), "session_hint": F.concat(F.lit("utc:"), F.floor(start / 1_000_000_000 / DAY_S).cast("string"))})
    ranked = [df.select(*_BY, F.struct(F.lit(k).alias("rank"), *cols).alias("c")) for k, df in enumerate((own, gps, unix))]
    best = ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).groupBy(*_BY).agg(F.min_by("c", "c.rank").alias("c"))
    return best.select(*_BY, *[F.col(f"c.{c}").alias(c) for c in cols])


def stints(channels: DataFrame, samples: DataFrame) -> DataFrame:
    """recording_id, driver_id, start_ns, end_ns of the recordings that name their driver in a channel."""
    ends = channels.groupBy(*_BY).agg(F.max("duration_ns").alias("duration_ns"))
    driven = samples.join(find(channels, ROLES["driver"]), _KEY).join(ends, _BY)
    return runs.driver_stints(runs.integer_runs(driven, _BY, ["local_idx"], F.col("duration_ns")), _BY)


def facts(opened: dict[str, DataFrame], venues: DataFrame | None = None) -> DataFrame:
    """One row a recording of ``opened`` (channels, samples, laps, fastest, origins).

    Counts, duration, schema hash, clock with offset and session key, UTC start, time zone (the recording's own,
    else its venue's of ``venues``: venue, timezone), who drove what where, drivers with their stints, laps,
    complete laps and the fastest lap. Missing evidence stays null; a civil clock without a known zone tells no UTC.
    """
    channels, found, origins = opened["channels"], opened["laps"], opened["origins"]
    # the few channels that tell clocks and drivers are taken out of all samples once
    telling = channels.where(normalize(F.col("name")).isin(*[n for r in ("driver", "gps_week", "gps_itow", "unix_time") for n in ROLES[r]])).select(*_KEY)
    samples = materialize(opened["samples"].join(telling, _KEY, "left_semi"))
    base = summary.file_summary(channels).withColumnRenamed("channels", "n_channels").join(summary.schema_hash(channels), _BY, "left")
    base = base.join(clocks(channels, samples, origins), _BY, "left").join(origins.select(*_BY, "utc_start_ns", *TEXTS), _BY, "left")
    if venues is not None:
        places = venues.select(F.col("venue"), F.col("timezone").alias("_zone")).groupBy("venue").agg(F.min("_zone").alias("_zone"))
        base = base.join(places, "venue", "left").withColumn("timezone", F.when(F.coalesce("timezone", F.lit("")) == "", F.col("_zone")).otherwise(F.col("timezone"))).drop("_zone")
    driven = stints(channels, samples).groupBy(*_BY).agg(F.array_sort(F.collect_set("driver_id")).alias("driver_ids"), F.array_sort(F.collect_list(F.struct("start_ns", "end_ns", "driver_id"))).alias("stints"))
    ran = found.groupBy(*_BY).agg(F.count(F.lit(1)).alias("laps"), F.count_if("complete").alias("valid_laps"), F.min("origin").alias("lap_origin"))
    best = opened["fastest"].select(*_BY, F.struct(*_LAP).alias("fastest_lap"))
    for df in (driven, ran, best):
        base = base.join(df, _BY, "left")
    at = F.coalesce(F.when(F.col("clock_offset_ns") >= 0, F.col("clock_offset_ns")), F.col("absolute_start_ns"))
    zone = F.coalesce("timezone", F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    none = F.array().cast("array<bigint>")
    return base.withColumns({
        "session_key": F.concat_ws(":", F.when(F.col("clock").isNotNull(), F.col("session_hint")), F.when(F.col("clock").isNotNull(), F.col("schema_hash"))), "utc_start_ns": F.coalesce("utc_start_ns", utc_from_clock_ns(F.col("clock"), at, zone, _zones())),
        "timezone": zone, "laps": zero("laps"), "valid_laps": zero("valid_laps"), "driver_ids": F.coalesce("driver_ids", none),
    }).withColumn("session_key", F.when(F.col("clock").isNotNull(), F.col("session_key"))).drop("session_hint")
