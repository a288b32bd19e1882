"""The normalised sample: roles, units and fallbacks at given times, one wide row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.clock import time_of_day_ns
from paddock.functions.geo import finite
from paddock.functions.names import SAMPLE_ROLES, resolve_roles, steps
from paddock.functions.units import convert
from paddock.operators.runs import whole
from paddock.operators.sampling import asof, interpolated

#: Roles whose value is held, not drawn on a line.
HELD = ("gear", "rpm", "lap_number")


def _unit(u: Column) -> Column:
    return F.lower(F.trim(u))


def fraction(v: Column, unit: Column) -> Column:
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(_unit(unit).isin("%", "percent"), clamp(v / 100)).when(_unit(unit).isin("ratio", "fraction"), clamp(v))


def coordinate(v: Column, unit: Column, longitude: bool = False) -> Column:
    u = _unit(unit)
    minutes = v / (-60 if longitude else 60)
    return F.when(u.isin("deg", "degree", "degrees", "°"), v).when(u.isin("rad", "radian", "radians"), F.degrees(v)).when(u.isin("min", "arcmin", "arcminute"), minutes)


def lap_distance(v: Column, unit: Column, length_m: Column) -> Column:
    u, length = _unit(unit), F.when(length_m > 0, length_m)
    return F.when(u.isin("%", "percent"), F.pmod(v / 100, F.lit(1.0))).when(u.isin("ratio", "fraction"), F.pmod(v, F.lit(1.0))).when(u.isin("m", "meter", "metre"), F.pmod(v, length) / length)


def to_wide(probes: DataFrame, channels: DataFrame, samples: DataFrame, recordings: DataFrame, laps: DataFrame | None = None) -> DataFrame:
    """One row of normalised values per probe (recording_id, t_ns); what can't be told is null.

    ``recordings`` has recording_id, clock, clock_offset_ns, length_m (of the track, null if unknown).
    All roles are sampled in one pass: probes meet each recording's role channels, and one as-of join
    serves them all.
    """
    key = ["recording_id", "channel_idx"]
    named = channels.select(*key, "unit", "duration_ns", steps(F.col("name"), F.col("sample_type")).alias("steps"))
    roles = resolve_roles(channels, SAMPLE_ROLES).join(named, key)
    asked = probes.select("recording_id", "t_ns").distinct().join(roles, "recording_id")
    used = samples.join(roles.select(*key).distinct(), key, "left_semi")
    met = asof(asked, used, key, order=("chunk_idx", "local_idx"))
    v = F.when(F.col("t_ns") < F.col("duration_ns"), interpolated(F.col("t_ns"), ~F.col("steps") & ~F.col("role").isin(*HELD)))
    met = met.withColumn("v", F.when(finite(v), v))
    of = lambda role: F.max(F.when(F.col("role") == role, F.struct("v", "unit")))
    wide = met.groupBy("recording_id", "t_ns").agg(*[of(r).alias(r) for r in SAMPLE_ROLES])
    wide = probes.select("recording_id", "t_ns").distinct().join(wide, ["recording_id", "t_ns"], "left").join(recordings, "recording_id", "left")
    val, unit = (lambda r: F.col(f"{r}.v")), (lambda r: F.col(f"{r}.unit"))
    to = lambda r, u: F.when(unit(r) != "", convert(val(r), unit(r), F.lit(u)))
    by_distance = lap_distance(val("lap_distance"), unit("lap_distance"), F.col("length_m"))
    out = wide.select(
        "recording_id",
        "t_ns",
        to("speed", "m/s").alias("speed_mps"),
        *[fraction(val(r), unit(r)).alias(f"{r}_fraction") for r in ("throttle", "brake", "clutch")],
        F.coalesce(to("steering", "deg"), coordinate(val("steering"), unit("steering"))).alias("steering_deg"),
        whole(val("gear")).alias("gear"),
        to("rpm", "rpm").alias("rpm"),
        whole(val("lap_number")).alias("lap_number"),
        by_distance.alias("lap_progress"),
        to("lap_time", "s").alias("lap_time_s"),
        coordinate(val("latitude"), unit("latitude")).alias("latitude_deg"),
        coordinate(val("longitude"), unit("longitude"), True).alias("longitude_deg"),
        F.when(F.col("t_ns") + F.col("clock_offset_ns") >= 0, time_of_day_ns(F.col("t_ns"), F.col("clock_offset_ns"), F.col("clock"))).alias("time_of_day_ns"),
        F.when(F.col("t_ns") + F.col("clock_offset_ns") >= 0, F.col("t_ns") + F.col("clock_offset_ns")).alias("absolute_time_ns"),
    )
    return out if laps is None else with_lap_progress(out, laps)


def with_lap_progress(wide: DataFrame, laps: DataFrame) -> DataFrame:
    """lap_progress filled by the share of the covering lap's time that has passed."""
    starts = laps.select("recording_id", F.col("start_ns").alias("t_ns"), F.struct("start_ns", "end_ns", "duration_ns").alias("lap"))
    met = asof(wide, starts, ["recording_id"], value="lap")
    lap = F.col("before_v")
    passed = F.when((F.col("t_ns") < lap["end_ns"]) & (lap["duration_ns"] > 0), (F.col("t_ns") - lap["start_ns"]) / F.when(lap["duration_ns"] > 0, lap["duration_ns"]))
    return met.withColumn("lap_progress", F.coalesce("lap_progress", passed)).select(*wide.columns)
