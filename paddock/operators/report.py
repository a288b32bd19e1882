"""What reports tell of recordings: first values, valid laps, lap numbers at a time, mean positions and their track, video references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.geo import finite, packed_coordinate, valid_fix
from paddock.functions.names import find
from paddock.operators.normalize import coordinate
from paddock.operators.runs import whole
from paddock.operators.sampling import asof, sample_at
from paddock.operators.tracks import nearest_track
from paddock.operators.video import frame_at

#: Points of a recording's span that its position is the mean of, and how far its track may be.
PROBES, TRACK_M = 32, 50_000.0
#: Packets that are read of a recording in index mode.
PACKETS = 19
_MINUTES = ("min", "arcmin", "arcminute")


def retain(channels: DataFrame, samples: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """The channels where ``predicate`` holds, and their samples."""
    kept = channels.where(predicate)
    return kept, samples.join(kept.select("recording_id", "channel_idx"), ["recording_id", "channel_idx"], "left_semi")


def first_value(channels: DataFrame, samples: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """recording_id, first: the first sample of the first channel that ``names`` hit, whole numbers without a point; null if not finite."""
    own = samples.join(find(channels, names), ["recording_id", "channel_idx"])
    first = own.groupBy("recording_id").agg(F.min_by("value", F.struct("chunk_idx", "local_idx")).alias("v"))
    v = F.col("v")
    shown = F.when(F.abs(v - F.rint(v)) < 1e-9, F.format_string("%.0f", v)).otherwise(v.cast("string"))
    return first.select("recording_id", F.when(finite(v), shown).alias("first"))


def valid_laps(laps: DataFrame, by: list[str]) -> DataFrame:
    """by, valid_laps: how many laps are complete."""
    return laps.groupBy(*by).agg(F.count_if("complete").alias("valid_laps"))


def counter_number_at(probes: DataFrame, samples: DataFrame, by: list[str], duration: Column, completed: Column, previous: bool = False) -> DataFrame:
    """``probes`` with number: the lap that a counter tells at each time, or the one before.

    Counters of finished laps are one behind. Null before the first sample, from ``duration`` on, and
    where the counter isn't a whole number.
    """
    met = asof(probes, samples, by, order=("chunk_idx", "local_idx"))
    own = F.when(F.col("t_ns") < duration, whole(F.col("before_v")))
    return met.withColumn("number", own + completed.cast("int") - F.lit(int(previous))).drop("before_t", "before_v", "after_t", "after_v")


def lap_at(probes: DataFrame, laps: DataFrame, by: list[str]) -> DataFrame:
    """``probes`` with lap (number) and lap_progress: the lap that covers each time and the share of it that has passed.

    Laps don't overlap, so the covering one is the last to begin.
    """
    starts = laps.select(*by, F.col("start_ns").alias("t_ns"), F.struct("number", "start_ns", "end_ns").alias("lap"))
    lap = F.col("before_v")
    inside = F.col("t_ns") < lap["end_ns"]
    met = asof(probes, starts, by, value="lap")
    passed = F.try_divide((F.col("t_ns") - lap["start_ns"]).cast("double"), (lap["end_ns"] - lap["start_ns"]).cast("double"))
    return met.withColumns({"lap": F.when(inside, lap["number"]), "lap_progress": F.when(inside, passed)}).drop("before_t", "before_v", "after_t", "after_v")


def mean_fix(channels: DataFrame, samples: DataFrame, latitude: tuple[str, ...], longitude: tuple[str, ...], probes: int = PROBES) -> DataFrame:
    """recording_id, lat, lon, n: the mean of the raw positions at ``probes`` points of the span that both channels cover, with their units.

    Samples lie on the line between neighbours; what isn't finite or is the origin doesn't count.
    """
    key = ["recording_id", "channel_idx"]
    pair = find(channels, latitude, "lat_idx").join(find(channels, longitude, "lon_idx"), "recording_id")
    of = lambda c: channels.select("recording_id", F.col("channel_idx").alias(f"{c}_idx"), F.col("unit").alias(f"{c}_unit"), F.col("duration_ns").alias(f"{c}_ns"))
    held = pair.join(of("lat"), ["recording_id", "lat_idx"]).join(of("lon"), ["recording_id", "lon_idx"])
    steps = F.sequence(F.lit(0).cast("long"), F.lit(probes - 1).cast("long"))
    times = held.withColumn("k", F.explode(steps)).withColumn("t_ns", F.floor(F.least("lat_ns", "lon_ns") * F.col("k") / probes).cast("long"))
    sides = F.array(F.struct(F.col("lat_idx").alias("channel_idx"), F.lit(True).alias("is_lat")), F.struct(F.col("lon_idx").alias("channel_idx"), F.lit(False).alias("is_lat")))
    asked = times.select("recording_id", "t_ns", "k", F.explode(sides).alias("s")).select("recording_id", "s.channel_idx", "t_ns", "k", "s.is_lat")
    used = samples.join(asked.select(*key).distinct(), key, "left_semi")
    got = sample_at(asked, used, channels.withColumn("steps", F.lit(False)))
    fixes = got.groupBy("recording_id", "k").agg(F.max(F.when(F.col("is_lat"), F.col("value"))).alias("lat"), F.max(F.when(~F.col("is_lat"), F.col("value"))).alias("lon"))
    good = finite(F.col("lat")) & finite(F.col("lon")) & ((F.col("lat") != 0) | (F.col("lon") != 0))
    mean = fixes.where(good).groupBy("recording_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n"))
    return mean.join(held.select("recording_id", "lat_unit", "lon_unit"), "recording_id")


def match_track(means: DataFrame, tracks: DataFrame, max_m: float = TRACK_M) -> DataFrame:
    """recording_id, slug, distance_m of the nearest track to a mean position (``mean_fix``); recordings without one are left out.

    Minutes are taken as packed degrees and minutes if they can be, else as minutes, else as degrees: the
    first reading with a track counts.
    """
    lat_unit, lon_unit = F.lower(F.trim("lat_unit")), F.lower(F.trim("lon_unit"))
    minutes = lat_unit.isin(*_MINUTES) & lon_unit.isin(*_MINUTES)
    reading = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    lat, lon = F.col("lat"), F.col("lon")
    packed_lat, packed_lon = packed_coordinate(lat, 90.0, False), packed_coordinate(lon, 180.0, True)
    packed = packed_lat.isNotNull() & packed_lon.isNotNull()
    plain = F.array(reading(lat / 60, -lon / 60), reading(lat, lon))
    readings = F.when(minutes, F.when(packed, F.array(reading(packed_lat, packed_lon))).otherwise(plain)).otherwise(F.array(reading(coordinate(lat, lat_unit), coordinate(lon, lon_unit, True))))
    placed = means.select("recording_id", F.posexplode(readings).alias("nth", "at")).select("recording_id", "nth", "at.lat", "at.lon")
    found = nearest_track(placed.where(valid_fix(F.col("lat"), F.col("lon"))), tracks, max_m, ["recording_id", "nth"])
    return found.groupBy("recording_id").agg(F.min_by(F.struct("slug", "distance_m"), "nth").alias("m")).select("recording_id", "m.*")


def video_reference(probes: DataFrame, file_index: DataFrame, sync_time: DataFrame, frames: DataFrame, by: list[str]) -> DataFrame:
    """``probes`` (by, t_ns, offset_ns) with file_index, sync_time, pts_ns, frame: what shows a time in the linked videos.

    The channels' samples hold until the next one. Indices are rounded; negative ones and what isn't
    finite give null.
    """
    order = ("chunk_idx", "local_idx")
    dropped = ("before_t", "before_v", "after_t", "after_v")
    v = F.col("before_v")
    met = asof(probes, file_index, by, order=order).withColumn("file_index", F.when(finite(v) & (v >= 0), F.round(v).cast("long"))).drop(*dropped)
    met = asof(met, sync_time, by, order=order).withColumn("sync_time", F.when(finite(v), v)).drop(*dropped)
    return frame_at(met, frames, by)


def spaced(counts: DataFrame, n: Column, most: int = PACKETS) -> DataFrame:
    """``counts`` with slot and index: at most ``most`` indexes, evenly spaced from the first (1) to the last (``n``)."""
    k = F.least(n, F.lit(most)).cast("long")
    slots = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    index = F.when(k <= 1, F.lit(1).cast("long")).otherwise(1 + F.floor((n - 1) * F.col("slot") / F.greatest(k - 1, F.lit(1))).cast("long"))
    return counts.withColumn("slot", F.explode(slots)).withColumn("index", index)


def inspection(summaries: DataFrame) -> DataFrame:
    """recording_id, report: each summary's other columns as JSON, in their order."""
    return summaries.select("recording_id", F.to_json(F.struct(*[c for c in summaries.columns if c != "recording_id"]), {"ignoreNullFields": "false"}).alias("report"))
