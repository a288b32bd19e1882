"""Tracks: nearest facility, progress along a centerline, venues by name.

The catalog of facilities is a dimension of bounded size. It is broadcast only when its size, counted
first, stays under a limit; beyond it, points and facilities meet in grid cells that the distance covers.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.geo import LAT_M, LON_M, haversine_m, project
from paddock.session import materialize, spread

#: Cells of facilities that are broadcast.
BROADCAST_ROWS = 20_000
#: Points of one task, each of which becomes a row a segment.
POINTS = 20_000


def _cells(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    return F.floor((lat + 90) / size).cast("long"), F.floor((lon + 180) / size).cast("long")


def nearest_track(points: DataFrame, tracks: DataFrame, max_m: float, key: list[str]) -> DataFrame:
    """key, slug, distance_m: the nearest facility within ``max_m``, the first by ``ordinal`` at a tie; points without one are left out.

    Facilities are copied to every cell that their circle touches, points lie in one cell, so the join
    is an equi-join on cells.
    """
    size = max(0.05, max_m / 111_000.0)
    t = tracks.select("slug", "ordinal", F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"))
    r_lat = max_m / 6_371_000.0 * 180 / math.pi * 1.001
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.try_divide(F.lit(math.sin(min(math.pi / 2, max_m / 6_371_000.0)) * 1.001), F.cos(F.radians("t_lat"))))))
    r_lon = F.when(F.abs("t_lat") + r_lat >= 89.9, 180.0).otherwise(wide)
    n_lon = math.ceil(360 / size)
    lat_cells = F.sequence(F.floor((F.greatest(F.lit(-90.0), F.col("t_lat") - r_lat) + 90) / size).cast("long"), F.floor((F.least(F.lit(90.0), F.col("t_lat") + r_lat) + 90) / size).cast("long"))
    lo, hi = F.floor((F.col("t_lon") - r_lon + 180) / size).cast("long"), F.floor((F.col("t_lon") + r_lon + 180) / size).cast("long")
    lon_cells = F.array_distinct(F.transform(F.sequence(lo, F.least(hi, lo + n_lon)), lambda c: F.pmod(c, F.lit(n_lon))))
    placed = t.withColumn("_a", F.explode(lat_cells)).withColumn("_b", F.explode(lon_cells))
    # what is broadcast is counted: near the poles a facility lies in many cells
    if placed.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    a, b = _cells(F.col("lat"), F.col("lon"), size)
    met = points.withColumns({"_pa": a, "_pb": F.pmod(b, F.lit(n_lon))}).join(placed, (F.col("_pa") == F.col("_a")) & (F.col("_pb") == F.col("_b")))
    d = met.withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))).where(F.col("distance_m") <= max_m)
    return d.groupBy(*key).agg(F.min_by(F.struct("slug", "distance_m"), F.struct("distance_m", "ordinal")).alias("m")).select(*key, "m.*")


def segments(centerlines: DataFrame, by: list[str]) -> DataFrame:
    """by, seg_idx, a_lat, a_lon, b_lat, b_lon, cum_m, len_m, total_m from points (by, idx, lat, lon)."""
    w = Window.partitionBy(*by).orderBy("idx")
    pairs = centerlines.select(*by, (F.row_number().over(w) - 1).alias("seg_idx"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.lead("lat").over(w).alias("b_lat"), F.lead("lon").over(w).alias("b_lon")).where("b_lat is not null")
    held = pairs.withColumn("len_m", haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    upto = Window.partitionBy(*by).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumns({"cum_m": F.coalesce(F.sum("len_m").over(upto), F.lit(0.0)), "total_m": F.sum("len_m").over(Window.partitionBy(*by))})


def progress(points: DataFrame, segs: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """key, progress (0 to 1), distance_m: the foot on the nearest segment of the point's own track, the first at a tie.

    Segments are written first, so that Spark knows whether they are few: few are broadcast and points stay dealt
    over tasks, where a join by track would give all points of a track to one.
    """
    met = spread(points, *key, each=POINTS).join(materialize(segs), by).withColumn("_f", project(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).where("total_m > 0")
    at = (F.col("cum_m") + F.col("_f.frac") * F.col("len_m")) / F.col("total_m")
    best = F.min_by(F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), at)).alias("progress"), F.col("_f.distance_m").alias("distance_m")), F.struct("_f.distance_m", "seg_idx"))
    return met.groupBy(*key).agg(best.alias("p")).select(*key, "p.*")


def progress_at_size(points: DataFrame, segs: DataFrame, by: list[str], key: list[str], rings: tuple[int, ...] = (1, 3, 9), cell: float | None = None) -> DataFrame:
    """``progress`` for centerlines of many segments: points look in growing rings of grid cells and stop when nothing nearer can lie outside.

    A segment is put in the cells of spots on it that are no further apart than a cell, so what isn't met
    within r rings is at least r - 1/2 cells away in latitude or longitude; a foot nearer than that is the
    nearest. Points that no ring settles (far off the track) meet all segments of their track. ``cell`` is in
    degrees, twice the mean extent of a segment unless given. Points without a place are left out, as are
    tracks of no length. Each round is a table in the shared folder.
    """
    if cell is None:
        wide = segs.agg(F.avg(F.greatest(F.abs(F.col("b_lat") - F.col("a_lat")), F.abs(F.col("b_lon") - F.col("a_lon"))))).first()[0] or 0.0
        cell = max(2 * wide, 1e-5)
    at = lambda v: F.floor(v / cell).cast("long")
    steps = F.ceil(F.greatest(F.abs(F.col("b_lat") - F.col("a_lat")), F.abs(F.col("b_lon") - F.col("a_lon"))) / cell).cast("int")
    share = F.transform(F.sequence(F.lit(0), steps), lambda i: F.when(steps > 0, i / steps).otherwise(0.0))
    on = lambda x: F.struct(at(F.col("a_lat") + x * (F.col("b_lat") - F.col("a_lat"))).alias("_y"), at(F.col("a_lon") + x * (F.col("b_lon") - F.col("a_lon"))).alias("_x"))
    placed = materialize(segs.where("total_m > 0").withColumn("_c", F.explode(F.array_distinct(F.transform(share, on)))).select("*", "_c._y", "_c._x").drop("_c"))
    own = list(dict.fromkeys([*by, *key]))
    left = materialize(points.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").select(*own, "lat", "lon"))
    metres = F.least(F.lit(LAT_M), F.cos(F.radians("lat")) * LON_M) * cell
    done = []
    for r in rings:
        around = F.sequence(F.lit(-r), F.lit(r))
        near = spread(left, *key, each=POINTS).withColumn("_dy", F.explode(around)).withColumn("_dx", F.explode(around)).withColumn("_y", at(F.col("lat")) + F.col("_dy")).withColumn("_x", at(F.col("lon")) + F.col("_dx"))
        # points of one track are dealt over cells, and its cells' segments with them
        met = near.join(placed, [*by, "_y", "_x"]).withColumn("_f", project(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
        best = F.min_by(F.struct(((F.col("cum_m") + F.col("_f.frac") * F.col("len_m")) / F.col("total_m")).alias("progress"), F.col("_f.distance_m").alias("distance_m")), F.struct("_f.distance_m", "seg_idx"))
        found = materialize(met.groupBy(*own, "lat", "lon").agg(best.alias("p"), F.count(F.lit(1)).alias("_compared")).where(F.col("p.distance_m") < (r - 0.5) * metres))
        done.append(found.select(*key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "p.progress")).alias("progress"), F.col("p.distance_m").alias("distance_m")))
        left = materialize(left.join(found.select(*key), key, "left_anti"))
        if left.isEmpty():
            break
    else:
        done.append(progress(left, segs, by, own).select(*key, "progress", "distance_m"))
    return reduce(DataFrame.unionByName, done)


def normalize_venue(v: Column) -> Column:
    """ASCII letters and digits in lower case, words parted by one space where white space, - or _ stood."""
    spaced = F.regexp_replace(v, r"[\s_-]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(spaced), "[^a-z0-9 ]", ""), " +", " "))


def venue_matches(venue: Column, candidate: Column) -> Column:
    """Equal in normal form, or one is the beginning of the other up to a word's end."""
    v, c = normalize_venue(venue), normalize_venue(candidate)
    return (v != "") & ((v == c) | c.startswith(F.concat(v, F.lit(" "))) | v.startswith(F.concat(c, F.lit(" "))))


def venue_track(venues: DataFrame, tracks: DataFrame) -> DataFrame:
    """venue, slug, timezone: the first facility whose name, slug or other name matches.

    Both sides are spread over their leading words, so prefix matches meet in an equi-join.
    """
    v = venues.select("venue").distinct().withColumn("_v", normalize_venue(F.col("venue"))).where("_v != ''")
    heads = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, " "))), lambda n: F.array_join(F.slice(F.split(c, " "), F.lit(1), n), " "))
    names = tracks.select("slug", "ordinal", "timezone", F.explode(F.concat(F.array("name", "slug"), F.coalesce("aka", F.array().cast("array<string>")))).alias("_n")).withColumn("_c", normalize_venue(F.col("_n"))).where("_c != ''")
    shorter = v.join(names.withColumn("_h", F.explode(heads(F.col("_c")))), F.col("_v") == F.col("_h")).select("venue", "slug", "ordinal", "timezone")
    longer = v.withColumn("_h", F.explode(heads(F.col("_v")))).join(names, F.col("_h") == F.col("_c")).select("venue", "slug", "ordinal", "timezone")
    return shorter.unionByName(longer).groupBy("venue").agg(F.min_by(F.struct("slug", "timezone"), "ordinal").alias("t")).select("venue", "t.*")
