"""Track catalogs as JSON lines: a facility with its layouts and their centerlines on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.sources import jsonl

_LINE = "coordinates:array<array<double>>"
_LAYOUT = f"id:string,name:string,length_m:double,direction:string,centerline_geojson:struct<{_LINE},geometry:struct<{_LINE}>>"
_TRACK = f"slug string, name string, country string, aka array<string>, location struct<lat:double,lon:double,timezone:string>, layouts array<struct<{_LAYOUT}>>"


def parse(lines: DataFrame) -> dict[str, DataFrame]:
    """tracks, layouts, points and problems of ``lines`` (n, line); a track's ordinal is n.

    A line that isn't JSON, or lacks slug, name, a location on Earth or layouts with ids, is a problem and no track;
    so is a slug that a line before it has. Missing countries and time zones are empty. A centerline may be a
    geometry or a feature; points without two finite numbers are left out.
    """
    read = lines.where(F.trim("line") != "").select(F.col("n").alias("ordinal"), F.from_json("line", _TRACK).alias("t"))
    t = F.col("t")
    ok = lambda c: F.coalesce(c, F.lit(False))
    problem = (
        F.when(~ok(t["slug"] != ""), "catalog.slug").when(t["name"].isNull(), "catalog.name")
        .when(~ok(t["location"]["lat"].between(-90, 90) & t["location"]["lon"].between(-180, 180)), "catalog.location").when(~ok(F.size(t["layouts"]) > 0), "catalog.layouts")
        .when(F.exists(t["layouts"], lambda x: x["id"].isNull() | x["name"].isNull()), "catalog.layout")
    )
    told = read.withColumn("problem", problem)
    first = told.where("problem is null").groupBy(t["slug"].alias("slug")).agg(F.min("ordinal").alias("first"))
    told = told.join(first, t["slug"] == F.col("slug"), "left").withColumn("problem", F.coalesce("problem", F.when(F.col("ordinal") != F.col("first"), "catalog.repeated")))
    good = told.where("problem is null")
    empty = lambda c: F.coalesce(c, F.lit(""))
    tracks = good.select(
        "ordinal", t["slug"].alias("slug"), t["name"].alias("name"), empty(t["country"]).alias("country"), F.coalesce(t["aka"], F.array().cast("array<string>")).alias("aka"), t["location"]["lat"].alias("latitude"), t["location"]["lon"].alias("longitude"), empty(t["location"]["timezone"]).alias("timezone"),
    )
    each = good.select(t["slug"].alias("slug"), F.posexplode(t["layouts"]).alias("nth", "l"))
    layouts = each.select("slug", "nth", F.col("l.id").alias("layout"), F.col("l.name").alias("name"), F.col("l.length_m").alias("length_m"), F.col("l.direction").alias("direction"))
    line = F.coalesce(F.col("l.centerline_geojson.coordinates"), F.col("l.centerline_geojson.geometry.coordinates"))
    spot = each.select("slug", F.col("l.id").alias("layout"), F.posexplode(line).alias("idx", "p")).select("slug", "layout", "idx", F.get("p", F.lit(1)).alias("lat"), F.get("p", F.lit(0)).alias("lon"))
    points = spot.where("lat between -90 and 90 and lon between -180 and 180")
    return {"tracks": tracks, "layouts": layouts, "points": points, "problems": told.where("problem is not null").select("ordinal", t["slug"].alias("slug"), "problem")}


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``parse`` of a file or of a folder with one catalog."""
    return parse(jsonl.read_lines(spark, path).select("n", "line"))
