"""Lap sidecars in XML: beacon markers, declared totals, laps, and the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[lL][dD][xX]").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("recording_id"), F.col("value").alias("text"))


def _tags(name: str) -> Column:
    """Every tag of the name in the text, whatever its quotes and the order of its attributes."""
    return F.regexp_extract_all("text", F.lit(rf"<{name}\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), 0)


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute; null if it has none."""
    found = F.regexp_extract(tag, rf"\s{name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.when(found != "", F.substring(found, F.lit(2), F.length(found) - 2))


def lap_time_ns(text: Column) -> Column:
    """Nanoseconds of minutes, a colon and seconds with any decimals below 60; null otherwise."""
    minutes, seconds = F.regexp_extract(text, r"^\+?(\d+):", 1).try_cast("long"), F.regexp_extract(text, r":\+?(\d+(?:\.\d*)?|\.\d+)$", 1).try_cast("double")
    return F.when(text.rlike(r"^\+?\d+:\+?(\d+\.?\d*|\.\d+)$") & (seconds < 60), minutes * 60_000_000_000 + F.round(seconds * 1e9).cast("long"))


def parse(files: DataFrame) -> DataFrame:
    """recording_id, markers (ns, sorted, distinct), total_laps, fastest_lap, fastest_ns, bad_markers of ``files`` (recording_id, text).

    Markers are those of class BCN alone; bad_markers counts those of them without a time of zero or
    more. Totals and laps below one are null.
    """
    beacons = F.filter(_tags("Marker"), lambda t: _attribute(t, "ClassName") == "BCN")
    ns = F.transform(beacons, lambda t: F.round(_attribute(t, "Time").try_cast("double") * 1000).try_cast("bigint"))
    good = F.filter(ns, lambda t: t.isNotNull() & (t >= 0))
    strings = _tags("String")
    detail = lambda k: F.element_at(F.filter(F.transform(F.filter(strings, lambda t: _attribute(t, "Id") == k), lambda t: _attribute(t, "Value")), lambda v: v.isNotNull()), -1)
    told = lambda k: F.when(F.exists(strings, lambda t: (_attribute(t, "Id") == k) & _attribute(t, "Value").isNotNull()), detail(k))
    positive = lambda v: F.when(v > 0, v)
    return files.select(
        "recording_id",
        F.array_sort(F.array_distinct(good)).alias("markers"),
        positive(told("Total Laps").try_cast("int")).alias("total_laps"),
        positive(told("Fastest Lap").try_cast("bigint")).alias("fastest_lap"),
        lap_time_ns(told("Fastest Time")).alias("fastest_ns"),
        (F.size(ns) - F.size(good)).alias("bad_markers"),
    )


def to_laps(parsed: DataFrame, durations: DataFrame) -> DataFrame:
    """Laps between markers up to duration_ns; the first and the tail are incomplete, a declared fastest lap replaces its own."""
    met = parsed.join(durations, "recording_id").withColumn("m", F.filter("markers", lambda t: t <= F.col("duration_ns")))
    n = F.least(F.coalesce("total_laps", F.size("m") + 1), F.size("m") + 1)
    each = met.withColumn("number", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n)))).where(F.col("number") <= n)
    end = F.get("m", F.col("number") - 1)
    laps = each.select("recording_id", F.col("number").cast("long").alias("number"), F.coalesce(F.get("m", F.col("number") - 2), F.lit(0).cast("long")).alias("start_ns"), F.coalesce(end, "duration_ns").alias("end_ns"), (end.isNotNull() & (F.col("number") > 1)).alias("complete"), F.lit(1).alias("_rank")).where("end_ns > start_ns")
    best_end = F.get("m", (F.col("fastest_lap") - 1).cast("int"))
    best = met.where(F.col("fastest_ns").isNotNull() & (F.col("fastest_lap") >= 1)).select("recording_id", F.col("fastest_lap").alias("number"), (best_end - F.col("fastest_ns")).alias("start_ns"), best_end.alias("end_ns"), F.lit(True).alias("complete"), F.lit(0).alias("_rank")).where("start_ns >= 0")
    both = laps.unionByName(best).withColumn("_best", F.min("_rank").over(Window.partitionBy("recording_id", "number"))).where("_rank = _best")
    return both.select("recording_id", "number", "start_ns", "end_ns", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"), "complete")


def lap_summary(markers: DataFrame) -> DataFrame:
    """recording_id, total_laps, fastest_ns, fastest_lap from markers (recording_id, t_ns)."""
    w = Window.partitionBy("recording_id").orderBy("t_ns")
    d = markers.withColumns({"_d": F.lead("t_ns").over(w) - F.col("t_ns"), "_i": F.row_number().over(w)})
    return d.groupBy("recording_id").agg((F.count(F.lit(1)) + 1).alias("total_laps"), F.min("_d").alias("fastest_ns"), F.min_by(F.col("_i") + 1, F.when(F.col("_d").isNotNull(), F.struct("_d", "_i"))).cast("long").alias("fastest_lap"))


def to_xml(markers: DataFrame) -> DataFrame:
    """recording_id, text: the sidecar document of markers (recording_id, t_ns)."""
    w = Window.partitionBy("recording_id").orderBy("t_ns")
    rows = markers.withColumn("i", F.row_number().over(w)).select("recording_id", "i", F.format_string('<Marker Version="100" ClassName="BCN" Name="Manual.%d" Flags="77" Time="%.17e"/>', "i", F.col("t_ns") / 1000.0).alias("x"))
    body = rows.groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]), "\n").alias("b")).join(lap_summary(markers), "recording_id")
    ms = F.floor(F.col("fastest_ns") / 1_000_000)
    time = F.format_string("%d:%02d.%03d", F.floor(ms / 60_000), F.floor(ms / 1000) % 60, ms % 1000)
    best = F.when(F.col("fastest_ns").isNotNull(), F.concat(F.lit('<String Id="Fastest Time" Value="'), time, F.lit('"/><String Id="Fastest Lap" Value="'), F.col("fastest_lap").cast("string"), F.lit('"/>'))).otherwise("")
    return body.select("recording_id", F.concat(F.lit('<?xml version="1.0"?>\n<LDXFile><Layers><Layer><MarkerBlock><MarkerGroup Name="Beacons">\n'), "b", F.lit('\n</MarkerGroup></MarkerBlock></Layer><Details><String Id="Total Laps" Value="'), F.col("total_laps").cast("string"), F.lit('"/>'), best, F.lit("</Details></Layers></LDXFile>")).alias("text"))
