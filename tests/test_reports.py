"""Dates, small formats, reports and the GPS passes on small tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from paddock.functions import dates, formats
from paddock.operators import passes, report

CHANNELS = "recording_id bigint, channel_idx int, id int, name string, unit string, unit_source string, sample_type string, sample_count bigint, duration_ns bigint"
SAMPLES = "recording_id bigint, channel_idx int, chunk_idx int, local_idx bigint, t_ns bigint, value double"


def test_dates(spark):
    texts = {"2024-02-29": dt.date(2024, 2, 29), "29/02/2024": dt.date(2024, 2, 29), " 2023 / 1 / 2": dt.date(2023, 1, 2), "2023-02-29": None, "1/2": None, "": None, "x/y/z": None, "2024/13/01": None, None: None, "-1-2-3": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", dates.parse(F.col("t")).alias("d")).collect()} == texts
    day = dt.date(2020, 1, 10)
    rows = [(day, day), (day, day + dt.timedelta(729)), (day, day + dt.timedelta(730)), (day, day - dt.timedelta(7)), (day, day - dt.timedelta(8)), (None, day), (day, None), (None, None)]
    df = spark.createDataFrame(rows, "a date, b date").select("*", dates.select(F.col("a"), F.lit("gps_clock"), F.col("b")).alias("e"))
    got = [(r["e"]["selected"], r["e"]["source"], r["e"]["warning"] is not None) for r in df.collect()]
    own, file = (day, "gps_clock", False), "file_created_at"
    assert got == [own, own, (day + dt.timedelta(730), file, True), own, (day - dt.timedelta(8), file, True), (day, file, False), own, (None, None, False)]


def test_formats(spark):
    df = spark.createDataFrame([("trace", "0" * 16, "#a0B1c2", "ab" * 32), ("T", "0" * 15 + "A", "#a0B1c", "zz" * 32), (None, "", None, "")], "p string, h string, c string, d string")
    got = df.select(formats.plot(F.col("p")), formats.schema_hash(F.col("h")), formats.colour(F.col("c")), formats.digest(F.col("d")), formats.span_value(F.col("p"))["kind"]).collect()
    assert [tuple(r)[0] for r in got] == ["trace", None, None] and [tuple(r[1]) for r in got] == [("0" * 16, None), (None, "hash must be 16-digit lowercase hex"), (None, None)]
    assert [r[2] for r in got] == [True, False, False] and [r[3] is not None for r in got] == [True, False, False] and {r[4] for r in got} == {"text"}


def test_reports(spark):
    laps = spark.createDataFrame([(1, 3, 10, 20, True), (1, 4, 20, 30, False)], "recording_id bigint, number bigint, start_ns bigint, end_ns bigint, complete boolean")
    assert report.valid_laps(laps, ["recording_id"]).collect()[0]["valid_laps"] == 1
    at = spark.createDataFrame([(1, t) for t in (5, 10, 15, 20, 30)], "recording_id bigint, t_ns bigint")
    assert [(r["lap"], r["lap_progress"]) for r in report.lap_at(at, laps, ["recording_id"]).orderBy("t_ns").collect()] == [(None, None), (3, 0.0), (3, 0.5), (4, 0.0), (None, None)]
    n = spark.createDataFrame([(k,) for k in (0, 1, 2, 19, 40)], "n bigint")
    got = report.spaced(n, F.col("n")).groupBy("n").agg(F.array_sort(F.collect_list("index")).alias("i")).collect()
    assert {r["n"]: r["i"] for r in got} == {1: [1], 2: [1, 2], 19: list(range(1, 20)), 40: [1 + 39 * s // 18 for s in range(19)]}


def _recording(flag_from, flags, falls=False):
    lat = [(1, 0, 0, i, (i if not falls or i != 3 else 1) * 100, 50.0) for i in range(6)]
    lon = [(1, 1, 0, i, i * 100, 7.0) for i in range(6)]
    flag = [(1, 2, 0, i, flag_from + i * 100, float(v)) for i, v in enumerate(flags)]
    names = [("GPS Latitude", "deg"), ("GPS Longitude", "deg"), ("GPS Fix Valid", "")]
    channels = [(1, i, i, n, u, "declared", "f64", 6, 600) for i, (n, u) in enumerate(names)]
    return channels if flags else channels[:2], [*lat, *lon, *flag]


def _cleaned(spark, *recording):
    c, s = (spark.createDataFrame(x, y) for x, y in zip(recording, (CHANNELS, SAMPLES)))
    none = spark.createDataFrame([], "recording_id bigint, name string, version int")
    clean = [p for p in passes.registry() if p.name == "gps.clean"]
    channels, samples, reports = passes.apply(c, s, none, clean)
    own = samples.join(channels.where("name = 'GPS Latitude Clean'").select("channel_idx"), "channel_idx")
    return [r["value"] == r["value"] for r in own.orderBy("local_idx").collect()], reports.collect()[0], passes.provenance(reports, clean).collect()


def test_gps_clean_believes_no_fix_before_the_flag(spark):
    kept, told, by = _cleaned(spark, *_recording(300, [1, 1, 0]))
    assert kept == [False, False, False, True, True, False] and told["outcome"] == "applied"
    assert [(p["name"], p["value"]) for p in by[0]["params"]] == [("max_speed_mps", "150"), ("reanchor_after", "8")] and by[0]["outputs"] == ["GPS Latitude Clean", "GPS Longitude Clean"]
    assert _cleaned(spark, *_recording(0, []))[0] == [True] * 6


def test_gps_clean_skips_falling_times(spark):
    kept, told, by = _cleaned(spark, *_recording(0, [], falls=True))
    assert kept == [] and told["outcome"] == "skipped" and "non-monotonic" in told["reason"] and by == []


def test_gps_clean_ends_with_the_longitude(spark):
    channels, samples = _recording(0, [])
    channels[1] = (*channels[1][:-1], 350)
    assert _cleaned(spark, channels, samples)[0] == [True] * 4 + [False] * 2
