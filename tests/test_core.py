"""Operators on small recordings with known results."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paddock.functions import clock, geo, names, timespan, units
from paddock.operators import laps, lattice, passes, runs, sampling, sessions, summary, tracks, validate

S = 1_000_000_000
SAMPLES = "recording_id string, channel_idx int, chunk_idx int, local_idx bigint, t_ns bigint, value double"
BY, ORDER = ["recording_id"], ["chunk_idx", "local_idx"]


def series(spark, values, period=S, stamps=None, rid="r", idx=0):
    t = stamps or [i * period for i in range(len(values))]
    return spark.createDataFrame([(rid, idx, 0, i, t[i], float(v)) for i, v in enumerate(values)], SAMPLES)


def as_laps(df):
    return sorted((r["number"], r["start_ns"], r["end_ns"], r["complete"]) for r in df.collect())


def test_explicit_clock(spark):
    s = series(spark, [0, 10, 20, 30], stamps=[100, 300, 700, 1500])
    c = spark.createDataFrame([("r", 0, 2000, False)], "recording_id string, channel_idx int, duration_ns bigint, steps boolean")
    p = spark.createDataFrame([("r", 0, t) for t in (50, 99, 100, 200, 300, 500, 1100, 1600, 2000)], "recording_id string, channel_idx int, t_ns bigint")
    line = {r["t_ns"]: r["value"] for r in sampling.sample_at(p, s, c).collect()}
    assert line == {50: None, 99: None, 100: 0, 200: 5, 300: 10, 500: 15, 1100: 25, 1600: 30, 2000: None}
    step = {r["t_ns"]: r["value"] for r in sampling.sample_at(p, s, c, False).collect()}
    assert step[500] == 10 and step[50] is None and step[2000] is None


def test_grid_with_gap_reads_next_chunk(spark):
    chunks = spark.createDataFrame([("r", 0, 0, S, 2, 0, 0), ("r", 0, 1, S, 2, 2, 5 * S)], "recording_id string, channel_idx int, chunk_idx int, sample_period_ns bigint, sample_count bigint, sample_base bigint, time_base_ns bigint")
    s = spark.createDataFrame([("r", 0, 0, 0, 0, 10.0), ("r", 0, 0, 1, S, 20.0), ("r", 0, 1, 0, 5 * S, 50.0), ("r", 0, 1, 1, 6 * S, 60.0)], SAMPLES)
    c = spark.createDataFrame([("r", 0, 7 * S, False)], "recording_id string, channel_idx int, duration_ns bigint, steps boolean")
    p = spark.createDataFrame([("r", 0, t) for t in (0, S // 2, 3 * S, 11 * S // 2, 7 * S)], "recording_id string, channel_idx int, t_ns bigint")
    got = {r["t_ns"]: r["value"] for r in sampling.sample_at_grid(p, chunks, s, c).collect()}
    assert got == {0: 10, S // 2: 15, 3 * S: 50, 11 * S // 2: 55, 7 * S: None}


@pytest.mark.parametrize(
    ("values", "completed", "want"),
    [
        ([1, 1, 2, 2, 3, 3, 0, 1], False, [(1, 0, 20, False), (2, 20, 40, True), (3, 40, 80, False)]),
        ([0, 0, 1, 1, 2, 2, 3], True, [(1, 0, 20, False), (2, 20, 40, True), (3, 40, 60, True), (4, 60, 70, False)]),
    ],
)
def test_counters(spark, values, completed, want):
    s = series(spark, values, 10 * S)
    got = laps.counter_laps(s, BY, ORDER, F.lit(len(values) * 10 * S), F.lit(completed))
    assert as_laps(got) == [(n, a * S, b * S, c) for n, a, b, c in want]


def test_counter_choice(spark):
    one, two = series(spark, [0, 0, 1, 1, 1, 1, 0], 10 * S), series(spark, [0, 0, 1, 2, 3, 4, 4], 10 * S, idx=1)
    ch = spark.createDataFrame([("r", 0, "Lap Number"), ("r", 1, "beaconEventCount")], "recording_id string, channel_idx int, name string")
    held = laps.counter_laps(one.unionByName(two), [*BY, "channel_idx"], ORDER, F.lit(70 * S), F.col("channel_idx") == 1)
    got = laps.select_counter(held, ch)
    assert [(n, c) for n, _, _, c in as_laps(got)] == [(1, False), (2, True), (3, True), (4, True), (5, False)]


def test_progress_wraps(spark):
    s = series(spark, [80, 99, 2, 50, 98, 1, 30])
    resets = laps.timer_resets(s, BY, ORDER, F.lit(True))
    d = spark.createDataFrame([("r", 7 * S)], "recording_id string, duration_ns bigint")
    assert as_laps(laps.timer_laps(resets, d, BY)) == [(1, 0, 2 * S, False), (2, 2 * S, 5 * S, True), (3, 5 * S, 7 * S, False)]


def test_timer_refines_counter(spark):
    L = "recording_id string, number bigint, start_ns bigint, end_ns bigint, duration_ns bigint, complete boolean"
    b = [0, 120_300_000_000, 240_300_000_000, 400_000_000_000, 480_000_000_000]
    counter = spark.createDataFrame([("r", i + 1, b[i], b[i + 1], b[i + 1] - b[i], i not in (0, 3)) for i in range(4)], L)
    t = [0, 120 * S, 240 * S, 360 * S, 480 * S]
    timer = spark.createDataFrame([("r", i + 1, t[i], t[i + 1], 120 * S, i not in (0, 3)) for i in range(4)], L)
    assert as_laps(laps.refine(counter, timer, BY)) == [(1, 0, 120 * S, False), (2, 120 * S, 240 * S, True), (3, 240 * S, 400 * S, True), (4, 400 * S, 480 * S, False)]


def test_runs_and_stints(spark):
    s = series(spark, [1, 1, 2, float("nan"), 2, -1, 3])
    r = runs.integer_runs(s, BY, ORDER, F.lit(7 * S))
    assert [(x["value"], x["start_ns"] // S, x["end_ns"] // S) for x in r.orderBy("run").collect()] == [(1, 0, 2), (2, 2, 5), (-1, 5, 6), (3, 6, 7)]
    assert sorted(x["driver_id"] for x in runs.driver_stints(r, BY, S).collect()) == [1, 2, 3]


def test_sessions_join_by_previous_end(spark):
    f = spark.createDataFrame([(0, "k", 1000 * S, 1040 * S), (1, "k", 1045 * S, 1085 * S), (2, "k", 1200 * S, 1201 * S), (3, None, 1045 * S, 1046 * S)], "file_id int, session_key string, absolute_start_ns bigint, absolute_end_ns bigint")
    got = {tuple(r["files"]) for r in sessions.summary(sessions.group(f, 10 * S)).collect()}
    assert got == {(0, 1), (2,), (3,)}


def test_units(spark):
    cases = [(74.75, "m/s", "km/h", 269.1), (212, "F", "C", 100), (1, "bar", "psi", 14.503773773), (1000, "rpm", "rad/s", 104.7197551197), (3, "gear", "gear", 3), (1, "m/s", "bar", None), (1, "gear", "%", None), (1, "nope", "m", None), (2, "KM/H", "km/h", 2), (5, "  deg ", "deg", 5)]
    df = spark.createDataFrame([(i, float(v), a, b) for i, (v, a, b, _) in enumerate(cases)], "i int, v double, a string, b string")
    got = {r["i"]: r["x"] for r in df.select("i", units.convert(F.col("v"), F.col("a"), F.col("b")).alias("x")).collect()}
    for i, (*_, want) in enumerate(cases):
        assert got[i] is None if want is None else math.isclose(got[i], want, rel_tol=1e-9)


def test_timespans(spark):
    df = spark.createDataFrame([("1:50.332", 110332), ("1:30:00.000", 5400000), ("90:00.000", 5400000), ("1:60.000", None), ("28", None), ("1:50.3320", None), ("2:61:00.000", None)], "s string, ms int")
    for r in df.withColumn("x", timespan.parse_ms(F.col("s"))).collect():
        assert r["x"] == r["ms"], r
    f = spark.createDataFrame([(110332,), (5400000,), (-1,)], "ms int").select(timespan.format_ms(F.col("ms")).alias("x")).collect()
    assert [r["x"] for r in f] == ["1:50.332", "1:30:00.000", None]
    assert spark.createDataFrame([(110332,), (112104,)], "ms int").agg(timespan.mean_ms(F.col("ms"))).first()[0] == 111218


def test_names_clock_geo(spark):
    row = spark.range(1).select(
        names.normalize(F.lit("GPS-Lat é 1")).alias("n"),
        names.steps(F.lit("Gear Pos"), F.lit("f32")).alias("g"),
        names.steps(F.lit("Speed"), F.lit("f32")).alias("s"),
        geo.packed_coordinate(F.lit(3119.09973), 90).alias("p"),
        geo.packed_coordinate(F.lit(58.49277), 180, True).alias("q"),
        geo.packed_coordinate(F.lit(3190.0), 90).alias("bad"),
        clock.civil_to_utc_ns(F.lit(1742032800000000000), F.lit("America/New_York"), ("America/New_York",)).alias("u"),
        lattice.gcd(F.lit(30_000_000), F.lit(40_000_000)).alias("gcd"),
    ).first()
    assert row["n"] == "gpslat1" and row["g"] and not row["s"] and row["bad"] is None and row["gcd"] == 10_000_000
    assert abs(row["p"] - 31.3183288333) < 1e-9 and abs(row["q"] + 0.9748795) < 1e-9
    assert row["u"] == 1742032800000000000 + 4 * 3600 * S


def test_lattice(spark):
    s = spark.createDataFrame([("r", 0, 0, 0, 0, 10.0), ("r", 0, 0, 1, 10_000_000, 11.0), ("r", 0, 1, 0, 30_000_000, 13.0)], SAMPLES)
    lat = spark.createDataFrame([("r", 0, 0, 10_000_000)], "recording_id string, channel_idx int, t0_ns bigint, period_ns bigint")
    assert [r["value"] for r in lattice.align(s, lat, ["recording_id", "channel_idx"]).orderBy("slot").collect()] == [10, 11, None, 13]


def test_passes(spark):
    lat = [0.0 if 10 <= i < 15 else 43.797 + 1e-5 * i + (0.1 if i == 50 else 0) for i in range(100)]
    lon = [0.0 if 10 <= i < 15 else -87.990 + 1e-5 * i for i in range(100)]
    sats = [2.0 if 10 <= i < 15 else 9.0 for i in range(100)]
    s = None
    for idx, v in enumerate((lat, lon, sats, [40.0] * 100)):
        one = series(spark, v, 100_000_000, idx=idx)
        s = one if s is None else s.unionByName(one)
    ch = spark.createDataFrame(
        [("r", i, i, n, u, "declared", "f64", 100, 10 * S) for i, (n, u) in enumerate((("GPS Latitude", "deg"), ("GPS Longitude", "deg"), ("Satellites", ""), ("Speed", "m/s")))],
        "recording_id string, channel_idx int, id int, name string, unit string, unit_source string, sample_type string, sample_count bigint, duration_ns bigint",
    )
    none = spark.createDataFrame([], "recording_id string, name string, version int")
    c2, s2, reports = passes.apply(ch, s, none)
    assert {r["name"]: r["outcome"] for r in reports.collect()} == {"gps.quality": "applied", "gps.clean": "applied", "speed.distance": "applied"}
    got = {}
    for r in s2.join(c2.select("recording_id", "channel_idx", "name"), ["recording_id", "channel_idx"]).collect():
        got.setdefault(r["name"], {})[r["local_idx"]] = r["value"]
    assert got["GPS Fix Valid"][12] == 0 and got["GPS Fix Valid"][30] == 1
    assert math.isnan(got["GPS Position Sigma"][12]) and got["GPS Position Sigma"][30] == 15
    clean = got["GPS Latitude Clean"]
    assert math.isnan(clean[12]) and math.isnan(clean[50]) and clean[30] == lat[30] and clean[51] == lat[51]
    assert abs(got["Distance Odometer"][99] - 396) < 1e-6 and abs(got["Distance Odometer Sigma"][99] - 0.005 * 396) < 1e-6
    kept, _ = passes.strip(c2, s2, c2.where("channel_idx > 3").select("recording_id", "name"))
    assert kept.count() == 4


def test_validation_and_summary(spark):
    s = series(spark, [1, float("nan"), 2e15, -1e7])
    ch = spark.createDataFrame([("r", 0, 0, "Speed", "m/s", "declared", "f32", 4, 4 * S)], "recording_id string, channel_idx int, id int, name string, unit string, unit_source string, sample_type string, sample_count bigint, duration_ns bigint")
    r = validate.check_values(s, ch).first()
    assert (r["seen"], r["nonfinite"], r["absurd"], r["out_of_band"], r["extreme"]) == (4, 1, 1, 1, 2e15)
    assert len(summary.schema_hash(ch).first()["schema_hash"]) == 16
    u = series(spark, [1737644480 + i for i in range(5)], stamps=[(5 + i) * S for i in range(5)])
    k = summary.unix_clock(u, BY, ["t_ns"]).first()
    assert k["clock_offset_ns"] == 1737644480 * S - 5 * S
    assert summary.unix_clock(series(spark, [12345, 12346]), BY, ["t_ns"]).count() == 0


def test_tracks(spark):
    t = spark.createDataFrame([(0, "road-america", "Road America", ["RA"], "America/Chicago", 43.7978, -87.9899), (1, "sebring", "Sebring International", [], "America/New_York", 27.45, -81.35)], "ordinal int, slug string, name string, aka array<string>, timezone string, latitude double, longitude double")
    p = spark.createDataFrame([(1, 43.80, -87.98), (2, 0.0, 0.0)], "id int, lat double, lon double")
    assert [(r["id"], r["slug"]) for r in tracks.nearest_track(p, t, 50_000.0, ["id"]).collect()] == [(1, "road-america")]
    v = spark.createDataFrame([("Sebring",), ("road_america gp",), ("Nowhere",), ("",)], "venue string")
    assert {r["venue"]: r["timezone"] for r in tracks.venue_track(v, t).collect()} == {"Sebring": "America/New_York", "road_america gp": "America/Chicago"}


def test_civil_hours_shown_twice(spark):
    """The later of two hours, in zones that go back by an hour or half an hour; hours left out move on."""
    known = ("America/New_York", "Australia/Lord_Howe", "Europe/Berlin")
    rows = [("America/New_York", "1996-10-27 01:30:00"), ("America/New_York", "1996-10-27 02:30:00"), ("America/New_York", "1996-10-27 00:30:00"), ("Australia/Lord_Howe", "2021-04-04 01:45:00"), ("Europe/Berlin", "2021-03-28 02:30:00"), ("Mars/Base", "2021-03-28 02:30:00")]
    df = spark.createDataFrame(rows, "zone string, told string").withColumn("ns", F.unix_seconds(F.to_timestamp("told")) * 1_000_000_000 + 7)
    got = df.select(clock.civil_to_utc_ns(F.col("ns"), F.col("zone"), known).alias("u")).collect()
    at = lambda text: int(datetime.fromisoformat(text + "+00:00").timestamp()) * 1_000_000_000 + 7
    assert [r["u"] for r in got] == [at("1996-10-27 06:30:00"), at("1996-10-27 07:30:00"), at("1996-10-27 04:30:00"), at("2021-04-03 15:15:00"), at("2021-03-28 01:30:00"), None]
