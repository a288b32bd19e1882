"""Laps by precedence, facts of recordings, lap sidecars beside their logs."""

from __future__ import annotations

from paddock.operators import recovery
from paddock.sources import ldwrite, opening

CHANNELS = "recording_id string, channel_idx int, name string, unit string, sample_type string, sample_count bigint, duration_ns bigint"
SAMPLES = "recording_id string, channel_idx int, local_idx bigint, t_ns bigint, value double"
LAPS = "recording_id string, number bigint, start_ns bigint, end_ns bigint, duration_ns bigint, complete boolean"
S = 1_000_000_000


def tables(spark, recordings):
    """``recordings``: id to name and values of channels at ten samples a second."""
    channels, samples = [], []
    for r, held in recordings.items():
        for c, (name, values) in enumerate(held.items()):
            channels.append((r, c, name, "", "f64", len(values), len(values) * S // 10))
            samples += [(r, c, i, i * S // 10, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(channels, CHANNELS), spark.createDataFrame(samples, SAMPLES)


def test_precedence(spark):
    n = 400
    timer = [(i - 3) % 100 / 10 for i in range(n)]  # falls to 0 at 0.3, 10.3, 20.3, 30.3
    late = [(i - 5) // 100 for i in range(n)]  # steps two samples later; -1, 0, 1, 2, 3
    channels, samples = tables(spark, {
        "both": {"Lap": late, "Lap Time": timer}, "timer": {"Lap Time": timer}, "stands": {"Lap": [4] * n, "laptime": timer}, "zero": {"lap": [0] * n, "laptime": timer},
        "constant": {"Lap Number": [2] * n}, "declared": {"Lap": late}, "closed": {"Lap": late}, "none": {"Speed": timer}, "odd": {"Lap": [float("nan")] * n, "laptime": [float("inf")] * n},
    })
    declared = spark.createDataFrame([("declared", 9, 5, 10, 5, True)], LAPS)
    found = recovery.recover(channels, samples, declared, spark.createDataFrame([("closed",)], "recording_id string"))
    got = {}
    for r in found.orderBy("recording_id", "start_ns").collect():
        got.setdefault(r["recording_id"], []).append((r["number"], r["start_ns"] * 10 // S, r["end_ns"] * 10 // S, r["complete"], r["origin"]))
    # at the reset of 10.3 the counter still tells no lap, so that reset moves nothing
    assert got["both"] == [(1, 105, 203, True, "counter"), (2, 203, 303, True, "counter"), (3, 303, 400, False, "counter")]
    assert got["timer"] == [(1, 0, 3, False, "timer"), (2, 3, 103, True, "timer"), (3, 103, 203, True, "timer"), (4, 203, 303, True, "timer"), (5, 303, 400, False, "timer")]
    assert [x[0] for x in got["stands"]] == [4] * 5 and got["stands"][0][4] == "timer"
    # a counter that stands at zero has no lap, so it numbers none
    assert [x[0] for x in got["zero"]] == [1, 2, 3, 4, 5]
    assert got["constant"] == [(2, 0, 400, False, "constant")] and got["declared"] == [(9, 0, 0, True, "authoritative")]
    assert not got.keys() & {"closed", "none", "odd"}
    fast = {r["recording_id"]: r["duration_ns"] for r in recovery.fastest(found, channels, samples, spark.createDataFrame([("declared", 9, 5, 10, 5, True)], LAPS)).collect()}
    assert fast == {"both": 10 * S, "timer": 10 * S, "stands": 10 * S, "zero": 10 * S, "declared": 5}
    empty = recovery.recover(channels.limit(0), samples.limit(0), declared.limit(0), declared.select("recording_id").limit(0))
    assert empty.count() == 0


def test_clock_precedence(spark):
    unix, week, itow = [1.6e9 + i / 10 for i in range(40)], [2000.0] * 40, [1000.0 + 100 * i for i in range(40)]
    gps = {"GPS Week": week, "GPS ITOW": itow}
    channels, samples = tables(spark, {"own": gps | {"Global Time": unix}, "gps": gps | {"Global Time": unix}, "broken": {"GPS Week": week, "Global Time": unix}, "counter": {"Global Time": [float(i) for i in range(40)]}})
    origins = spark.createDataFrame([("own", "time_of_day", 5, None, None) + (None,) * 7 + (None, None)], recovery.ORIGIN)
    got = {r["recording_id"]: (r["clock"], r["session_hint"], r["absolute_start_ns"], r["absolute_end_ns"]) for r in recovery.clocks(channels, samples, origins).collect()}
    start = (2000 * 604_800_000 + 1000 + 315_964_800_000) * 1_000_000
    assert got["own"] == ("time_of_day", "", 5, 5 + 4 * S) and got["gps"] == ("gps", "gps:2000", start, start + 3_900_000_000)
    assert got["broken"][:3] == ("utc", "utc:18518", 1_600_000_000 * S) and "counter" not in got


def test_sidecar_beside_its_log(spark, tmp_path):
    channels = spark.createDataFrame([(r, 0, "Lap", "", "f64") for r in ("one", "two", "bare")], "recording_id string, channel_idx int, name string, unit string, sample_type string")
    chunks = spark.createDataFrame([(r, 0, 0, S, 60, 0) for r in ("one", "two", "bare")], "recording_id string, channel_idx int, chunk_idx int, sample_period_ns bigint, sample_count bigint, time_base_ns bigint")
    samples = spark.createDataFrame([(r, 0, i, i * S, float(i // 20 + 1)) for r in ("one", "two", "bare") for i in range(60)], SAMPLES)
    identity = spark.createDataFrame([("one", "Zoë", "Spa", "event")], "recording_id string, driver string, venue string, event string")
    ldwrite.write(ldwrite.pieces(channels, chunks, samples, identity), str(tmp_path))
    mark = lambda s: f'<Marker ClassName="BCN" Time="{s * 1e6}"/>'
    (tmp_path / "one.LDX").write_text("<LDXFile>" + mark(10) + mark(25) + mark(41) + '<Marker ClassName="BCN" Time="x"/><String Id="Fastest Lap" Value="2"/><String Id="Fastest Time" Value="0:15.000"/></LDXFile>')
    (tmp_path / "two.ldx").write_text("<LDXFile><String Id=\"Total Laps\" Value=\"3\"/></LDXFile>")
    opened = opening.open_folder(spark, str(tmp_path))
    name = lambda r: r["recording_id"].rsplit("/", 1)[1][:-3]
    got = {}
    for r in opened["laps"].orderBy("recording_id", "start_ns").collect():
        got.setdefault(name(r), []).append((r["number"], r["start_ns"] // S, r["end_ns"] // S, r["complete"], r["origin"]))
    assert got["one"] == [(1, 0, 10, False, "authoritative"), (2, 10, 25, True, "authoritative"), (3, 25, 41, True, "authoritative"), (4, 41, 60, False, "authoritative")]
    assert got["two"] == got["bare"] == [(1, 0, 20, False, "counter"), (2, 20, 40, True, "counter"), (3, 40, 60, False, "counter")]
    told = {name(r): r for r in opening.file_metadata(opened, spark.createDataFrame([("Spa", "Europe/Brussels")], "venue string, timezone string")).collect()}
    assert told["one"]["fastest_lap"]["duration_ns"] == 15 * S and told["bare"]["fastest_lap"]["number"] == 2 and told["one"]["driver"] == "Zoë"
    assert told["one"]["timezone"] == "Europe/Brussels" and told["two"]["timezone"] == "" and told["one"]["format"] == "motec" and told["one"]["valid_laps"] == 2
    assert {r["code"] for r in opened["diagnostics"].where("code like 'ldx%'").collect()} == {"ldx.marker_skipped"}
