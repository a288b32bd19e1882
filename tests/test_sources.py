"""Scans and sinks on small files written here."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from paddock.sources import globs, jsonl, ld, ldx, vbo

S = 1_000_000_000
VBO = """File created on 01/02/2025 at 12:00:00
[column names]
sats time lat long velocity heading height vert-vel Tsample solution_type avifileindex avitime throttle
[channel units]
%
[avi]
run_
MP4
[data]
9 235959.5 43.79 -87.98 10.0 90 291 0 0.5 3 1 0 0.0
9 000000.0 43.80 -87.97 20.0 90 291 0 0.5 3 2 0 50.0
7
9 000000.5 x -87.96 30.0 90 291 0 0.5 3 2 0 100.0
"""


def test_vbo(spark, tmp_path):
    (tmp_path / "a.vbo").write_text(VBO)
    files = vbo.read_text(spark, str(tmp_path))
    c, s, d = vbo.parse(files)
    names = {r["name"]: r for r in c.collect()}
    assert names["velocity"]["unit"] == "km/h" and names["throttle"]["unit"] == "%" and names["throttle"]["unit_source"] == "declared"
    assert names["sats"]["sample_count"] == 3 and names["sats"]["duration_ns"] == 3 * S // 2
    v = names["velocity"]["channel_idx"]
    assert [(r["t_ns"], r["value"]) for r in s.where(F.col("channel_idx") == v).orderBy("local_idx").collect()] == [(0, 10), (S // 2, 20), (S, 30)]
    assert {(r["code"], r["channel"]) for r in d.collect()} == {("vbo.value_unparsable", "lat"), ("vbo.row_too_few_tokens", None)}
    assert vbo.videos(files, s, c).first()["files"] == ["run_0001.mp4", "run_0002.mp4"]


def test_jsonl_round_trip(spark, tmp_path):
    doc = ['{"mtj":1,"q":10000000,"dur":40000000}', "[[1,0,20000000,1]]", '{"n":"A \\"x\\"","u":"m/s","hz":100,"v":[1,2.5,null,4]}']
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(doc)], "recording_id string, n int, line string")
    p = jsonl.parse(lines)
    assert p["problems"].count() == 0 and p["laps"].first()["complete"]
    s = p["samples"].orderBy("local_idx").collect()
    assert [r["t_ns"] for r in s] == [0, 10_000_000, 20_000_000, 30_000_000] and s[2]["value"] != s[2]["value"]
    a = p["samples"].join(p["channels"].select("recording_id", "channel_idx", "name", "unit"), ["recording_id", "channel_idx"]).select("recording_id", "name", "unit", F.col("local_idx").alias("slot"), "value")
    lat = p["channels"].select("recording_id", "name", F.lit(0).cast("long").alias("t0_ns"), F.lit(10_000_000).cast("long").alias("period_ns"))
    head = spark.createDataFrame([("r", 10_000_000, 40_000_000)], "recording_id string, q_ns bigint, dur_ns bigint")
    out = jsonl.to_lines(a, lat, p["laps"], head)
    assert [r["line"] for r in out.orderBy("n").collect()] == doc
    jsonl.write(out, str(tmp_path / "out"))
    again = jsonl.read_lines(spark, str(tmp_path / "out"))
    assert [r["line"] for r in again.orderBy("n").collect()] == doc
    bad = lines.withColumn("line", F.regexp_replace("line", '"hz":100', '"hz":300'))
    assert {r["problem"] for r in jsonl.parse(bad)["problems"].collect()} == {"period_off_lattice"}


def test_jsonl_spans_videos_passes_and_problems(spark):
    head = '{"mtj":1,"q":10,"dur":100,"vo":-5,"vf":[{"n":"a.mp4","i":0,"fc":3},{"n":"b.mp4","i":1,"po":7}],"vpts":[0,5,5],"passes":[{"n":"gps.clean","v":2,"p":{"a":"1"}}]}'
    channel = '{"n":"A","hz":100000000,"v":[1,2]}'
    good = [head, "[]", '{"k":"s","n":"x","s":10,"e":20,"m":[["t",5]]}', channel, '{"k":"s","s":20,"e":30,"vis":false}', channel.replace("A", "B")]
    wrong = {
        "json": [head, "[]", "no json"], "video": [head.replace("[0,5,5]", "[5,0]"), "[]"], "channel_values": [head, "[]", '{"n":"A","hz":100000000}'], "channel_name": [head, "[]", '{"hz":100000000,"v":[1]}'],
        "span_bounds": [head, "[]", '{"k":"s","s":20,"e":20}'], "span_vis": [head, "[]", '{"k":"s","s":10,"e":20,"vis":"x"}'], "meta": [head, "[]", '{"k":"s","s":10,"e":20,"m":{}}'], "beyond_duration": [head, "[]", '{"n":"A","hz":100000000,"t0":90,"v":[1,2,3]}'],
    }
    rows = [(r, i, x) for r, doc in ({"good": good} | wrong).items() for i, x in enumerate(doc)]
    found = jsonl.parse(spark.createDataFrame(rows, "recording_id string, n int, line string"))
    told = {}
    for r in found["problems"].collect():
        told.setdefault(r["recording_id"], set()).add(r["problem"])
    assert told == {k: {k} for k in wrong}
    assert [(r["name"], r["start_ns"], r["end_ns"], r["visible"]) for r in found["spans"].orderBy("start_ns").collect()] == [("x", 10, 20, True), ("", 20, 30, False)]
    assert sorted((r["channel_idx"], r["name"], r["recording_id"]) for r in found["channels"].collect()) == [(0, "A", "good"), (1, "B", "good")]
    assert [tuple(r)[1:] for r in found["files"].orderBy("idx").collect()] == [("a.mp4", 0, 3, None, None), ("b.mp4", 1, 0, None, 7)]
    assert [tuple(r) for r in found["videos"].collect()] == [("good", -5, [0, 5, 5])] and [(r["name"], r["version"], r["params"]) for r in found["passes"].collect()] == [("gps.clean", 2, {"a": "1"})]


def test_ldx(spark):
    marks = [12.5, 25.5, 37, 51, 63, 78, 89, 102.5, 115, 129, 142]
    m = spark.createDataFrame([("r", int(x * S)) for x in marks], "recording_id string, t_ns bigint")
    parsed = ldx.parse(ldx.to_xml(m))
    row = parsed.first()
    assert row["markers"] == [int(x * S) for x in marks] and row["total_laps"] == 12 and row["fastest_lap"] == 7 and row["fastest_ns"] == 11 * S
    d = spark.createDataFrame([("r", 151 * S)], "recording_id string, duration_ns bigint")
    laps = ldx.to_laps(parsed, d).collect()
    assert len(laps) == 12 and sum(r["complete"] for r in laps) == 10 and min(r["duration_ns"] for r in laps if r["complete"]) == 11 * S


def _ld() -> bytes:
    data = bytearray(0x400)
    struct.pack_into("<I", data, 0, 0x40)
    struct.pack_into("<I", data, 8, 0x1A0)
    data[0x5E : 0x5E + 10] = b"15/03/2025"
    data[0x7E : 0x7E + 8] = b"10:00:00"
    data[0x9E : 0x9E + 3] = b"Ann"
    for at, nxt, place, name, unit, width, a, numbers in ((0x1A0, 0x220, 0x300, b"Speed", b"m/s", 4, 7, (1.5, 2.5)), (0x220, 0, 0x320, b"Gear", b"", 2, 3, (10, 20, 30))):
        struct.pack_into("<4I", data, at, 0, 0, 0, 0)
        struct.pack_into("<3I", data, at + 4, nxt, place, len(numbers))
        struct.pack_into("<3H", data, at + 0x12, a, width, 2)
        struct.pack_into("<4h", data, at + 0x18, 1, 1, 1, 1)
        data[at + 0x20 : at + 0x20 + len(name)] = name
        data[at + 0x48 : at + 0x48 + len(unit)] = unit
        struct.pack_into("<" + ("f" if a == 7 else "h") * len(numbers), data, place, *numbers)
    return bytes(data)


def test_ld(spark, tmp_path):
    (tmp_path / "x.ld").write_bytes(_ld())
    raw = ld.files(spark, str(tmp_path))
    c = {r["name"]: r for r in ld.channels(raw).collect()}
    assert c["Speed"]["sample_type"] == "f32" and c["Gear"]["sample_count"] == 3 and c["Gear"]["period_ns"] == S // 2
    s = ld.samples(raw).collect()
    assert [r["value"] for r in s if r["channel_idx"] == 0] == [1.5, 2.5] and [r["value"] for r in s if r["channel_idx"] == 1] == [2.0, 3.0, 4.0]
    i = ld.identity(raw).first()
    assert i["driver"] == "Ann" and i["absolute_start_ns"] == 1742032800 * S


def test_globs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.LD", "b.vbo", "c.txt", "sub/d.telemetry.jsonl"):
        (tmp_path / n).write_bytes(b"x")
    assert {r["kind"] for r in globs.scan(spark, str(tmp_path)).select("kind").collect()} == {"motec", "vbo", "plain"}
    assert globs.scan(spark, str(tmp_path), ["*.{ld,pds}"]).count() == 1
    df = spark.createDataFrame([("x/y/run1.vbo",), ("x/run22.vbo",)], "p string")
    assert [r[0] for r in df.select(globs.matches(F.col("p"), ["x/*.vbo"])).collect()] == [False, True]
    assert [r[0] for r in df.select(globs.matches(F.col("p"), ["x/**/run?.vbo"])).collect()] == [True, False]


def test_ldx_of_other_writers(spark):
    text = """<LDXFile><Marker Time='1.5e6' ClassName='BCN'/><Marker ClassName="BCN" Name="a>b" Time="500000"/><Marker ClassName="OTHER" Time="9"/><Marker ClassName="BCN"/>
    <Marker ClassName="BCN" Time="-1"/><String Value="0" Id="Total Laps"/><String Value='1:02.5' Id='Fastest Time'/><String Id="Fastest Lap" Value="2"/></LDXFile>"""
    got = ldx.parse(spark.createDataFrame([("f", text), ("g", "<LDXFile/>")], "recording_id string, text string")).orderBy("recording_id").collect()
    assert tuple(got[0]) == ("f", [500_000_000, 1_500_000_000], None, 2, 62_500_000_000, 2)
    assert tuple(got[1]) == ("g", [], None, None, None, 0)


def test_unreadable_ld(spark, tmp_path):
    (tmp_path / "bad.ld").write_bytes(b"not a log" * 1000)
    raw = ld.files(spark, str(tmp_path))
    assert [r["problem"].split(":")[0] for r in ld.channels(raw).collect()] == ["ld.unreadable"] and ld.samples(raw).count() == 0


def test_shared_folder_on_a_cluster():
    """A session of a cluster without the setting is refused."""
    import pytest

    from paddock.session import shared_dir

    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        shared_dir(Session)
