"""Binary loggers, grouped sidecars and opening files by kind, on small files written here."""

from __future__ import annotations

import math
import struct

import pytest
from pyspark.sql import functions as F

from paddock.plans import fixtures
from paddock.session import ship, spread
from paddock.sources import aimd, camera, opening, pds, sidecar
from paddock.sources.fileio import Held, Ranged

MS = 1_000_000


def _fix(stamp, x, y, z, vx=0, vy=0, vz=0, fix=3):
    body = struct.pack("<IIiHBBiiiIiiiIHBBI", stamp, 4000, 0, 2300, fix, 1, x, y, z, 150, vx, vy, vz, 20, 180, 0, 11, 0)
    assert len(body) == aimd.FIX.itemsize
    return b"<hGPS\0" + struct.pack("<IH", len(body), 0) + body


def _camera():
    head = fixtures.packet(
        fixtures.definition(5, "Speed", 4), fixtures.definition(7, "Lap", 1), fixtures.definition(8, "Clock", 4, group=0x1003), fixtures.definition(20, "", 56, code="GPS0"), fixtures.definition(30, "", 4),
    )
    s = fixtures.scalar
    one = fixtures.packet(s(120, 5, struct.pack("<f", 2.5)), s(110, 7, b"\3"), s(130, 99, b"xxxx"), s(130, 5, struct.pack("<f", 3.5))[:-1] + b"]", _fix(115, 637_813_700, 0, 0))
    two = fixtures.packet(s(110, 5, struct.pack("<f", 1.5)), s(140, 8, struct.pack("<I", 4_000_000_000)), _fix(135, 0, 637_813_700, 0, vz=1000), _fix(140, 1, 1, 1, fix=0))
    return fixtures.camera([head, one, two], (90_000, [(2, 3000), (2, 1500)], [(1, 1500), (3, 0)], [(500, -1), (1000, 3000)]))


def test_camera(spark):
    ship(spark)
    raw = spark.createDataFrame([("a", bytearray(_camera())), ("b", bytearray(b"not a film")), ("c", bytearray())], "recording_id string, content binary")
    told = {(r["recording_id"], r["name"]): r for r in aimd.channels(raw).collect()}
    assert [told["a", n]["sample_type"] for n in ("Speed", "Lap", "Clock", "GPS Latitude", "GPS Week")] == ["f32", "u8", "u32", "f64", "u16"]
    assert told["a", "GPS Latitude"]["id"] == 21 and told["a", "Speed"]["problem"] == "aim.chs_block_skipped: 1"
    assert "unreadable" in told["b", ""]["problem"] and "unreadable" in told["c", ""]["problem"]
    names = aimd.channels(raw).select("recording_id", "channel_idx", "name")
    rows = aimd.samples(raw).join(names, ["recording_id", "channel_idx"]).collect()
    got = {(r["name"], r["local_idx"]): (r["t_ns"], r["value"]) for r in rows}
    # zero is the least first arrival: 110 (Lap); the stamp of 110 of Speed arrived second but is not earlier
    assert got["Speed", 0] == (0, 1.5) and got["Speed", 1] == (10 * MS, 2.5) and ("Speed", 2) not in got
    assert got["Lap", 0] == (0, 3.0) and got["Clock", 0] == (30 * MS, 4e9)
    assert got["GPS Latitude", 0] == (5 * MS, 0.0) and got["GPS Longitude", 1] == (25 * MS, 90.0) and math.isnan(got["GPS Latitude", 2][1])
    assert abs(got["GPS Altitude", 0][1]) < 1e-6 and got["GPS Speed", 1][1] == 10.0 and got["GPS Heading", 1][1] == pytest.approx(0) and got["GPS Heading", 0][1] == 0
    assert got["GPS Satellites", 0][1] == 11 and got["GPS DOP", 0][1] == 1.8 and got["GPS Position Accuracy", 0][1] == 1.5
    frames = [(r["frame"], r["pts_ns"]) for r in aimd.frame_times(aimd.tracks(raw)).orderBy("frame").collect()]
    media, start = [0 + 1500, 3000, 6000, 7500], 500 * MS - 3000 * 1_000_000_000 // 90_000
    assert frames == list(enumerate(sorted(m * 1_000_000_000 // 90_000 + start for m in media)))
    assert aimd.samples(raw.where("recording_id = 'b'")).count() == 0


def test_camera_in_one_pass(spark):
    """The rows of one pass give what the separate scans give, with all codes."""
    raw = spark.createDataFrame([("a", bytearray(_camera())), ("b", bytearray(b"not a film")), ("c", None)], "recording_id string, content binary")
    rows = camera.scan(raw).cache()
    held = lambda df: sorted(map(str, df.collect()))
    assert held(camera.samples(rows)) == held(aimd.samples(raw)) and held(camera.samples(rows, True)) == held(aimd.samples(raw, True))
    assert held(camera.tracks(rows)) == held(aimd.tracks(raw))
    told = {(r["recording_id"], r["code"]): (r["severity"], r["message"]) for r in camera.diagnostics(rows).collect()}
    assert told["a", "aim.unknown_record_id"] == ("warning", "1") and told["a", "aim.value_unterminated"] == ("warning", "1") and told["a", "aim.chs_block_skipped"] == ("warning", "1")
    assert told["b", "aim.unreadable"][0] == told["c", "aim.unreadable"][0] == "error"
    rows.unpersist()
    head = fixtures.packet(fixtures.definition(20, "", 56, code="GPS0"))
    short = fixtures.packet(b"<hGPS\0" + struct.pack("<IH", 10, 0) + bytes(10))
    bad = bytearray(fixtures.packet(fixtures.scalar(1, 5, b"abcd")))
    bad[6] = 0
    got = camera.scan(spark.createDataFrame([("g", bytearray(fixtures.camera([head, short, bytes(bad)])))], "recording_id string, content binary"))
    assert {(r["code"], r["message"]) for r in camera.diagnostics(got).collect()} == {("aim.gps_record_skipped", "1"), ("aim.packet_skipped", "1")}


@pytest.mark.parametrize(("video", "problem"), [
    ((90_000, [(4_000_000_000, 3000)], None, None), "more frames"), ((0, [(2, 3000)], None, None), "no clock"), ((90_000, [(4, 3000)], [(2, 0)], None), "another number"),
])
def test_damaged_video_clocks_are_rows(spark, video, problem):
    good = (90_000, [(3, 3000)], None, None)
    raw = spark.createDataFrame([(n, bytearray(fixtures.camera([fixtures.packet(fixtures.definition(5, "Speed", 4))], v))) for n, v in (("bad", video), ("good", good))], "recording_id string, content binary")
    tracks = camera.tracks(camera.scan(raw))
    assert [r["problem"] for r in tracks.where("recording_id = 'bad' and kind = 'video'").collect()][0].find(problem) >= 0
    assert [(r["recording_id"], r["frame"]) for r in aimd.frame_times(tracks).orderBy("frame").collect()] == [("good", i) for i in range(3)]


def test_camera_source_reads_ranges(spark, tmp_path):
    """Splits cover every packet once; the media between aren't read; filters reach the reader."""
    packets = [fixtures.packet(fixtures.definition(5, "Speed", 4))] + [fixtures.packet(fixtures.scalar(10 * i, 5, struct.pack("<f", i))) for i in range(40)]
    data = bytearray(fixtures.camera(packets))
    # a box of three gigabytes, all hole, lies between the packets and the index
    at = data.index(b"moov") - 4
    far = struct.pack(">I4sQ", 1, b"free", 3_000_000_000)
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.MP4", "wb") as f:
            f.write(data[:at] + far)
            f.seek(at + 3_000_000_000)
            f.write(data[at:])
    with Ranged(f"file:{tmp_path}/a.MP4") as source:
        assert sum(b.num_rows for b in camera.rows_of("a", source)) == 42 and source.taken < 10_000
    camera.register(spark)
    rows = spark.read.format("paddock_camera").option("splitBytes", 1_500_000_000).load(str(tmp_path))
    one = rows.where(F.col("recording_id") == f"file:{tmp_path}/a.MP4")
    assert one.rdd.getNumPartitions() == 3 and rows.where("kind = 'channel'").rdd.getNumPartitions() == 2
    assert sorted(r["value"] for r in one.where("kind = 'scalar'").collect()) == [float(i) for i in range(40)]
    assert {r["name"] for r in rows.where("kind = 'channel'").collect()} == {"Speed"}
    reader = camera.Reader({"path": str(tmp_path), "splitBytes": "200"})
    with Ranged(f"file:{tmp_path}/a.MP4") as source:
        found = [b for p in range(0, 2000, 200) for b in camera.rows_of("a", source, p, p + 200)]
    assert sorted(r["value"] for b in found for r in b.to_pylist() if r["kind"] == "scalar") == [float(i) for i in range(40)] and reader.size == 200


def test_clock_fit(spark):
    straight = [i * 10 * MS for i in range(50)]
    after = [straight[-1] + 500 * MS + i * 10 * MS + (7 * MS if i >= 20 else 0) for i in range(40)]
    rows = [("r", 0, i, t) for i, t in enumerate(straight + after)] + [("r", 1, 0, 5 * MS)]
    got = aimd.fit_chunks(spark.createDataFrame(rows, "recording_id string, channel_idx int, local_idx bigint, t_ns bigint")).orderBy("channel_idx", "chunk_idx").collect()
    assert tuple(got[0])[2:] == (0, 10 * MS, 50, 0, 0) and tuple(got[-1])[2:] == (0, 1, 1, 0, 5 * MS)
    stamps = dict((i, t) for _, c, i, t in rows if c == 0)
    for r in got[:-1]:
        for j in range(r["sample_count"]):
            assert abs(r["time_base_ns"] + j * r["sample_period_ns"] - stamps[r["sample_base"] + j]) <= 5 * MS
    assert sum(r["sample_count"] for r in got[:-1]) == len(stamps)


HEAD = '{"mtx":1,"q":10,"dur":100,"n":"g","utc":1700000000000000000,"tz":"Europe/Berlin","vis":1}'


def _lines(spark, docs):
    return spark.createDataFrame([(r, i, x) for r, doc in docs.items() for i, x in enumerate(doc)], "recording_id string, n int, line string")


def test_sidecar(spark):
    span = '{"k":"s","n":"a","s":10,"e":30,"vis":0,"c":"#aabbcc","p":{"title":"T","sub":"S"},"m":[["x","hi"],["lap","1:02.345"],["n",1500],["o",{"v":"0:01.000","u":"LapTime_MS"}],["p",{"v":7,"u":"timespan_ms"}]]}'
    channel = '{"n":"Speed","u":"m/s","hz":100000000,"t0":10,"plt":"t","sc":[0,null],"lbl":[[20,"one"],[30,"two"]],"vis":0,"v":[1,null,3]}'
    good = sidecar.parse(_lines(spark, {"r": [HEAD, span, HEAD.replace('"g"', '"h"').replace('"vis":1', '"vis":false'), channel]}))
    assert good["problems"].count() == 0
    assert [(g["group"], g["name"], g["visible"]) for g in good["groups"].orderBy("group").collect()] == [(0, "g", True), (1, "h", False)]
    s = good["spans"].first()
    assert (s["start_ns"], s["end_ns"], s["visible"], s["title"], s["subtitle"]) == (10, 30, False, "T", "S")
    assert [(m["name"], m["text"], m["ms"]) for m in s["meta"]] == [("x", "hi", None), ("lap", None, 62345), ("n", None, 1500), ("o", None, 1000), ("p", None, 7)]
    assert [(r["group"], r["t_ns"]) for r in good["samples"].orderBy("t_ns").collect()] == [(1, 10), (1, 20), (1, 30)]
    c = good["channels"].first()
    assert c["display"]["plot"] == "trace" and [(x["t_ns"], x["text"]) for x in c["labels"]] == [(20, "one"), (30, "two")] and sidecar.lint(good).count() == 0
    lines = sidecar.to_lines(good["groups"], good["spans"])
    again = sidecar.parse(lines)
    assert again["problems"].count() == 0 and again["spans"].select("name", "start_ns", "meta").first() == good["spans"].select("name", "start_ns", "meta").first()


def test_sidecar_problems(spark):
    span = lambda x: '{"k":"s","n":"a","s":10,"e":30,"vis":1,' + x + "}"
    channel = lambda x: '{"n":"S","hz":100000000,"vis":1,' + x + ',"v":[1]}'
    wrong = {
        "version": [HEAD.replace('"mtx":1', '"mtx":9')], "name": [HEAD.replace('"n":"g"', '"n":""')], "lattice": [HEAD.replace('"dur":100', '"dur":101')], "utc": [HEAD.replace("1700000000000000000", "0")],
        "tz": [HEAD.replace("Europe/Berlin", "Mars/Base")], "vis": [HEAD.replace(',"vis":1', "")], "hash": [HEAD.replace('"q"', '"hash":"xy","q"')], "video": [HEAD.replace('"q"', '"vo":1,"q"')], "right": [HEAD.replace('"q"', '"r":[{"p":["a"]}],"q"')],
        "span_bounds": [HEAD, '{"k":"s","s":30,"e":10,"vis":1}'], "span_lattice": [HEAD, '{"k":"s","s":11,"e":20,"vis":1}'], "colour": [HEAD, span('"c":"red"')], "span_vis": [HEAD, '{"k":"s","s":10,"e":20}'],
        "meta_range": [HEAD, span('"m":[["a",360000001]]')], "meta_unit": [HEAD, span('"m":[["a",{"v":1,"u":"m"}]]')], "meta_value": [HEAD, span('"m":[["a",1.5]]')], "meta_name": [HEAD, span('"m":[[1,"x"]]')],
        "duplicate_name": [HEAD, channel('"u":"a"'), channel('"u":"b"')], "period_off_lattice": [HEAD, channel('"u":"a"').replace("100000000", "300000000")], "plt": [HEAD, channel('"plt":"bar"')], "sc": [HEAD, channel('"sc":[2,1]')], "rnd": [HEAD, channel('"rnd":16')],
        "fmt": [HEAD, channel('"fmt":"0 C"')], "label": [HEAD, channel('"lbl":[[20,"a"],[10,"b"]]')], "labels_without_trace": [HEAD, channel('"plt":"gauge","lbl":[[20,"a"]]')], "no_header": [span('"c":""'), HEAD],
        "channel_vis": [HEAD, '{"n":"S","hz":100000000,"v":[1]}'], "channel_values": [HEAD, '{"n":"S","hz":100000000,"vis":1}'], "beyond_duration": [HEAD, '{"n":"S","hz":100000000,"vis":1,"v":[1,2,3,4,5,6,7,8,9,10,11,12]}'], "meta": [HEAD, span('"m":"x"')], "json": [HEAD, "not json"],
    }
    found = sidecar.parse(_lines(spark, wrong))
    told = {}
    for r in found["problems"].collect():
        told.setdefault(r["recording_id"], set()).add(r["problem"])
    assert told == {k: {k} for k in wrong} and found["groups"].count() == 0
    assert sidecar.parse(_lines(spark, {"r": ["x"]}).limit(0))["spans"].count() == 0


def test_video_links_and_passes(spark):
    docs = {"": '{"vo":-5,"vf":[{"n":"a.mp4","i":1}],"vpts":[0,5,5]}', "vpts": '{"vf":[{"n":"a","i":1}],"vpts":[5,4]}', "vpts_without_vf": '{"vpts":[1]}', "vf": '{"vf":[{"n":"","i":1}]}', "vo": '{"vo":"x"}'}
    df = spark.createDataFrame(list(docs.items()), "want string, line string").select("want", sidecar.video_links(F.col("line")).alias("v"))
    assert all((r["v"]["problem"] or "") == r["want"] for r in df.collect())
    p = spark.createDataFrame([('{"passes":[{"n":"gps.clean","v":2,"p":{"a":"1"}}]}',)], "line string").select(sidecar.passes(F.col("line")).alias("p")).first()["p"]
    assert (p[0]["name"], p[0]["version"], p[0]["params"]) == ("gps.clean", 2, {"a": "1"})


def test_open_folder(spark, tmp_path):
    doc = ['{"mtj":1,"q":10000000,"dur":40000000}', "[[1,0,20000000,1]]", '{"n":"A","u":"m/s","hz":100,"v":[1,2.5,null,4]}']
    (tmp_path / "a.telemetry.jsonl").write_text("\n".join(doc))
    (tmp_path / "b.telemetry.ext.jsonl").write_text(HEAD + '\n{"k":"s","s":10,"e":30,"vis":1}\n{"n":"Speed","hz":100000000,"vis":1,"v":[1,2]}\n')
    (tmp_path / "c.VBO").write_text("[column names]\nsats time velocity Tsample Lap\n[data]\n" + "\n".join(f"9 {120000 + i}.0 {i} 1.0 {i // 20}" for i in range(50)))
    (tmp_path / "d.mp4").write_bytes(_camera())
    (tmp_path / "e.ld").write_bytes(b"no")
    (tmp_path / "f.pds").write_bytes(b"no")
    (tmp_path / "g.txt").write_text("no")
    ends = lambda r: r["recording_id"].rsplit("/", 1)[1]
    found = opening.open_folder(spark, str(tmp_path))
    assert {(ends(r), r["format"], r["read"]) for r in found["recordings"].collect()} == {("a.telemetry.jsonl", "plain", True), ("b.telemetry.ext.jsonl", "ext", True), ("c.VBO", "vbo", True), ("d.mp4", "aimd", True), ("e.ld", "motec", True), ("f.pds", "pds", True)}
    n = {(ends(r), r["name"]): r["sample_count"] for r in found["channels"].collect()}
    assert n["a.telemetry.jsonl", "A"] == 4 and n["b.telemetry.ext.jsonl", "Speed"] == 2 and n["c.VBO", "velocity"] == 50 and n["d.mp4", "Speed"] == 2
    assert {(ends(r), r["number"]) for r in found["laps"].collect()} >= {("a.telemetry.jsonl", 1), ("c.VBO", 1), ("c.VBO", 2)}
    told = {ends(r): r for r in opening.verify(found).collect()}
    assert told["e.ld"]["problems"] >= 1 and told["e.ld"]["channels"] == 0 and told["b.telemetry.ext.jsonl"]["spans"] == 1 and told["a.telemetry.jsonl"]["laps"] == 1 and not told["c.VBO"]["fault"]
    slim = opening.open_folder(spark, str(tmp_path), ["*.vbo"], metadata=True)
    assert {(ends(r), r["name"]) for r in slim["channels"].collect()} == {("c.VBO", x) for x in ("time", "Tsample", "Lap")}
    assert [(ends(r), r["laps"]) for r in opening.lap_metadata(slim).collect()] == [("c.VBO", 2)]


def test_small_files_share_batches(spark):
    """Many small files are few batches on many tasks, and their tables are not broadcast."""
    parts = list(camera.rows_of("a", Held(_camera())))
    assert len(list(camera._gathered(iter(parts * 50)))) == 1
    assert sum(b.num_rows for b in camera._gathered(iter(parts * 50))) == 50 * sum(b.num_rows for b in parts)
    assert spread(spark.range(10), "id").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    raw = spark.createDataFrame([(str(i), bytearray(_camera())) for i in range(3)], "recording_id string, content binary")
    names = aimd.channels(raw).select("recording_id", "channel_idx", "name")
    for df in (aimd.samples(raw), aimd.samples(raw, True), aimd.frame_times(aimd.tracks(raw)), pds.tables(pds.heads(raw))["channels"], opening._films(raw, False)["channels"]):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert names.count() == 3 * aimd.channels(raw.limit(1)).count()
