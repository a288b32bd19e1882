"""Logs whose layout is searched for: every layout on its own bytes, noise, damage, types, units and byte ranges."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.plans import fixtures
from paddock.sources import opening, pds
from paddock.sources.fileio import Held, Ranged

CHANNELS = [(1, "Speed", 6, 3, "km/h"), (2, "Gear", 1, 0, ""), (3, "Lap", 3, 0, "cnt"), (4, "Load", 7, 14, "kN"), (5, "Temp", 2, 4, "C"), (6, "Yaw", 6, 8, "")]


def chunk(cid, code, values, ticks=10_000):
    return cid, ticks, len(values), np.array(values).astype(pds.TYPES[code][1]).tobytes()


def log(**options):
    export = not options.get("marked", True)
    channels = [(c, n, 7 if export else k, q, u) for c, n, k, q, u in CHANNELS]
    chunks = [chunk(c, k, [i + c for i in range(3 + part)]) for part in range(3) for c, _, k, _, _ in channels]
    return fixtures.searched_log(channels, chunks, **options)


def test_every_layout_is_found_and_noise_is_not():
    for place in pds.DIRECTORIES:
        for marked in (True, False):
            told = pds.head(Held(log(directory=place, marked=marked)))
            assert told["layout"] == f"{'marker' if marked else 'markerless'}@0x{place:x}"
            assert ("pds.directory_offset_nonstandard" in [c for _, c, _ in told["problems"]]) == (place != 0x80)
    rnd = random.Random(1)
    for size in (10, 255, 256, 300, 5000):
        with pytest.raises(pds.Unreadable):
            pds.head(Held(rnd.randbytes(size)))
    with pytest.raises(pds.Unreadable):
        pds.head(Held(bytes(4096)))


def test_types_from_how_chunks_lie():
    for type_at in (0x20 + 0x68, 0xD0, 0xF4, 0x128):
        told = pds.head(Held(log(type_at=type_at, quantity_at=0x84)))
        assert told["type_at"] == type_at and [c[3] for c in told["channels"]] == [k for _, _, k, _, _ in CHANNELS]
    # two fields with the same codes: the first
    data = bytearray(log(type_at=0xF0))
    for k, (_, _, code, _, _) in enumerate(CHANNELS):
        struct.pack_into("<I", data, 0x200 + 0x130 * k + 0xD8, code)
    assert pds.head(Held(bytes(data)))["type_at"] == 0xD8


def test_units_by_votes_and_by_dimension(spark):
    names = [(i + 1, f"c{i}", 6, q, "") for i, q in enumerate((3, 4, 7, 8, 9, 10, 11, 99))]
    told = lambda ch: [(c[4], c[5]) for c in pds.head(Held(fixtures.searched_log(ch, [chunk(c, 6, [1, 2]) for c, *_ in ch])))["channels"]]
    assert all(q is None for q, _ in told(names))  # a code that nobody knows: no field
    known = [*names[:7], (8, "c7", 6, 16, "")]
    assert [q for q, _ in told(known)] == [3, 4, 7, 8, 9, 10, 11, 16]
    assert all(q is None for q, _ in told(known[:5]))  # too few to tell
    lone = [(c, n, k, 0, "widgets") for c, n, k, _, _ in names[:3]]
    assert [u for _, u in told(lone)] == ["widgets"] * 3
    rows = spark.createDataFrame([(3, "km/h"), (3, ""), (0, "raw"), (0, ""), (77, None), (None, "V"), (23, "")], "q int, d string")
    unit, source = pds.unit_of(F.col("q"), F.col("d"))
    assert [tuple(r) for r in rows.select(unit, source).collect()] == [
        ("km/h", "declared"), ("m/s", "spec_default"), ("raw", "spec_default"), ("", "unknown"), ("", "unknown"), ("V", "declared"), ("rad/s^2", "spec_default"),
    ]


def parse(spark, *contents):
    raw = spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(contents)], "recording_id string, content binary")
    found = pds.tables(pds.heads(raw))
    return found | {"samples": pds.samples(found["chunks"], raw, rows=4)}


def test_time_bases_follow_the_table(spark):
    ch = CHANNELS[:4]
    chunks = [chunk(1, 6, [1, 2, 3]), chunk(2, 1, [7, 8]), chunk(3, 3, [1]), chunk(4, 7, [0.5]), chunk(1, 6, [4], 20_000), chunk(2, 1, [9]), chunk(1, 6, [5, 6])]
    found = parse(spark, fixtures.searched_log(ch, chunks))
    got = {(r["channel_idx"], r["local_idx"]): (r["chunk_idx"], r["t_ns"], r["value"]) for r in found["samples"].collect()}
    ms = 1_000_000
    assert [got[0, i] for i in range(6)] == [(0, 0, 1.0), (0, ms, 2.0), (0, 2 * ms, 3.0), (1, 3 * ms, 4.0), (2, 5 * ms, 5.0), (2, 6 * ms, 6.0)]
    assert [got[1, i] for i in range(3)] == [(0, 0, 7.0), (0, ms, 8.0), (1, 2 * ms, 9.0)] and len(got) == 11
    assert {r["channel_idx"]: (r["sample_count"], r["duration_ns"]) for r in found["channels"].collect()}[0] == (6, 7 * ms)


def test_cut_unknown_and_damaged_logs_are_rows(spark):
    whole = fixtures.searched_log(CHANNELS, [chunk(c, k, [1, 2, 3]) for c, _, k, _, _ in CHANNELS] + [chunk(77, 6, [1])])
    found = parse(spark, whole, whole[:-14], b"noise" * 100, b"")
    told = {(r["recording_id"], r["code"]) for r in found["diagnostics"].collect()}
    assert told >= {("0", "pds.chunk_channel_unknown"), ("1", "pds.sample_count_clamped"), ("1", "pds.sample_data_truncated"), ("2", "pds.unreadable"), ("3", "pds.unreadable")}
    counts = {(r["recording_id"], r["name"]): r["sample_count"] for r in found["channels"].collect()}
    assert counts["0", "Yaw"] == 3 and counts["1", "Yaw"] == 0 and counts["1", "Temp"] == 3
    rnd = random.Random(4)
    for _ in range(400):
        data = bytearray(log(marked=rnd.random() < 0.5))
        for _ in range(rnd.randrange(1, 30)):
            data[rnd.randrange(0x80, len(data))] = rnd.choice((0, 1, 255, rnd.randrange(256)))
        try:
            pds.head(Held(bytes(data[: rnd.randrange(len(data))] if rnd.random() < 0.3 else data)))
        except pds.Unreadable:
            pass


def test_interleaved_table_and_duplicate_definitions(spark):
    ch = [(i, n, 7, q, u) for i, (_, n, _, q, u) in enumerate(CHANNELS)]
    chunks = [chunk(c, 7, [part * 10 + c]) for part in range(2) for c, *_ in ch]
    found = parse(spark, fixtures.searched_log(ch, chunks, marked=False, twice=False), fixtures.searched_log([(50, "a", 6, 0, ""), (50, "b", 6, 0, "")], [chunk(50, 6, [1.5]), chunk(50, 6, [2.5])]))
    got = {(r["recording_id"], r["channel_idx"], r["local_idx"]): r["value"] for r in found["samples"].collect()}
    assert got == {("0", c, part): part * 10.0 + c for part in range(2) for c in range(6)} | {("1", 1, 0): 1.5, ("1", 1, 1): 2.5}


def test_large_file_is_read_by_ranges(spark, tmp_path):
    path = tmp_path / "big.PDS"
    data = bytearray(log())
    table = 0x200 + 0x130 * len(CHANNELS)
    far = 2_600_000_000
    struct.pack_into("<I", data, table + 0x40 * 12 + 0x38, far)  # the last chunk of Speed lies far out
    with open(path, "wb") as f:
        f.write(data)
        f.seek(far)
        f.write(np.array([5, 6, 7, 8, 9], "<f4").tobytes())
    with Ranged(f"file://{path}") as source:
        told = pds.head(source)
        assert source.taken < 4_000 and told["size"] == far + 20
    opened = opening.open_folder(spark, str(tmp_path))
    got = opened["samples"].join(opened["channels"].where("name = 'Speed'"), ["recording_id", "channel_idx"]).orderBy("local_idx").select("value")
    assert [r["value"] for r in got.collect()] == [1, 2, 3, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert opened["recordings"].select("format", "read").collect()[0] == ("pds", True)
    named = opening.open_folder(spark, str(tmp_path), metadata=True)
    assert {r["channel_idx"] for r in named["samples"].select("channel_idx").distinct().collect()} == {2}
