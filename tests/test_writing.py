"""Writing binary logs, comparing openings, numbers as text, hashes in expressions."""

from __future__ import annotations

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paddock.functions import numbers
from paddock.operators import compare, summary
from paddock.sources import ld, ldwrite

CHANNELS = "recording_id string, channel_idx int, name string, unit string, sample_type string"
CHUNKS = "recording_id string, channel_idx int, chunk_idx int, sample_period_ns bigint, sample_count bigint, time_base_ns bigint"
SAMPLES = "recording_id string, channel_idx int, local_idx bigint, t_ns bigint, value double"
MS = 1_000_000


def tables(spark, recordings):
    """``recordings``: id to a list of (name, unit, type, chunks of (period, base, values))."""
    channels, chunks, samples = [], [], []
    for rid, held in recordings.items():
        for c, (name, unit, kind, parts) in enumerate(held):
            channels.append((rid, c, name, unit, kind))
            n = 0
            for k, (period, base, values) in enumerate(parts):
                chunks.append((rid, c, k, period, len(values), base))
                samples += [(rid, c, n + i, base + i * period, float(v)) for i, v in enumerate(values)]
                n += len(values)
    return spark.createDataFrame(channels, CHANNELS), spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(samples, SAMPLES)


def test_log_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ldwrite, "BLOCK", 4)
    values = {"i8": [-128, 127], "u8": [0, 255], "i16": [-32768, 32767], "u16": [0, 65535], "i32": [-(2**31), 2**31 - 1], "u32": [0, 2**32 - 1], "f32": [0.5, -1.25], "f64": [0.1, float("inf")]}
    made = {"one": [(f"c{k}°", "°C", k, [(10 * MS, 0, v * 3), (10 * MS, 60 * MS, v)]) for k, v in values.items()], "two": [("Solo", "", "f64", [(MS, 0, range(11))]), ("none", "", "u8", [])]}
    held = tables(spark, made)
    identity = spark.createDataFrame([("one", "Zoë", "Spa", "event")], "recording_id string, driver string, venue string, event string")
    assert ldwrite.refusals(*held, identity).count() == 0
    ldwrite.write(ldwrite.pieces(*held, identity), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one.ld", "two.ld"]
    raw = ld.files(spark, str(tmp_path)).withColumn("recording_id", F.regexp_extract("recording_id", r"(\w+)\.ld$", 1))
    told = {(r["recording_id"], r["name"]): r for r in ld.channels(raw).collect()}
    wide = {"i8": "i16", "u8": "i16", "u16": "i32", "u32": "f64"}
    got = {}
    for r in ld.samples(raw).collect():
        got.setdefault((r["recording_id"], r["channel_idx"]), {})[r["local_idx"]] = r["value"]
    for c, (k, v) in enumerate(values.items()):
        r = told["one", f"c{k}°"]
        assert (r["sample_type"], r["unit"], r["period_ns"], r["problem"]) == (wide.get(k, k), "°C", 10 * MS, None)
        assert [got["one", c][i] for i in range(8)] == [float(x) for x in v * 4]
    assert len(got["two", 0]) == 11 and ("two", "none") not in told
    assert [tuple(r)[3:6] for r in ld.identity(raw).where("recording_id = 'one'").collect()] == [("Zoë", "", "Spa")]
    data = (tmp_path / "one.ld").read_bytes()
    assert struct.unpack_from("<I", data, 0x56)[0] == 8 and data[ldwrite.HEADER : ldwrite.HEADER + 5] == b"event"
    # a second write adds, an overwrite replaces
    ldwrite.write(ldwrite.pieces(*tables(spark, {"two": [("Solo", "", "u8", [(MS, 0, [1])])]}), identity), str(tmp_path), "overwrite")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["two.ld"]


def test_refusals_are_rows(spark):
    f = lambda period, values=(1, 2), base=0: [(period, base, list(values))]
    made = {
        "zero": [("a", "", "u8", f(0))], "mixed": [("a", "", "u8", f(MS) + [(2 * MS, 2 * MS, [1])])], "odd": [("a", "", "u8", f(3))], "slow": [("a", "", "u8", f(2_000 * MS))], "fast": [("a", "", "u8", f(10_000))],
        "gap": [("a", "", "u8", f(MS) + [(MS, 5 * MS, [1])])], "frac": [("a", "", "i16", f(MS, [1, 2.5]))], "nan": [("a", "", "f32", f(MS, [float("nan")]))], "inexact": [("a", "", "f32", f(MS, [0.1]))], "over": [("a", "", "u16", f(MS, [2**31]))],
        "name": [("a" * 32, "", "u8", f(MS))], "unit": [("a", "€", "u8", f(MS))], "type": [("a", "", "u64", f(MS))], "empty": [("a", "", "u8", [])], "text": [("a", "", "u8", f(MS))], "good": [("a" * 31, "é" * 11, "u8", f(MS))],
    }
    identity = spark.createDataFrame([("text", "v" * 64), ("good", "v" * 63)], "recording_id string, vehicle string")
    held = tables(spark, made)
    got = {r["recording_id"]: r["code"] for r in ldwrite.refusals(*held, identity).collect()}
    assert got == {
        "zero": "ldwrite.no_clock", "mixed": "ldwrite.mixed_periods", "odd": "ldwrite.frequency", "slow": "ldwrite.frequency", "fast": "ldwrite.frequency", "gap": "ldwrite.gap", "frac": "ldwrite.value", "nan": "ldwrite.value", "inexact": "ldwrite.value",
        "over": "ldwrite.value", "name": "ldwrite.name", "unit": "ldwrite.unit", "type": "ldwrite.type", "empty": "ldwrite.empty", "text": "ldwrite.text",
    }
    assert {r["recording_id"] for r in ldwrite.pieces(*held, identity).collect()} == {"good"}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = [("a", 0, bytearray(b"head")), ("a", 4, bytearray(b"data")), ("b", 0, bytearray(b"head")), ("b", 9, bytearray(b"hole"))]
    with pytest.raises(Exception, match="bytes at 9 follow 4"):
        ldwrite.write(spark.createDataFrame(rows, ldwrite.PIECES), str(tmp_path))
    assert list(tmp_path.rglob("*")) == []


def test_compare(spark):
    make = lambda **r: dict(zip(("channels", "x", "samples"), tables(spark, r)))
    nan = float("nan")
    left = make(r=[("a", "m", "f64", [(MS, 0, [1, nan, 3])]), ("b", "m", "f64", [(MS, 0, [1, 2])]), ("b", "m", "f64", [(MS, 0, [5])]), ("c", "m", "u8", [(MS, 0, [1])]), ("e", "", "u8", [])], q=[("only", "", "u8", [(MS, 0, [1])])])
    right = make(r=[("b", "m", "f64", [(MS, 0, [1, 4])]), ("a", "m", "f64", [(MS, 0, [1, nan, 3])]), ("b", "m", "f64", [(2 * MS, 0, [5, 6])]), ("c", "ft", "u8", [(MS, 0, [1])]), ("d", "", "u8", [(MS, 0, [1])]), ("e", "", "u8", [])])
    got = {(r["recording_id"], r["name"], r["nth"]): r for r in compare.compare(left, right).collect()}
    verdict = {k: (r["verdict"], r["differing"], r["first_difference"]) for k, r in got.items()}
    assert verdict == {
        ("r", "a", 0): ("equal", 0, None), ("r", "b", 0): ("differs", 1, 1), ("r", "b", 1): ("differs", 1, 1), ("r", "c", 0): ("differs", 0, None), ("r", "d", 0): ("right_only", 1, 0), ("r", "e", 0): ("equal", 0, None), ("q", "only", 0): ("left_only", 1, 0),
    }
    assert got["r", "b", 0]["max_delta"] == 2 and got["r", "c", 0]["unit_differs"] and not got["r", "a", 0]["unit_differs"]


def test_numbers_over_bit_patterns(spark):
    rng = np.random.default_rng(7)
    wide = rng.integers(0, 2**64, 500_000, np.uint64).view(np.float64)
    narrow = rng.integers(0, 2**32, 500_000, np.uint32).view(np.float32).astype(np.float64)
    edges = [0.0, -0.0, 1e-7, 5e-324, 2.0**63, -(2.0**63), 2.0**64, 1e300, 0.1, 1.5, -2.25, 123456789.0, float(np.float32(0.1)), float("inf"), float("nan"), 1e22]
    x = np.concatenate([wide, narrow, edges])
    told = numbers.texts_of(pa.array(x)).to_pylist()
    for v, t in zip(x, told):
        if not np.isfinite(v):
            assert t == "null"
            continue
        assert "e" not in t and (float(t) == v or float(np.float32(t)) == v)
    fractions = x[np.isfinite(x) & (np.abs(x) < 1e6) & (x != np.floor(x)) & (np.abs(x) > 1e-4)][:20_000]
    for v, t in zip(fractions, numbers.texts_of(pa.array(fractions)).to_pylist()):
        assert t == (str(np.float32(v)) if float(np.float32(v)) == v else repr(float(v)))
    assert told[-16:-9] == ["0", "0", "0.0000001", told[-13], "9223372036854775807", "-9223372036854775808", "18446744000000000000"]
    assert [r["t"] for r in spark.createDataFrame([(1.5,), (None,)], "v double").select(numbers.number_text(F.col("v")).alias("t")).collect()] == ["1.5", "null"]


def test_numbers_between_two_texts():
    x = [131072.125, 262144.375, -454199.03125, 61.6796875, 1441747.25, 524288.125, 0.5, 2.0**-14, 0.1]
    assert numbers.texts_of(pa.array(x), untie=True).to_pylist() == ["131072.125", "262144.375", "-454199.03", "61.6796875", "1441747.25", "524288.1", "0.5", "0.000061035156", "0.1"]
    assert numbers.texts_of(pa.array(x[:1])).to_pylist() == ["131072.12"]


def test_hash_in_expressions(spark):
    rnd = random.Random(3)
    texts = [b"", b"a", b"foobar", bytes(range(256)), rnd.randbytes(999)]

    def plain(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    got = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)] + [(9, None)], "i int, b binary").select("i", summary.fnv1a(F.col("b")).alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: plain(t) for i, t in enumerate(texts)} | {9: None}
    assert plain(b"a") == "af63dc4c8601ec8c"
