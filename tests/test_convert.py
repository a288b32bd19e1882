"""Stores with staged versions, and digests of files by ranges."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from paddock.operators import convert
from paddock.sources import digest


def opened(spark, shift=0.0, ids=("a", "b")):
    channels = spark.createDataFrame([(r, 0, 0, "Speed", "m/s", "declared", "f64", 3, 30) for r in ids], "recording_id string, channel_idx int, id int, name string, unit string, unit_source string, sample_type string, sample_count bigint, duration_ns bigint")
    samples = spark.createDataFrame([(r, 0, 0, i, i * 1_000_000_000, float(i + shift)) for r in ids for i in range(3)], "recording_id string, channel_idx int, chunk_idx int, local_idx bigint, t_ns bigint, value double")
    return {"channels": channels, "samples": samples}


def values(spark, store, name="Speed"):
    c = convert.current(spark, store, "channels").where(F.col("name") == name).select("recording_id", "channel_idx")
    return {(r["recording_id"], r["local_idx"]): r["value"] for r in convert.current(spark, store, "samples").join(c, ["recording_id", "channel_idx"]).collect()}


def test_convert_replaces_recordings_whole(spark, tmp_path, monkeypatch):
    store = f"file:{tmp_path}/store"
    convert.convert(opened(spark), store, "one", "skip")
    first = values(spark, store)
    assert first == {(r, i): float(i) for r in "ab" for i in range(3)}
    # stopped between write and swap: the old rows stay
    real = convert.publish
    monkeypatch.setattr(convert, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        convert.convert(opened(spark, 10, ("b", "c")), store, "two", "skip")
    assert values(spark, store) == first
    monkeypatch.setattr(convert, "publish", real)
    for _ in range(2):  # a second run changes nothing
        convert.convert(opened(spark, 10, ("b", "c")), store, "two", "skip")
        assert values(spark, store) == {("a", i): float(i) for i in range(3)} | {(r, i): i + 10.0 for r in "bc" for i in range(3)}
    assert convert._latest(spark, store) == 2
    # two jobs at once: the second to publish is told
    monkeypatch.setattr(convert, "_latest", lambda *a: 1)
    with pytest.raises(convert.Conflict):
        convert.publish(spark, store, "three", opened(spark)["channels"])
    monkeypatch.undo()
    assert {r["version"] for r in convert.manifest(spark, store).collect()} == {"one", "two"}


def test_convert_applies_and_strips(spark, tmp_path):
    store = f"file:{tmp_path}/store"
    reports = convert.convert(opened(spark), store, "with", "apply")
    assert {(r["recording_id"], r["outcome"]) for r in reports.where("name = 'speed.distance'").collect()} == {("a", "applied"), ("b", "applied")}
    assert values(spark, store, "Distance Odometer")["a", 2] == pytest.approx(2.0)
    held = {k: convert.current(spark, store, k) for k in ("channels", "samples")}
    applied = convert.current(spark, store, "passes")
    again = convert.convert(held, store, "again", "apply", applied)
    assert {r["outcome"] for r in again.where("name = 'speed.distance'").collect()} == {"already applied"}
    convert.convert({k: convert.current(spark, store, k) for k in ("channels", "samples")}, store, "bare", "strip", convert.current(spark, store, "passes"))
    assert {r["name"] for r in convert.current(spark, store, "channels").collect()} == {"Speed"} and convert.current(spark, store, "passes").count() == 0
    assert values(spark, store) == {(r, i): float(i) for r in "ab" for i in range(3)}
    with pytest.raises(ValueError, match="mode"):
        convert.convert(held, store, "x", "other")


def test_digests_do_not_depend_on_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digest, "LEAF_BYTES", 1000)
    rnd = random.Random(2)
    want = {}
    for n in (0, 1, 999, 1000, 1001, 2000, 7777):
        data = rnd.randbytes(n)
        (tmp_path / f"f{n}").write_bytes(data)
        level = [hashlib.sha256(b"\0" + data[i : i + 1000]).digest() for i in range(0, max(n, 1), 1000)]
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        want[f"{tmp_path}/f{n}"] = (n, level[0].hex())
    files = spark.createDataFrame([(p,) for p in want] + [(f"{tmp_path}/none",)], "path string")
    for leaves in (1, 3, 64):
        got = {r["path"]: r for r in digest.digests(files, leaves).collect()}
        assert {p: (got[p]["size"], got[p]["digest"]) for p in want} == want
        assert got[f"{tmp_path}/none"]["digest"] is None and got[f"{tmp_path}/none"]["problem"].startswith("digest.unreadable")
