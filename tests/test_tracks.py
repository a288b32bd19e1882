"""Track catalogs from JSON lines, and progress along centerlines of many segments."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import functions as F

from paddock.operators import tracks
from paddock.sources import catalog


def test_catalog(spark, tmp_path):
    line = {"type": "LineString", "coordinates": [[1.0, 2.0], [1.5, 2.5], [3.0], [7.0, 95.0], [2.0, 3.0, 9.0]]}
    layout = {"id": "gp", "name": "Grand Prix", "length_m": 5000, "direction": "clockwise", "centerline_geojson": line}
    place = {"lat": 2.0, "lon": 1.0, "timezone": "Europe/Berlin"}
    good = {"slug": "a", "name": "Alpha", "country": "DE", "aka": ["A", "Al"], "location": place, "layouts": [layout, {"id": "short", "name": "Short", "centerline_geojson": {"type": "Feature", "geometry": line}}]}
    rows = [
        good, good | {"slug": "b", "aka": None, "country": None}, good | {"slug": None}, good | {"slug": "c", "name": None}, good | {"slug": "d", "location": {"lat": 91, "lon": 0}}, good | {"slug": "e", "layouts": []}, good | {"slug": "f", "layouts": [{"id": None, "name": "x"}]}, good,
    ]
    (tmp_path / "tracks.jsonl").write_text("\n".join([*map(json.dumps, rows), "not json", ""]))
    held = catalog.load(spark, str(tmp_path))
    assert [tuple(r) for r in held["tracks"].orderBy("ordinal").collect()] == [(0, "a", "Alpha", "DE", ["A", "Al"], 2.0, 1.0, "Europe/Berlin"), (1, "b", "Alpha", "", [], 2.0, 1.0, "Europe/Berlin")]
    assert [tuple(r) for r in held["layouts"].where("slug = 'a'").orderBy("nth").collect()] == [("a", 0, "gp", "Grand Prix", 5000.0, "clockwise"), ("a", 1, "short", "Short", None, None)]
    for name in ("gp", "short"):
        assert [tuple(r)[2:] for r in held["points"].where(f"slug = 'a' and layout = '{name}'").orderBy("idx").collect()] == [(0, 2.0, 1.0), (1, 2.5, 1.5), (4, 3.0, 2.0)]
    assert {(r["ordinal"], r["problem"]) for r in held["problems"].collect()} == {
        (2, "catalog.slug"), (3, "catalog.name"), (4, "catalog.location"), (5, "catalog.layouts"), (6, "catalog.layout"), (7, "catalog.repeated"), (8, "catalog.slug"),
    }


def circuit(spark, n):
    spots = [("t", i, 50 + 0.02 * math.sin(2 * math.pi * i / n) * (1 + 0.2 * math.cos(14 * math.pi * i / n)), 8 + 0.04 * math.cos(2 * math.pi * i / n)) for i in range(n + 1)]
    return tracks.segments(spark.createDataFrame([*spots, ("u", 0, 1.0, 1.0), ("u", 1, 1.0, 1.5), ("dot", 0, 5.0, 5.0), ("dot", 1, 5.0, 5.0)], "slug string, idx int, lat double, lon double"), ["slug"])


def test_rings_equal_all_pairs(spark):
    rnd = random.Random(6)
    segs = circuit(spark, 700).cache()
    near = [(i, "t", 50 + 0.02 * math.sin(a) * 1.05 + rnd.gauss(0, 1e-4), 8 + 0.04 * math.cos(a)) for i, a in enumerate(rnd.random() * 7 for _ in range(300))]
    far = [(1000, "t", 50.0, 8.0), (1001, "t", 60.0, 8.0), (1002, "u", 1.0, 1.2), (1003, "u", 1.3, 0.2), (1004, "none", 1.0, 1.0), (1005, "dot", 5.0, 5.0), (1006, "t", None, 8.0), (1007, "t", float("nan"), 8.0)]
    points = spark.createDataFrame(near + far, "k int, slug string, lat double, lon double")
    want = {r["k"]: (r["progress"], r["distance_m"]) for r in tracks.progress(points.where("k < 1006"), segs, ["slug"], ["k"]).collect()}
    for cell in (None, 0.0005, 0.05):
        assert {r["k"]: (r["progress"], r["distance_m"]) for r in tracks.progress_at_size(points, segs, ["slug"], ["k"], cell=cell).collect()} == want
    assert tracks.progress_at_size(points.where("false"), segs, ["slug"], ["k"]).count() == 0
    segs.unpersist()


def test_few_segments_are_compared(spark, monkeypatch):
    """On a line of 100,000 segments a point near it meets a handful."""
    segs = circuit(spark, 100_000)
    seen = []
    real = tracks.materialize
    monkeypatch.setattr(tracks, "materialize", lambda df: (seen.append(real(df)), seen[-1])[1])
    points = spark.range(200).select(F.col("id").alias("k"), F.lit("t").alias("slug"), (50 + 0.02 * F.sin(F.col("id") / 30.0) * (1 + 0.2 * F.cos(7 * F.col("id") / 30.0)) + 1e-7).alias("lat"), (8 + 0.04 * F.cos(F.col("id") / 30.0)).alias("lon"))
    assert tracks.progress_at_size(points, segs, ["slug"], ["k"]).count() == 200
    compared = [df.agg(F.max("_compared")).first()[0] for df in seen if "_compared" in df.columns]
    assert len(compared) == 1 and compared[0] < 100
