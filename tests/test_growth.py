"""Work of one task, of the driver and of shuffles, where a few bytes of input are many rows."""

from __future__ import annotations

import pickle
import re

from pyspark.sql import functions as F

from paddock.functions import names, timespan
from paddock.operators import lattice, summary, tracks
from paddock.sources import aimd, ld, ldwrite, opening, sidecar


def parts(df):
    """The number of tasks whose rows end up in ``df``."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_roles_are_resolved_by_many_tasks(spark):
    held = spark.range(400).select(F.col("id").alias("recording_id"), F.explode(F.array(F.lit("Speed"), F.lit("Lap"), F.lit("Ground Speed"))).alias("name")).withColumn("channel_idx", F.length("name")).coalesce(1)
    got = names.resolve_roles(held)
    assert parts(got) > 8
    assert sorted(tuple(r) for r in got.where("recording_id = 7").collect()) == [(7, "lap_number", 3), (7, "speed", 12)]


def test_points_of_one_track_are_dealt_over_tasks(spark):
    line = spark.createDataFrame([("t", i, 50.0 + 0.01 * i, 7.0) for i in range(5)], "slug string, idx int, lat double, lon double")
    points = spark.createDataFrame([(i, "t", 50 + i / 10_000, 7.5) for i in range(300)], "id long, slug string, lat double, lon double").coalesce(1)
    segs = tracks.segments(line, ["slug"])
    far = tracks.progress(points, segs, ["slug"], ["id", "slug"])
    near = tracks.progress_at_size(points.withColumn("lon", F.lit(7.001)), segs, ["slug"], ["id", "slug"])
    assert parts(far) > 8 and far.count() == near.count() == 300
    assert [round(r["progress"], 4) for r in near.where("id = 100").collect()] == [0.25]


def test_slots_are_not_shuffled(spark):
    rows = [("a", 0, 0, 95, 1.0), ("a", 0, 1, 98, 2.0), ("a", 0, 2, 120, float("nan")), ("a", 0, 3, 141, 4.0), ("b", 0, 0, 50, None), ("c", 0, 0, -40, 7.0), ("c", 0, 1, 20, 8.0)]
    s = spark.createDataFrame(rows, "recording_id string, chunk_idx int, local_idx int, t_ns long, value double").withColumns({"t0_ns": F.lit(70).cast("long"), "period_ns": F.lit(10).cast("long")})
    got = lattice.align(s, None, ["recording_id"])
    told = {(r["recording_id"], r["slot"]): r["value"] for r in got.collect()}
    assert {k[1]: v for k, v in told.items() if k[0] == "a"} == {0: None, 1: None, 2: None, 3: 1.0, 4: None, 5: None, 6: None, 7: 4.0}
    assert {k[0] for k in told} == {"a"} and got.where("slot = 3").first()["t_ns"] == 100
    assert lattice.align(s, None, ["recording_id"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_logs_are_moved_by_folders(spark, tmp_path):
    made = lambda ids, data: spark.createDataFrame([(f"r{i}", 0, bytearray(data)) for i in ids], ldwrite.PIECES)
    told = lambda: {r["recording_id"].rsplit("/", 1)[1]: bytes(r["content"]) for r in ld.in_folders(spark, str(tmp_path), held=10).collect()}
    ldwrite.write(made(range(40), b"one"), str(tmp_path), folders=3)
    assert len(list(tmp_path.iterdir())) == 3 and all(p.is_dir() for p in tmp_path.iterdir())
    ldwrite.write(made(range(39, 42), b"two"), str(tmp_path), folders=3)
    assert told() == {f"r{i}.ld": b"one" if i < 39 else b"two" for i in range(42)}
    ldwrite.write(made([7], b"new"), str(tmp_path), "overwrite", folders=3)
    assert told() == {"r7.ld": b"new"}
    # what a task tells the driver doesn't grow with its files
    size = lambda n: len(pickle.dumps(ldwrite.LogWriter({"path": str(tmp_path), "folders": "3"}, False).write(iter([(f"x{i}", 0, b"") for i in range(n)]))))
    assert size(50) == size(1)


def test_recordings_to_write_are_not_broadcast(spark, tmp_path, monkeypatch):
    def stored(table, **columns):
        spark.range(20).select(F.col("id").cast("string").alias("recording_id"), *[v.alias(k) for k, v in columns.items()]).write.parquet(f"{tmp_path}/{table}")
        return spark.read.parquet(f"{tmp_path}/{table}")

    none, one = F.lit(0), F.lit(1).cast("long")
    channels = stored("channels", channel_idx=none, name=F.lit("Speed"), unit=F.lit(""), sample_type=F.lit("u8"))
    chunks = stored("chunks", channel_idx=none, chunk_idx=none, sample_period_ns=F.lit(10_000_000).cast("long"), sample_count=one, time_base_ns=F.lit(0).cast("long"))
    samples = stored("samples", channel_idx=none, local_idx=F.lit(0).cast("long"), value=F.col("id").cast("double"))
    held = channels, chunks, samples, stored("identity", driver=F.when(F.col("id") == 3, "€").otherwise("Zoë"))
    # the driver plans anew after each exchange, so what is used more than once isn't planned more than once
    assert ldwrite.pieces(*held)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") < 10
    monkeypatch.setattr(ldwrite, "materialize", lambda df: df, raising=False)
    refused, laid_out = ldwrite.refusals(*held), ldwrite.pieces(*held)
    assert [r["recording_id"] for r in refused.collect()] == ["3"]
    assert {r["recording_id"] for r in laid_out.collect()} == {str(i) for i in range(20)} - {"3"}
    for df in (refused, laid_out):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_times_of_values_are_parsed_once(spark):
    parses = lambda c: str(c).count("regexp_extract")
    assert parses(sidecar.meta_values(F.col("line"))) == parses(timespan.parse_ms(F.col("x"))) > 0
    line = '{"k":"s","m":[["a","1:02.345"],["b",7],["c",{"v":"0:01.000","u":"laptime_ms"}],["d",{"v":1,"u":"x"}],[1,"t"],["e",true],["f","word"],["g",-1]]}'
    got = spark.createDataFrame([(line,)], "line string").select(F.explode(sidecar.meta_values(F.col("line"))).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in got] == [
        ("a", None, 62345, None), ("b", None, 7, None), ("c", None, 1000, None), ("d", None, 1, "meta_unit"), ("1", "t", None, "meta_name"), ("e", None, None, "meta_value"), ("f", "word", None, None), ("g", None, None, "meta_range"),
    ]


def counting(df):
    """``df`` and an accumulator of the rows of it that were worked out."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), made


def test_texts_and_lines_are_worked_out_once(spark):
    row = lambda i: f"9 {235950 + i if i < 10 else i - 10:06d} {i // 4} {'x' if i == 2 else '4.0'}"
    logs = [(f"v{k}", "File created on 31/07/2006 at 09:55:20\n[column names]\nsats time Lap Tsample\n[data]\n1\n" + "\n".join(row(i) for i in range(13))) for k in range(5)]
    logs.append(("untimed", "[column names]\nsats Lap\n[data]\n1 2\n"))
    texts, made = counting(spark.createDataFrame(logs, "recording_id string, text string"))
    held = [(f"j{k}", i, line) for k in range(4) for i, line in enumerate(['{"mtj":1,"q":10000000,"dur":3000000000}', "[]", '{"n":"Lap","hz":1,"v":[1,2,3]}'])]
    lines, split = counting(spark.createDataFrame(held, "recording_id string, n int, line string"))
    opened = opening.tables({"vbo": texts, "plain": lines})
    samples = {(r["recording_id"], r["channel_idx"], r["local_idx"]): (r["t_ns"], r["value"]) for r in opened["samples"].collect()}
    laps = [r["start_ns"] for r in opened["laps"].where("recording_id = 'v3' and origin = 'counter'").orderBy("start_ns").collect()]
    told = {(r["code"], r["channel"]) for r in opened["diagnostics"].where("recording_id = 'v1'").collect()}
    assert samples["v1", 1, 12] == (12_000_000_000, 12.0) and samples["v1", 0, 12] == (12_000_000_000, 9.0) and laps == [4_000_000_000, 8_000_000_000, 12_000_000_000]
    assert told == {("vbo.value_unparsable", "Tsample"), ("vbo.row_too_few_tokens", None)} and not [k for k in samples if k[0] == "untimed"]
    assert {r["duration_ns"] for r in opened["channels"].where("recording_id = 'v1'").collect()} == {16_000_000_000}
    # the texts once to count the files and once to read them
    assert made.value == 2 * len(logs) and split.value == len(held)
    start = {r["recording_id"]: r["absolute_start_ns"] for r in opened["origins"].collect()}
    assert start["v1"] == 86_390_000_000_000 and start["untimed"] is None


def test_clock_fits_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(aimd, "TASK_ROWS", 40, raising=False)
    stamps = spark.range(4_000).select(F.concat(F.lit("r"), (F.col("id") % 200)).alias("recording_id"), (F.col("id") % 2).cast("int").alias("channel_idx"), F.floor(F.col("id") / 200).cast("long").alias("local_idx"), (F.floor(F.col("id") / 200) * 100).cast("long").alias("t_ns"))
    got = aimd.fit_chunks(stamps)
    # but for the few pieces at the end, no step deals the rows anew
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(recording_id#\d+, channel_idx#\d+, 100\), REPARTITION_BY_NUM", plan) and plan.count("ENSURE_REQUIREMENTS") == 1
    assert {tuple(r)[2:] for r in got.collect()} == {(0, 100, 20, 0, 0)} and got.count() == 200


def test_schemas_are_hashed_by_many_tasks(spark):
    held = spark.range(300).select(F.col("id").cast("string").alias("recording_id"), F.lit(0).alias("channel_idx"), F.lit("Speed").alias("name"), F.lit("km/h").alias("unit"), F.lit("f64").alias("sample_type")).coalesce(1)
    got = summary.schema_hash(held)
    assert parts(got) > 8 and got.select("schema_hash").distinct().count() == 1
