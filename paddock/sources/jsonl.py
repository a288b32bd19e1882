"""Line-oriented recordings: a header, laps, then one channel or span per line. Read and written with JSON functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.functions.clock import period_ns
from paddock.functions.numbers import number_text
from paddock.operators.lattice import valid_lattice
from paddock.session import materialize, ship, spread
from paddock.sources import sidecar

_HEADER = "mtj int, q bigint, dur bigint, o bigint, src string, drv string, veh string, ven string, utc bigint, tz string, hash string, clk string, abs bigint, abe bigint, hint string, evt string, ses string, date string, time string"
_CHANNEL = "n string, u string, hz double, t0 bigint, v array<double>"
MILLION = 1_000_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, n, line of plain and zstd files alike; a file stays in one piece, as its first line governs it."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("recording_id"), "value")
    return text.select("recording_id", F.posexplode(F.split("value", "\n")).alias("n", "line")).where(F.trim("line") != "")


def parse(lines: DataFrame) -> dict[str, DataFrame]:
    """recordings, laps, channels, samples, spans, videos, passes and problems of ``lines`` (recording_id, n, line).

    A recording with a problem has no other rows: version, lattice, lap, video (linked files, times or offset); json for
    a line that is no object; channel_name, channel_values, duplicate_name, period_off_lattice, t0_off_lattice,
    beyond_duration; what ``sidecar.span_rows`` tells of spans. Spans without a flag are visible.
    """
    w = Window.partitionBy("recording_id").orderBy("n")
    # every table below starts from the lines, so they are split, dealt and numbered once
    numbered = materialize(spread(lines.select("recording_id", "n", "line"), "recording_id").withColumn("k", F.row_number().over(w)))
    head = numbered.where("k = 1").select("recording_id", F.from_json("line", _HEADER).alias("h")).select("recording_id", "h.*").withColumn("o", F.coalesce("o", F.lit(0).cast("long")))
    top = numbered.where("k = 1").select("recording_id", sidecar.video_links(F.col("line")).alias("v"), sidecar.passes(F.col("line")).alias("p"))
    laps = numbered.where("k = 2").select("recording_id", F.explode(F.from_json("line", "array<array<string>>")).alias("l"))
    num = lambda i: F.get("l", F.lit(i)).try_cast("bigint")
    laps = laps.select("recording_id", num(0).alias("number"), num(1).alias("start_ns"), num(2).alias("end_ns"), (num(2) - num(1)).alias("duration_ns"), F.get("l", F.lit(3)).isin("1", "true").alias("complete"))
    rest = numbered.where("k > 2").join(head.select("recording_id", "q", "o", "dur"), "recording_id")
    spans = sidecar.span_rows(rest.withColumn("q_ns", F.col("q")), ["recording_id"], False)
    own = rest.where((F.coalesce(F.get_json_object("line", "$.k"), F.lit("")) != "s") & F.try_parse_json("line").isNotNull())
    body = own.withColumn("channel_idx", (F.row_number().over(w) - 1).cast("int")).withColumn("c", F.from_json("line", _CHANNEL))
    rows = body.select("recording_id", "channel_idx", "q", "o", "dur", F.col("c.n").alias("name"), F.coalesce("c.u", F.lit("")).alias("unit"), period_ns(F.col("c.hz")).alias("period_ns"), F.coalesce("c.t0", "o").alias("t0"), F.col("c.v").alias("v"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("recording_id", "name")) > 1
    problem = (
        F.when(F.coalesce("name", F.lit("")) == "", "channel_name").when(F.col("v").isNull(), "channel_values").when(twice, "duplicate_name")
        .when(F.col("period_ns").isNull() | (F.col("period_ns") % F.col("q") != 0), "period_off_lattice")
        .when((F.col("t0") < F.col("o")) | ((F.col("t0") - F.col("o")) % F.col("q") != 0), "t0_off_lattice")
        .when(F.col("t0") + F.size("v") * F.col("period_ns") > F.col("dur") + F.col("period_ns"), "beyond_duration")
    )
    # every table below is filtered by the problems of all, so each is worked out once
    checked, spans, top = materialize(rows.withColumn("problem", problem)), materialize(spans), materialize(top)
    bad_head = head.select("recording_id", F.when(F.col("mtj").isNull() | (F.col("mtj") != 1), "version").when(~F.coalesce(valid_lattice(F.col("q"), F.col("dur"), F.col("o")), F.lit(False)), "lattice").alias("problem")).where("problem is not null")
    bad_laps = laps.join(head.select("recording_id", "q", "o"), "recording_id").where("end_ns <= start_ns or (start_ns - o) % q != 0 or (end_ns - o) % q != 0 or start_ns is null or end_ns is null").select("recording_id", F.lit("lap").alias("problem")).distinct()
    bad_top = top.where("v.problem is not null").select("recording_id", F.lit("video").alias("problem"))
    found = [bad_head, bad_laps, bad_top, sidecar.not_json(rest, ["recording_id"]), checked.select("recording_id", "problem"), spans.select("recording_id", "problem")]
    problems = materialize(reduce(DataFrame.unionByName, found).where("problem is not null").distinct())
    good = lambda df: df.join(problems.select("recording_id").distinct(), "recording_id", "left_anti")
    fine = good(checked)
    channels = fine.select("recording_id", "channel_idx", F.col("channel_idx").alias("id"), "name", "unit", F.when(F.col("unit") == "", "unknown").otherwise("declared").alias("unit_source"), F.lit("f64").alias("sample_type"), F.size("v").cast("long").alias("sample_count"), (F.col("t0") + F.size("v") * F.col("period_ns")).alias("duration_ns"))
    samples = fine.select("recording_id", "channel_idx", "t0", "period_ns", F.posexplode("v").alias("i", "x")).select("recording_id", "channel_idx", F.lit(0).alias("chunk_idx"), F.col("i").cast("long").alias("local_idx"), (F.col("t0") + F.col("i") * F.col("period_ns")).alias("t_ns"), F.coalesce("x", F.lit(float("nan"))).alias("value"))
    files = good(top).select("recording_id", F.explode("v.files").alias("f")).select("recording_id", F.col("f.n").alias("filename"), F.col("f.i").cast("int").alias("idx"), F.coalesce("f.fc", F.lit(0).cast("long")).alias("frames"), F.col("f.b3").alias("digest"), F.col("f.po").alias("offset_ns"))
    videos = good(top).select("recording_id", F.col("v.offset_ns").alias("offset_ns"), F.col("v.pts_ns").alias("pts_ns")).where("offset_ns is not null or pts_ns is not null")
    applied = good(top).select("recording_id", F.posexplode("p").alias("position", "p")).select("recording_id", "position", "p.*")
    return {"recordings": good(head), "laps": good(laps), "channels": channels, "samples": samples, "spans": good(spans).drop("problem"), "files": files, "videos": videos, "passes": applied, "problems": problems}


def to_lines(aligned: DataFrame, lattice: DataFrame, laps: DataFrame, header: DataFrame) -> DataFrame:
    """recording_id, n, line: the text form of aligned series, ready to be written file by file.

    ``aligned`` has recording_id, name, unit, slot, value; ``lattice`` recording_id, name, t0_ns, period_ns;
    ``header`` recording_id, q_ns, dur_ns. Numbers are those of ``number_text``, missing ones null.
    """
    ship(aligned.sparkSession)
    told = aligned.withColumn("_text", number_text(F.col("value")))
    held = told.groupBy("recording_id", "name", "unit").agg(F.array_sort(F.collect_list(F.struct("slot", "_text"))).alias("s")).join(lattice.withColumn("_hz", number_text(1e9 / F.col("period_ns"))), ["recording_id", "name"])
    values = F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["_text"]), ","), F.lit("]"))
    quote = lambda c: F.to_json(F.struct(F.col(c).alias("x")))
    bare = lambda c: F.regexp_extract(quote(c), r'^\{"x":(.*)\}$', 1)
    line = F.concat(F.lit('{"n":'), bare("name"), F.when(F.col("unit") != "", F.concat(F.lit(',"u":'), bare("unit"))).otherwise(""), F.lit(',"hz":'), "_hz", F.when(F.col("t0_ns") != 0, F.concat(F.lit(',"t0":'), F.col("t0_ns").cast("string"))).otherwise(""), F.lit(',"v":'), values, F.lit("}"))
    body = held.select("recording_id", (F.lit(2) + F.row_number().over(Window.partitionBy("recording_id").orderBy("name"))).alias("n"), line.alias("line"))
    first = header.select("recording_id", F.lit(1).alias("n"), F.to_json(F.struct(F.lit(1).alias("mtj"), F.col("q_ns").alias("q"), F.col("dur_ns").alias("dur"))).alias("line"))
    tuples = F.transform(F.array_sort(F.collect_list(F.struct("start_ns", "number", "end_ns", "complete"))), lambda x: F.format_string("[%d,%d,%d,%d]", x["number"], x["start_ns"], x["end_ns"], x["complete"].cast("int")))
    told = laps.groupBy("recording_id").agg(F.array_join(tuples, ",").alias("t"))
    second = header.join(told, "recording_id", "left").select("recording_id", F.lit(2).alias("n"), F.concat(F.lit("["), F.coalesce("t", F.lit("")), F.lit("]")).alias("line"))
    return first.unionByName(second).unionByName(body)


def write(lines: DataFrame, path: str, compression: str = "gzip") -> None:
    """One folder per recording with its lines in order; a recording is one task's work. Codecs are those of the cluster's Hadoop."""
    lines.repartition("recording_id").sortWithinPartitions("recording_id", "n").select("recording_id", F.col("line").alias("value")).write.partitionBy("recording_id").option("compression", compression).text(path)
