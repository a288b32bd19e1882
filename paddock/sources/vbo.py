"""Sectioned text logs: native parsing to channels and samples on one explicit clock per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.functions.names import normalize
from paddock.session import materialize, spread

# Units of the leading columns by short name, and how many columns are built in.
UNITS = {"time": "s", "tsample": "s", "lat": "min", "long": "min", "velocity": "km/h", "heading": "deg", "height": "m", "vert-vel": "m/s"}
BUILTIN = 12
_SECTIONS = ("header", "channel units", "column names", "data", "avi")
DEFAULT_PERIOD_NS = 100_000_000
#: Files whose lines are one task's work, at most.
FILES = 4_096


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, text of each file: UTF-8, or Latin-1 where the bytes aren't."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[vV][bB][oO]").option("recursiveFileLookup", "true").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(F.col("path").alias("recording_id"), text.alias("text"))


def _lines(files: DataFrame) -> DataFrame:
    """recording_id, n, line, section: trimmed lines with text, by the last heading before them."""
    raw = files.select("recording_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("n", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "\t", " ")))
    heading = F.when(F.col("line").rlike(r"^\[.*\]$"), F.lower(F.regexp_extract("line", r"^\[(.*)\]$", 1)))
    w = Window.partitionBy("recording_id").orderBy("n")
    held = raw.withColumn("_h", heading).withColumn("section", F.last("_h", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return held.where(F.col("_h").isNull() & (F.col("line") != "") & F.col("section").isin(*_SECTIONS)).select("recording_id", "n", "line", "section")


def seconds(raw: Column) -> Column:
    """Seconds of the day of HHMMSS.s."""
    return F.floor(raw / 10000) * 3600 + F.floor((raw % 10000) / 100) * 60 + raw % 100


def read(files: DataFrame) -> DataFrame:
    """recording_id, n, section, line, local_idx, s, elapsed, t_ns, step, tsample, values, bad: a row a line, in one pass over the texts.

    Rows of numbers have local_idx, their values by place, the places of ``bad`` tokens, and no line; all others their line.
    Rows of a file without a time column tell nothing but their line.
    """
    w, every = Window.partitionBy("recording_id").orderBy("n"), Window.partitionBy("recording_id")
    split = F.split("line", " +")
    told = lambda names: F.struct(names.alias("short"), F.transform(names, lambda x: normalize(x)).alias("norm"))
    lines = _lines(spread(files.select("recording_id", "text"), "recording_id", each=FILES)).withColumns({
        "t": F.when(F.col("section") == "data", split), "_named": F.when(F.col("section") == "column names", told(split)), "_head": F.when(F.col("section") == "header", F.struct("n", "line", normalize(F.col("line")).alias("norm"))),
    })
    heads = F.array_sort(F.collect_list("_head").over(every))
    listed = F.struct(F.transform(heads, lambda x: x["line"]).alias("short"), F.transform(heads, lambda x: x["norm"]).alias("norm"))
    lines = lines.withColumn("_names", F.coalesce(F.min_by("_named", F.when(F.col("_named").isNotNull(), F.col("n"))).over(every), listed))
    names, norm = F.col("_names.short"), F.col("_names.norm")
    place = F.array_position(norm, "time").cast("int") - 1
    lines = lines.withColumn("_row", F.coalesce((F.size("t") >= 2) & (place >= 0), F.lit(False)))
    lines = lines.withColumns({"local_idx": F.when(F.col("_row"), F.sum(F.col("_row").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1), "_places": F.when(F.col("_row"), F.sequence(F.lit(0), F.size(names) - 1))})
    lines = lines.withColumn("_numbers", F.transform("_places", lambda i: F.get("t", i).try_cast("double")))
    number = lambda i: F.get("_numbers", i)
    nan = F.lit(float("nan"))
    lines = lines.withColumn("s", F.when(F.col("_row"), seconds(F.coalesce(number(place), nan))))
    lines = lines.withColumn("_first", F.min_by("s", "local_idx").over(every))
    lines = lines.withColumn("elapsed", F.when(F.col("s") < F.col("_first") - 43200, F.col("s") + 86400).otherwise(F.col("s")) - F.col("_first"))
    lines = lines.withColumn("t_ns", F.when(F.col("_row"), F.greatest(F.lit(0).cast("long"), F.round(F.col("elapsed") * 1e9).try_cast("bigint"))))
    before = F.last("t_ns", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    periods = F.filter("_places", lambda i: (F.get(norm, i) == "tsample") & (number(i) > 0) & ~F.isnan(number(i)))
    values = F.transform("_places", lambda i: F.when(F.get(norm, i) == "time", F.col("elapsed")).otherwise(F.coalesce(number(i), nan)))
    return materialize(lines.select(
        "recording_id", "n", "section", F.when(~F.col("_row"), F.col("line")).alias("line"), "local_idx", "s", "elapsed", "t_ns", (F.col("t_ns") - before).alias("step"), number(F.get(periods, F.lit(0))).alias("tsample"), values.alias("values"),
        F.filter("_places", lambda i: number(i).isNull()).alias("bad"), (F.size("t") < 2).alias("short"),
    ))


def origin(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """recording_id, absolute_start_ns, date, time: the first row's time of the day, and the date and time of the line before the sections.

    ``rows`` are those of ``read``, if they are at hand.
    """
    first = (read(files) if rows is None else rows).where("local_idx = 0")
    started = first.select("recording_id", F.greatest(F.lit(0).cast("long"), F.round(F.col("s") * 1e9).try_cast("bigint")).alias("absolute_start_ns"))
    part = lambda i: F.regexp_extract("text", r"(?m)^\s*File created on (\S+)(?: (?:at|@) (\S+))?", i)
    return files.select("recording_id", part(1).alias("date"), part(2).alias("time")).join(started, "recording_id", "left")


def parse(files: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(channels, samples, diagnostics) of ``files`` (recording_id, text), or of their ``rows`` (``read``).

    Rows with fewer than two tokens are skipped, tokens that are no number become NaN, times that fall by
    more than half a day went past midnight. The period is the first positive sample time, else the first
    positive step, else a tenth of a second.
    """
    rows = read(files) if rows is None else rows
    at = F.struct("n", "line")
    listed = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, at))), lambda x: x["line"])
    heads = rows.where("section != 'data'").groupBy("recording_id").agg(
        F.split(F.min_by("line", F.when(F.col("section") == "column names", F.col("n"))), " +").alias("short"), listed("header").alias("header"), listed("channel units").alias("units")
    )
    names = heads.withColumn("short", F.coalesce("short", "header"))
    timed = rows.where("local_idx is not null")
    samples = timed.select("recording_id", F.posexplode("values").alias("channel_idx", "value"), F.lit(0).alias("chunk_idx"), "local_idx", "t_ns").select("recording_id", "channel_idx", "chunk_idx", "local_idx", "t_ns", "value")
    first = lambda c, when: F.min_by(c, F.when(when, F.col("local_idx")))
    period = timed.groupBy("recording_id").agg(first("step", F.col("step") > 0).alias("step"), F.max_by("t_ns", "local_idx").alias("last"), F.count(F.lit(1)).alias("rows"), first("tsample", F.col("tsample").isNotNull()).alias("tsample"))
    period = period.withColumn("period_ns", F.coalesce(F.round(F.col("tsample") * 1e9).cast("long"), "step", F.lit(DEFAULT_PERIOD_NS)))
    units = F.create_map(*[F.lit(x) for p in UNITS.items() for x in p])
    own = F.get("units", F.col("pos") - BUILTIN)
    unit = F.when(F.col("pos") < BUILTIN, F.coalesce(F.try_element_at(units, F.lower("short_name")), F.lit(""))).otherwise(F.coalesce(F.when(own != "(null)", own), F.lit("")))
    channels = (
        names.select("recording_id", "header", "units", F.posexplode("short").alias("pos", "short_name"))
        .join(period, "recording_id")
        .select(
            "recording_id", F.col("pos").alias("channel_idx"), F.col("pos").alias("id"), F.coalesce(F.get("header", F.col("pos")), "short_name").alias("name"), unit.alias("unit"),
            F.when(unit == "", "unknown").when(F.col("pos") < BUILTIN, "spec_default").otherwise("declared").alias("unit_source"), F.lit("f64").alias("sample_type"), F.col("rows").alias("sample_count"), (F.col("last") + F.col("period_ns")).alias("duration_ns"), "period_ns",
        )
    )
    bad = timed.where(F.size("bad") > 0).select("recording_id", F.explode("bad").alias("pos")).join(names.select("recording_id", "short"), "recording_id").select("recording_id", F.get("short", F.col("pos")).alias("name"))
    unparsable = bad.groupBy("recording_id", "name").agg(F.count(F.lit(1)).alias("n")).select("recording_id", F.lit("warning").alias("severity"), F.lit("vbo.value_unparsable").alias("code"), F.col("name").alias("channel"), F.format_string("%d numeric token(s) failed to parse and became NaN", "n").alias("message"))
    short_rows = rows.where("short").groupBy("recording_id").agg(F.count(F.lit(1)).alias("n")).select("recording_id", F.lit("warning").alias("severity"), F.lit("vbo.row_too_few_tokens").alias("code"), F.lit(None).cast("string").alias("channel"), F.format_string("%d data row(s) skipped", "n").alias("message"))
    return channels, samples, unparsable.unionByName(short_rows)


def videos(files: DataFrame, samples: DataFrame, channels: DataFrame) -> DataFrame:
    """recording_id, files: names of the linked videos."""
    from paddock.operators.video import linked_files

    lines = _lines(files).where("section = 'avi'").groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("avi"))
    index = channels.where(normalize(F.col("name")) == "avifileindex").select("recording_id", "channel_idx")
    seen = samples.join(index, ["recording_id", "channel_idx"]).where("value >= 0").groupBy("recording_id").agg(F.collect_set(F.round("value").cast("long")).alias("indices"))
    met = files.select("recording_id").join(lines, "recording_id", "left").join(seen, "recording_id", "left")
    return met.select("recording_id", linked_files(F.coalesce(F.get("avi", F.lit(0)), F.lit("")), F.get("avi", F.lit(1)), F.coalesce("indices", F.array().cast("array<bigint>"))).alias("files"))
