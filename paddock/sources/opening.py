"""Opening a folder of recordings of any kind as one set of tables, and what can be told of them without all samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.names import ROLES, normalize
from paddock.operators import recovery, report, validate
from paddock.session import materialize
from paddock.sources import aimd, camera, globs, jsonl, ld, ldx, pds, sidecar, vbo

#: Channels that a text log keeps in metadata mode, in normal form.
METADATA_CHANNELS = (
    "time", "tsample", "latitude", "longitude", "lat", "long", "lon", "driver", "driverid", "driverindex", "lap", "lapnumber", "lapcount", "lapcounter", "currentlaptime", "laptime", "laptimerunning",
    "previouslt", "previouslaptime", "lastlaptime", "reflaptime", "referencelaptime", "avifileindex", "avisynctime", "avitime", "cartype", "vehicletype", "vehiclemodel", "carmodel",
    "carnumber", "vehiclenumber", "racenumber", "competitionnumber", "carclass", "vehicleclass", "classid", "competitionclass",
)
#: The roles whose channels a searched log keeps in metadata mode, beside those.
METADATA_ROLES = ("lap_number", "lap_timer", "reference_lap", "driver", "gps_week", "gps_itow", "unix_time")
#: Kinds of files that are told but not read.
UNREAD = ("telemetry",)
_CHANNEL = ("recording_id", "channel_idx", "name", "unit", "unit_source", "sample_type", "sample_count", "duration_ns")
_SAMPLE = ("recording_id", "channel_idx", "local_idx", "t_ns", "value")
_LAP = ("recording_id", "number", "start_ns", "end_ns", "duration_ns", "complete")
_DIAGNOSTIC = ("recording_id", "severity", "code", "channel", "message")


def _told(df: DataFrame, code) -> DataFrame:
    """Diagnostics of a column that says what is wrong."""
    return df.select("recording_id", F.lit("error").alias("severity"), code.alias("code"), F.lit(None).cast("string").alias("channel"), code.alias("message")).where(code.isNotNull())


def _text_logs(files: DataFrame, metadata: bool) -> dict[str, DataFrame]:
    # text is split once; channels, laps, clocks and summaries start from its rows
    rows = vbo.read(files)
    channels, samples, diagnostics = vbo.parse(files, rows)
    channels = materialize(channels)
    if metadata:
        channels = channels.where(normalize(F.col("name")).isin(*METADATA_CHANNELS))
        samples = materialize(samples.join(channels.select("recording_id", "channel_idx"), ["recording_id", "channel_idx"], "left_semi"))
    clock = {"clock": F.lit("time_of_day"), "session_hint": F.lit("vbo:time_of_day")}
    return {"channels": channels, "samples": samples, "diagnostics": diagnostics, "origins": _origins(vbo.origin(files, rows), clock)}


def _origins(told: DataFrame, more: dict) -> DataFrame:
    """``told`` with the columns of ``recovery.ORIGIN``, null where neither it nor ``more`` has them."""
    named = told.withColumns(more)
    return named.select(*[(F.col(c) if c in named.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (x.split() for x in recovery.ORIGIN.split(", "))])


def _block_logs(raw: DataFrame, metadata: bool) -> dict[str, DataFrame]:
    channels = ld.channels(raw)
    hint = F.concat_ws(":", F.lit("motec"), F.lower("date"), F.lower("vehicle"), F.lower("venue"))
    clock = {"clock": F.when(F.col("absolute_start_ns").isNotNull(), "utc"), "session_hint": hint}
    return {"channels": channels.where("name != ''"), "samples": ld.samples(raw), "diagnostics": _told(channels, F.col("problem")), "origins": _origins(ld.identity(raw), clock)}


def _marked(sidecars: DataFrame, channels: DataFrame) -> dict[str, DataFrame]:
    """Laps of the lap sidecars (recording_id of their log, text) that have a marker, and the fastest that they declare."""
    ends = channels.groupBy("recording_id").agg(F.max("duration_ns").alias("duration_ns"))
    parsed = ldx.parse(sidecars)
    laps = ldx.to_laps(parsed.where(F.size("markers") > 0), ends)
    best = parsed.where("fastest_ns is not null").select("recording_id", F.col("fastest_lap").alias("number"), "fastest_ns")
    bad = parsed.where("bad_markers > 0").select("recording_id", F.lit("warning").alias("severity"), F.lit("ldx.marker_skipped").alias("code"), F.lit(None).cast("string").alias("channel"), F.format_string("%d marker(s) without a time", "bad_markers").alias("message"))
    # a declared fastest lap has replaced its own, so it is found by number and length
    named = laps.join(best, ["recording_id", "number"]).where("duration_ns = fastest_ns")
    return {"laps": laps, "fastest": named, "diagnostics": bad}


def _searched_logs(raw: DataFrame, metadata: bool) -> dict[str, DataFrame]:
    """Only the chunks of the channels that are asked for are read."""
    found = pds.tables(materialize(pds.heads(raw)))
    kept = {*METADATA_CHANNELS, *(n for r in METADATA_ROLES for n in ROLES[r])}
    chunks = found["chunks"].where(normalize(F.col("name")).isin(*sorted(kept))) if metadata else found["chunks"]
    return found | {"samples": pds.samples(chunks, raw if "content" in raw.columns else None)}


def _films(raw: DataFrame, metadata: bool) -> dict[str, DataFrame]:
    # one pass over the bytes: clocks, counts and laps all start from its rows
    rows = materialize(raw if "kind" in raw.columns else camera.scan(raw))
    samples, told = materialize(camera.samples(rows, metadata)), camera.channels(rows)
    seen = samples.groupBy("recording_id", "channel_idx").agg(F.count(F.lit(1)).alias("sample_count"), F.max("t_ns").alias("last"))
    period = aimd.fit_chunks(samples).where("chunk_idx = 0").select("recording_id", "channel_idx", "sample_period_ns")
    units = F.create_map(*[F.lit(x) for name, unit, _, _ in aimd.FIX_CHANNELS for x in (name, unit)])
    unit = F.coalesce(F.element_at(units, F.col("name")), F.lit(""))
    by = ["recording_id", "channel_idx"]
    channels = told.where("name != ''").join(seen.hint("merge"), by, "left").join(period.hint("merge"), by, "left").withColumns({
        "unit": unit, "unit_source": F.when(unit == "", "unknown").otherwise("declared"), "sample_count": F.coalesce("sample_count", F.lit(0).cast("long")), "duration_ns": F.coalesce(F.col("last") + F.col("sample_period_ns"), F.lit(0).cast("long")),
    })
    return {"channels": channels, "samples": samples, "diagnostics": camera.diagnostics(rows)}


def _lined(lines: DataFrame, metadata: bool) -> dict[str, DataFrame]:
    """Declared laps are all there are; of equally short ones the first is the fastest."""
    found = jsonl.parse(lines)
    best = found["laps"].where("complete").groupBy("recording_id").agg(F.min_by(F.struct(*_LAP[1:]), F.struct("duration_ns", "start_ns")).alias("l")).select("recording_id", "l.*")
    start = F.when((F.coalesce("clk", F.lit("")) != "") & F.col("abs").isNotNull(), F.col("abs"))
    told = {
        "clock": F.when(start.isNotNull(), F.col("clk")), "absolute_start_ns": start, "absolute_end_ns": F.when(start.isNotNull(), F.coalesce("abe", start + F.col("dur"))), "session_hint": F.coalesce("hint", F.lit("")), "utc_start_ns": F.col("utc"), "timezone": F.col("tz"),
        "driver": F.col("drv"), "vehicle": F.col("veh"), "venue": F.col("ven"), "event": F.col("evt"), "session": F.col("ses"),
    }
    return {
        "channels": found["channels"], "samples": found["samples"], "laps": found["laps"], "fastest": best, "spans": found["spans"].withColumn("group", F.lit(0)), "diagnostics": _told(found["problems"], F.col("problem")),
        "closed": found["recordings"].select("recording_id"), "origins": _origins(found["recordings"], told),
    }


def _grouped(lines: DataFrame, metadata: bool) -> dict[str, DataFrame]:
    """Channels of all groups, numbered through in order of group."""
    found = sidecar.parse(lines)
    number = F.row_number().over(sidecar.Window.partitionBy("recording_id").orderBy("group", "channel_idx")) - 1
    numbered = found["channels"].withColumn("of", F.col("channel_idx")).withColumn("channel_idx", number).withColumns({
        "unit_source": F.when(F.col("unit") == "", "unknown").otherwise("declared"), "sample_type": F.lit("f64"), "duration_ns": F.col("t0_ns") + F.col("sample_count") * F.col("period_ns"),
    })
    samples = found["samples"].withColumnRenamed("channel_idx", "of").join(numbered.select("recording_id", "group", "of", "channel_idx"), ["recording_id", "group", "of"])
    first = found["groups"].where("`group` = 0")
    return {
        "channels": numbered, "samples": samples, "spans": found["spans"], "diagnostics": _told(found["problems"], F.col("problem")),
        "closed": first.select("recording_id"), "origins": _origins(first.select("recording_id", "utc_start_ns", "timezone"), {}),
    }


def tables(inputs: dict[str, DataFrame], metadata: bool = False) -> dict[str, DataFrame]:
    """channels, samples, laps, fastest, spans, origins and diagnostics of files by kind.

    ``inputs`` maps a kind of ``globs.kind`` to its raw rows: recording_id with text (vbo), content (motec,
    aimd, pds; pds also takes paths alone, aimd rows of ``camera``) or n and line (plain, ext); ``ldx`` has the text of lap
    sidecars under the recording_id of their log. With ``metadata`` the formats with bulk samples keep what laps and
    identities need. Laps are those of ``recovery.recover``, with their origin.
    """
    readers = {"vbo": _text_logs, "motec": _block_logs, "pds": _searched_logs, "aimd": _films, "plain": _lined, "ext": _grouped}
    read = [readers[k](raw, metadata) for k, raw in inputs.items() if k != "ldx"]
    if not read:
        raise ValueError("no kind of file to read")
    spark = read[0]["channels"].sparkSession
    each = lambda key, cols: reduce(DataFrame.unionByName, [r[key].select(*cols) for r in read if key in r])
    joined = lambda key, cols, schema: each(key, cols) if any(key in r for r in read) else spark.createDataFrame([], schema)
    # a row a channel and a row a lap: written once, as every step below starts from them
    channels, samples = materialize(each("channels", _CHANNEL)), each("samples", _SAMPLE)
    if "ldx" in inputs:
        read.append(_marked(inputs["ldx"], channels))
    lap = "recording_id string, number bigint, start_ns bigint, end_ns bigint, duration_ns bigint, complete boolean"
    declared, best, closed = (materialize(df) for df in (joined("laps", _LAP, lap), joined("fastest", _LAP, lap), joined("closed", ["recording_id"], "recording_id string")))
    laps = materialize(recovery.recover(channels, samples, declared, closed))
    spans = [reduce(DataFrame.unionByName, [r["spans"].drop("n") for r in read if "spans" in r])] if any("spans" in r for r in read) else []
    return {
        "channels": channels, "samples": samples, "laps": laps, "fastest": recovery.fastest(laps, channels, samples, best), "diagnostics": each("diagnostics", _DIAGNOSTIC),
        "origins": joined("origins", [x.split()[0] for x in recovery.ORIGIN.split(", ")], recovery.ORIGIN), "spans": spans[0] if spans else spark.createDataFrame([], "recording_id string, `group` int, name string, start_ns bigint, end_ns bigint"),
    }


def open_folder(spark: SparkSession, folder: str, masks: list[str] | None = None, metadata: bool = False) -> dict[str, DataFrame]:
    """``tables`` of the recordings under a folder, with ``recordings`` (recording_id, format, read).

    A file's suffix tells its format; each reader lists its own suffix and reads no other file. Formats
    without a reader are listed with read false.
    """
    names = globs.scan(spark, folder, masks).select(F.col("path").alias("recording_id"), F.col("kind").alias("format"))
    kinds = {r["format"] for r in names.select("format").distinct().collect()}
    lines = jsonl.read_lines(spark, folder)
    line_kind = globs.kind(F.col("recording_id"))
    raw = {
        "vbo": lambda: vbo.read_text(spark, folder), "motec": lambda: ld.files(spark, folder), "aimd": lambda: camera.read(spark, folder), "pds": lambda: pds.files(spark, folder),
        "plain": lambda: lines.where(line_kind.isin("plain", "zstd")), "ext": lambda: lines.where(line_kind.isin("ext", "ext_zstd")),
    }
    wanted = {"plain" if k == "zstd" else "ext" if k == "ext_zstd" else k for k in kinds} & raw.keys()
    masked = lambda df: df.where(globs.matches(F.regexp_replace("recording_id", r"^\w+:/*", "/"), masks or []))
    inputs = {k: masked(raw[k]()) for k in sorted(wanted)}
    if "motec" in inputs:
        # a sidecar lies beside its log under the same name
        stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\w+:/*", "/"), r"(?i)\.ldx?$", "")
        beside = ldx.read_text(spark, folder).select(stem(F.col("recording_id")).alias("_stem"), "text").groupBy("_stem").agg(F.min("text").alias("text"))
        logs = names.where("format = 'motec'").select("recording_id", stem(F.col("recording_id")).alias("_stem"))
        inputs["ldx"] = masked(logs.join(beside, "_stem").select("recording_id", "text"))
    found = tables(inputs, metadata)
    return {"recordings": names.withColumn("read", ~F.col("format").isin(*UNREAD))} | found


def lap_metadata(opened: dict[str, DataFrame]) -> DataFrame:
    """recording_id, laps, valid_laps: all recovered laps and those that are complete flying laps."""
    counted = opened["laps"].groupBy("recording_id").agg(F.count(F.lit(1)).alias("laps"))
    valid = report.valid_laps(opened["laps"], ["recording_id"])
    has = opened["channels"].select("recording_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return has.join(counted, "recording_id", "left").join(valid, "recording_id", "left").select("recording_id", zero("laps"), zero("valid_laps"))


def file_metadata(opened: dict[str, DataFrame], venues: DataFrame | None = None) -> DataFrame:
    """One row of facts a recording (``recovery.facts``), with its format where the folder was listed."""
    told = recovery.facts(opened, venues)
    return told.join(opened["recordings"].select("recording_id", "format"), "recording_id", "left") if "recordings" in opened else told


def verify(opened: dict[str, DataFrame], budget: int = 1) -> DataFrame:
    """recording_id, channels, laps, spans, problems, fault: one probe a channel, the readers' diagnostics and the plausibility checks."""
    by = ["recording_id"]
    steps = opened["channels"].withColumn("steps", F.lit(False)).withColumn("id", F.col("channel_idx"))
    checked = validate.check_values(opened["samples"].withColumn("chunk_idx", F.lit(0)), steps, budget)
    odd = checked.groupBy(*by).agg(F.count_if((F.col("nonfinite") > 0) | (F.col("absurd") > 0) | (F.col("out_of_band") > 0)).alias("odd"))
    wide = validate.widespread(checked).select("recording_id", "widespread")
    count = lambda df, c: df.groupBy(*by).agg(F.count(F.lit(1)).alias(c))
    base = opened["channels"].select("recording_id").union(opened["diagnostics"].select("recording_id")).distinct()
    for df in (count(opened["channels"], "channels"), count(opened["laps"], "laps"), count(opened["spans"], "spans"), count(opened["diagnostics"], "told"), odd, wide, validate.decode_fault(opened["diagnostics"])):
        base = base.join(df, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    fault = F.coalesce("fault", F.lit(False)) | F.coalesce("widespread", F.lit(False))
    return base.select("recording_id", *[zero(c).alias(c) for c in ("channels", "laps", "spans")], (zero("told") + zero("odd")).alias("problems"), fault.alias("fault"))
