"""Grouped sidecars of spans and channels beside a recording: read, checked and written with JSON and variant functions.

Every line with ``mtx`` opens a group; spans and channels belong to the last group before them.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions import formats, timespan
from paddock.functions.clock import period_ns
from paddock.operators.lattice import snap_intervals, snap_up, valid_lattice
from paddock.session import materialize

VERSION = 1
#: Units of times in a span's values.
TIME_UNITS = ("timespan_ms", "laptime_ms", "racetime_ms")
#: Most code points of the texts of a sidecar, most entries of its lists.
LIMITS = {"name": 64, "unit": 24, "fmt": 16, "tz": 64, "label": 80, "title": 32, "sub": 48, "meta_name": 32, "meta_value": 48}
MOST = {"meta": 16, "labels": 256, "right": 8}
_HEADER = "mtx int, mtj int, n string, q bigint, dur bigint, o bigint, utc bigint, tz string, vis string, hash string, r array<struct<t:string,p:array<string>>>, vo string, vf string, vpts string"
_SPAN = "n string, s bigint, e bigint, vis string, c string, p struct<title:string,sub:string>"
_CHANNEL = "n string, u string, hz double, t0 bigint, v array<double>, vis string"
_BY = ["recording_id", "group"]


def shown(vis: Column) -> Column:
    """A visibility flag: 1, 0, true or false; null otherwise."""
    return F.when(vis.isin("1", "true"), True).when(vis.isin("0", "false"), False)


def meta_values(line: Column) -> Column:
    """Array of name, text, ms, problem: the typed values of a span's ``m``.

    Whole numbers and objects of a time unit are milliseconds, so are texts that write a race time; other
    texts stay texts.
    """

    get = F.try_variant_get

    # a step a transform: what a step names is worked out once, where a lambda would repeat it at every mention
    def split(entry: Column) -> Column:
        return F.struct(F.coalesce(F.schema_of_variant(get(entry, "$[0]", "variant")), F.lit("")).alias("named"), get(entry, "$[0]", "string").alias("name"), get(entry, "$[1]", "variant").alias("value"))

    def kinds(x: Column) -> Column:
        return F.struct(x["named"].alias("named"), x["name"].alias("name"), x["value"].alias("value"), F.schema_of_variant(x["value"]).alias("kind"), F.schema_of_variant(get(x["value"], "$.v", "variant")).alias("inner"))

    def values(x: Column) -> Column:
        v, kind, inner = x["value"], x["kind"], x["inner"]
        typed = kind.startswith("OBJECT")
        text = F.when(kind == "STRING", get(v, "$", "string"))
        told = F.when(inner == "STRING", get(v, "$.v", "string"))
        number = F.when(kind == "BIGINT", get(v, "$", "bigint")).when(inner == "BIGINT", get(v, "$.v", "bigint"))
        unit_bad = F.when(typed, ~F.coalesce(F.lower(get(v, "$.u", "string")).isin(*TIME_UNITS), F.lit(False)))
        return F.struct(x["named"].alias("named"), x["name"].alias("name"), text.alias("text"), told.alias("told"), number.alias("number"), unit_bad.alias("unit_bad"))

    def timed(x: Column) -> Column:
        number = x["number"]
        ms = F.when(timespan.in_range(number), number).otherwise(timespan.parse_ms(F.coalesce(x["text"], x["told"])).cast("long"))
        return F.struct(x["named"].alias("named"), x["name"].alias("name"), x["text"].alias("text"), number.alias("number"), x["unit_bad"].alias("unit_bad"), ms.alias("ms"))

    def judged(x: Column) -> Column:
        problem = (
            F.when(x["named"] != "STRING", "meta_name").when(x["unit_bad"], "meta_unit").when(x["number"].isNotNull() & ~timespan.in_range(x["number"]), "meta_range")
            .when(x["ms"].isNull() & x["text"].isNull(), "meta_value")
        )
        return F.struct(x["name"].alias("name"), F.when(x["ms"].isNull(), x["text"]).alias("text"), x["ms"].alias("ms"), problem.alias("problem"))

    found = F.coalesce(get(F.try_parse_json(line), "$.m", "array<variant>"), F.array().cast("array<variant>"))
    for step in (split, kinds, values, timed, judged):
        found = F.transform(found, step)
    return found


def span_rows(body: DataFrame, by: list[str], vis_required: bool) -> DataFrame:
    """The spans among ``body`` (by, n, line, q_ns), each with its first problem: bounds, lattice, colour, visibility, values.

    Where a flag isn't required, a span without one is visible; a flag that is there must be one.
    """
    held = body.where(F.get_json_object("line", "$.k") == "s").select(*by, "n", "q_ns", "line", F.from_json("line", _SPAN).alias("x"), meta_values(F.col("line")).alias("meta"))
    s, e, c = F.col("x.s"), F.col("x.e"), F.coalesce("x.c", F.lit(""))
    flag = shown(F.col("x.vis") if vis_required else F.coalesce("x.vis", F.lit("1")))
    no_list = ~F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json("line"), "$.m", "variant")), F.lit("ARRAY")).startswith("ARRAY")
    return held.select(
        *by, "n", F.coalesce("x.n", F.lit("")).alias("name"), s.alias("start_ns"), e.alias("end_ns"), flag.alias("visible"), c.alias("color"), F.coalesce("x.p.title", F.lit("")).alias("title"), F.coalesce("x.p.sub", F.lit("")).alias("subtitle"),
        F.transform("meta", lambda m: F.struct(m["name"].alias("name"), m["text"].alias("text"), m["ms"].alias("ms"))).alias("meta"),
        F.when(s.isNull() | e.isNull() | (e <= s), "span_bounds").when((s % F.col("q_ns") != 0) | (e % F.col("q_ns") != 0), "span_lattice").when((c != "") & ~formats.colour(c), "colour").when(flag.isNull(), "span_vis").when(no_list, "meta")
        .otherwise(F.get(F.filter(F.transform("meta", lambda m: m["problem"]), lambda p: p.isNotNull()), F.lit(0))).alias("problem"),
    )


def not_json(body: DataFrame, by: list[str]) -> DataFrame:
    """Lines that aren't JSON objects, as problems."""
    return body.where(~F.coalesce(F.schema_of_variant(F.try_parse_json("line")), F.lit("")).startswith("OBJECT")).select(*by, F.lit("json").alias("problem"))


def display(line: Column) -> Column:
    """Struct plot, low, high, decimals, format, problem: how a channel's line wants to be shown; a trace without one."""
    d = F.from_json(line, "plt string, sc array<double>, rnd double, fmt string")
    low, high, fmt = F.get(d["sc"], F.lit(0)), F.get(d["sc"], F.lit(1)), F.coalesce(d["fmt"], F.lit(""))
    plot = F.when(F.coalesce(d["plt"], F.lit("")) == "", "trace").otherwise(formats.plot(d["plt"]))
    problem = (
        F.when(plot.isNull(), "plt").when(F.get_json_object(line, "$.sc").isNotNull() & (d["sc"].isNull() | (F.size(d["sc"]) == 0)), "sc").when(low >= high, "sc")
        .when((d["rnd"] < 0) | (d["rnd"] > 15) | (d["rnd"] != F.floor(d["rnd"])), "rnd").when(fmt.rlike(r"\s") | (F.length(fmt) > LIMITS["fmt"]), "fmt")
    )
    return F.struct(plot.alias("plot"), low.alias("low"), high.alias("high"), d["rnd"].cast("int").alias("decimals"), fmt.alias("format"), problem.alias("problem"))


def labels(line: Column, origin: Column, quantum: Column) -> Column:
    """Struct labels (t_ns, text) and problem: in rising time, on the lattice, with texts, and on traces alone."""
    rows = F.from_json(line, "plt string, lbl array<array<string>>")
    held = F.transform(F.coalesce(rows["lbl"], F.array().cast("array<array<string>>")), lambda r: F.struct(F.get(r, F.lit(0)).try_cast("bigint").alias("t_ns"), F.get(r, F.lit(1)).alias("text")))
    wrong = lambda x, i: x["t_ns"].isNull() | (x["t_ns"] < origin) | (x["t_ns"] % quantum != 0) | (F.coalesce(x["text"], F.lit("")) == "") | F.coalesce(x["t_ns"] <= F.get(held, i - 1)["t_ns"], F.lit(False))
    trace = F.coalesce(rows["plt"], F.lit("")).isin("", "trace", "t")
    problem = F.when(F.get_json_object(line, "$.lbl").isNotNull() & rows["lbl"].isNull(), "labels").when((F.size(held) > 0) & ~trace, "labels_without_trace").when(F.exists(F.transform(held, wrong), lambda x: x), "label")
    return F.struct(held.alias("labels"), problem.alias("problem"))


def video_links(line: Column) -> Column:
    """Struct offset_ns, files, pts_ns, problem: the video linkage of a recording's header."""
    h = F.from_json(line, "vo string, vf array<struct<n:string,i:bigint,fc:bigint,b3:string,po:bigint>>, vpts array<string>")
    has = lambda k: F.get_json_object(line, f"$.{k}").isNotNull()
    pts = F.transform(h["vpts"], lambda x: x.try_cast("bigint"))
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(pts) - 1, F.lit(1))), lambda i: F.coalesce(F.get(pts, i) < F.get(pts, i - 1), F.lit(False)))
    bad_file = F.exists(h["vf"], lambda f: (F.coalesce(f["n"], F.lit("")) == "") | f["i"].isNull() | (f["i"] < 0) | (f["b3"].isNotNull() & formats.digest(f["b3"]).isNull()))
    problem = (
        F.when(has("vo") & h["vo"].try_cast("bigint").isNull(), "vo").when(has("vf") & (h["vf"].isNull() | (F.size(h["vf"]) == 0) | bad_file), "vf")
        .when(has("vpts") & ~has("vf"), "vpts_without_vf").when(has("vpts") & (pts.isNull() | (F.size(pts) == 0) | F.exists(pts, lambda x: x.isNull() | (x < 0)) | falls), "vpts")
    )
    return F.struct(h["vo"].try_cast("bigint").alias("offset_ns"), h["vf"].alias("files"), pts.alias("pts_ns"), problem.alias("problem"))


def passes(line: Column) -> Column:
    """Array of name, version, params: the passes that a recording's header says were applied."""
    return F.transform(F.from_json(line, "passes array<struct<n:string,v:bigint,p:map<string,string>>>")["passes"], lambda p: F.struct(p["n"].alias("name"), p["v"].alias("version"), p["p"].alias("params")))


def parse(lines: DataFrame) -> dict[str, DataFrame]:
    """groups, spans, channels, samples and problems of ``lines`` (recording_id, n, line).

    A recording with a problem has no other rows. Problems name a group (0-based; -1 for lines before the
    first header) and what is wrong: version, name, lattice, utc, tz, vis, right, hash, video; span_bounds,
    span_lattice, colour, span_vis, meta*; json; channel_name, channel_values, channel_vis, beyond_duration, duplicate_name, period_off_lattice, t0_off_lattice, plt, sc,
    rnd, fmt, label*; no_header.
    """
    w = Window.partitionBy("recording_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.get_json_object("line", "$.mtx").isNotNull()
    # lines are ordered and classed once; each has the lattice of the header before it with it
    h = F.from_json("line", "q bigint, dur bigint, o bigint")
    lattice = F.last(F.when(F.col("opens"), F.struct(h["q"].alias("q_ns"), F.coalesce(h["o"], F.lit(0).cast("long")).alias("origin_ns"), h["dur"].alias("duration_ns"))), True).over(w)
    told = lines.where("recording_id is not null").select("recording_id", "n", "line", opens.alias("opens"), F.coalesce(F.get_json_object("line", "$.k") == "s", F.lit(False)).alias("is_span"), F.schema_of_variant(F.try_parse_json("line")).alias("kind"))
    told = materialize(told.withColumns({"group": (F.sum(F.col("opens").cast("int")).over(w) - 1).cast("int"), "h": lattice}).select("recording_id", "n", "line", "opens", "is_span", "kind", "group", "h.*"))
    head = told.where("opens").select("recording_id", "group", F.from_json("line", _HEADER).alias("h")).select("recording_id", "group", "h.*").withColumn("o", F.coalesce("o", F.lit(0).cast("long")))
    zones = sorted(zoneinfo.available_timezones())
    good_right = F.coalesce(F.forall("r", lambda x: x["t"].isNotNull() | (F.size(x["p"]) >= 2)), F.lit(True))
    groups = head.select(
        *_BY, F.col("n").alias("name"), F.col("q").alias("q_ns"), F.col("dur").alias("duration_ns"), F.col("o").alias("origin_ns"), F.col("utc").alias("utc_start_ns"), F.col("tz").alias("timezone"), shown(F.col("vis")).alias("visible"), F.col("r").alias("right"),
        F.when(F.col("mtj").isNotNull() | (F.coalesce("mtx", F.lit(-1)) != VERSION), "version").when(F.coalesce("n", F.lit("")) == "", "name").when(~F.coalesce(valid_lattice(F.col("q"), F.col("dur"), F.col("o")), F.lit(False)), "lattice")
        .when(F.coalesce("utc", F.lit(0)) <= 0, "utc").when(~F.coalesce(F.col("tz").isin(*zones) if zones else F.col("tz") != "", F.lit(False)), "tz").when(shown(F.col("vis")).isNull(), "vis").when(~good_right, "right")
        .when(formats.schema_hash(F.coalesce("hash", F.lit("")))["error"].isNotNull(), "hash").when(F.coalesce("vo", "vf", "vpts").isNotNull(), "video").alias("problem"),
    )
    body = told.where(~F.col("opens"))
    stray = body.where("group < 0").select("recording_id", "group", F.lit("no_header").alias("problem"))
    body = body.where("group >= 0")
    spans = span_rows(body.where("is_span"), _BY, True)
    rows = body.where("not is_span and kind is not null").select(*_BY, "n", "line", "q_ns", "origin_ns", "duration_ns", F.from_json("line", _CHANNEL).alias("x"), display(F.col("line")).alias("display"), labels(F.col("line"), F.col("origin_ns"), F.col("q_ns")).alias("lbl"))
    t0, period = F.coalesce("x.t0", "origin_ns"), period_ns(F.col("x.hz"))
    twice = F.count(F.lit(1)).over(Window.partitionBy(*_BY, "x.n")) > 1
    checked = rows.select(
        *_BY, (F.row_number().over(Window.partitionBy(*_BY).orderBy("n")) - 1).alias("channel_idx"), F.col("x.n").alias("name"), F.coalesce("x.u", F.lit("")).alias("unit"), t0.alias("t0_ns"), period.alias("period_ns"), F.col("x.v").alias("v"), shown(F.col("x.vis")).alias("visible"), "display", F.col("lbl.labels").alias("labels"),
        F.when(F.coalesce("x.n", F.lit("")) == "", "channel_name").when(twice, "duplicate_name").when(period.isNull() | (period % F.col("q_ns") != 0), "period_off_lattice").when((t0 < F.col("origin_ns")) | ((t0 - F.col("origin_ns")) % F.col("q_ns") != 0), "t0_off_lattice")
        .when(F.col("x.v").isNull(), "channel_values").when(t0 + F.size("x.v") * period > F.col("duration_ns") + period, "beyond_duration").when(shown(F.col("x.vis")).isNull(), "channel_vis")
        .otherwise(F.coalesce("display.problem", "lbl.problem")).alias("problem"),
    )
    # every table below is filtered by the problems of all, so each is worked out once
    groups, spans, checked = materialize(groups), materialize(spans), materialize(checked)
    told_problems = [groups.select(*_BY, "problem"), stray, body.where(~F.coalesce(F.col("kind"), F.lit("")).startswith("OBJECT")).select(*_BY, F.lit("json").alias("problem")), spans.select(*_BY, "problem"), checked.select(*_BY, "problem")]
    problems = told_problems[0]
    for p in told_problems[1:]:
        problems = problems.unionByName(p)
    problems = materialize(problems.where("problem is not null").distinct())
    bad = problems.select("recording_id").distinct()
    good = lambda df: df.join(bad, "recording_id", "left_anti").drop("problem")
    channels = good(checked)
    samples = channels.select(*_BY, "channel_idx", "t0_ns", "period_ns", F.posexplode("v").alias("i", "x")).select(*_BY, "channel_idx", F.col("i").cast("long").alias("local_idx"), (F.col("t0_ns") + F.col("i") * F.col("period_ns")).alias("t_ns"), F.coalesce("x", F.lit(float("nan"))).alias("value"))
    return {"groups": good(groups), "spans": good(spans), "channels": channels.withColumn("sample_count", F.size("v").cast("long")).drop("v"), "samples": samples, "problems": problems}


def lint(parsed: dict[str, DataFrame]) -> DataFrame:
    """recording_id, group, code, place: texts and lists of a parsed sidecar beyond ``LIMITS`` and ``MOST``."""
    long = lambda c, k: F.when(F.length(c) > LIMITS[k], k)
    s = parsed["spans"].select(*_BY, F.col("name").alias("place"), F.array(
        long("name", "name"), long("title", "title"), long("subtitle", "sub"), F.when(F.size("meta") > MOST["meta"], "meta"),
        F.when(F.exists("meta", lambda m: F.length(m["name"]) > LIMITS["meta_name"]), "meta_name"), F.when(F.exists("meta", lambda m: F.coalesce(F.length(m["text"]) > LIMITS["meta_value"], F.lit(False))), "meta_value"),
    ).alias("codes"))
    c = parsed["channels"].select(*_BY, F.col("name").alias("place"), F.array(long("name", "name"), long("unit", "unit"), F.when(F.size("labels") > MOST["labels"], "labels"), F.when(F.exists("labels", lambda x: F.length(x["text"]) > LIMITS["label"]), "label")).alias("codes"))
    g = parsed["groups"].select(*_BY, F.col("name").alias("place"), F.array(long("name", "name"), long("timezone", "tz"), F.when(F.size("right") > MOST["right"], "right")).alias("codes"))
    return s.unionByName(c).unionByName(g).select(*_BY, "place", F.explode("codes").alias("code")).where("code is not null")


def to_lines(groups: DataFrame, spans: DataFrame) -> DataFrame:
    """recording_id, n, line: the text form of groups (recording_id, group, name, q_ns, duration_ns, utc_start_ns, timezone, visible) and their spans.

    Spans are snapped onto the lattice, at least one quantum long, and written by start, end and name; a group lasts at least to
    its last span. Times are written with their unit. Refuses nothing: ``parse`` tells what is wrong.
    """
    snapped = snap_intervals(spans.join(groups.select(*_BY, "q_ns"), _BY), F.col("q_ns"))
    text = lambda c: F.when(c != "", c)
    flag = lambda c: c.cast("int").alias("vis")
    json = lambda *cols: F.to_json(F.struct(*cols))
    quoted = lambda c: F.regexp_extract(json(c.alias("x")), r'(?s)^\{"x":(.*)\}$', 1)
    value = lambda m: F.when(m["ms"].isNotNull(), json(m["ms"].alias("v"), F.lit(TIME_UNITS[0]).alias("u"))).otherwise(quoted(m["text"]))
    meta = F.when(F.size("meta") > 0, F.concat(F.lit(',"m":['), F.array_join(F.transform("meta", lambda m: F.concat(F.lit("["), quoted(m["name"]), F.lit(","), value(m), F.lit("]"))), ","), F.lit("]"))).otherwise("")
    primary = F.when((F.col("title") != "") | (F.col("subtitle") != ""), F.struct(text(F.col("title")).alias("title"), text(F.col("subtitle")).alias("sub")))
    start = json(F.lit("s").alias("k"), text(F.col("name")).alias("n"), F.col("start_ns").alias("s"), F.col("end_ns").alias("e"), flag(F.col("visible")), text(F.col("color")).alias("c"), primary.alias("p"))
    body = snapped.select(*_BY, "start_ns", "end_ns", "name", F.concat(F.substring(start, F.lit(1), F.length(start) - 1), meta, F.lit("}")).alias("line"))
    ends = snapped.groupBy(*_BY).agg(F.max("end_ns").alias("end"))
    lasting = snap_up(F.greatest(F.col("duration_ns"), F.coalesce("end", F.lit(0))), F.col("q_ns"))
    heads = groups.join(ends, _BY, "left").select(
        *_BY, F.lit(-1).cast("long").alias("start_ns"), F.lit(-1).cast("long").alias("end_ns"), F.lit("").alias("name"),
        json(F.lit(VERSION).alias("mtx"), F.col("q_ns").alias("q"), lasting.alias("dur"), F.col("name").alias("n"), F.col("utc_start_ns").alias("utc"), F.col("timezone").alias("tz"), flag(F.col("visible"))).alias("line"),
    )
    order = Window.partitionBy("recording_id").orderBy("group", "start_ns", "end_ns", "name", "line")
    return heads.unionByName(body).select("recording_id", F.row_number().over(order).alias("n"), "line")
