"""Registered queries of reports, dates and small formats, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions import dates, formats
from paddock.operators import report, summary
from paddock.plans import views
from paddock.plans.queries import _BY, _COUNTER_SQL, _HAV_SQL, _REACH, _TRACKS_SQL, _counter, _tracks, query
from paddock.plans.views import SAMPLES_SQL, read

_DUR_SQL = "dur as (select recording_id, max(duration_ns) as duration_ns from samples group by 1)"
_ASKED_SQL = "probes as (select recording_id, i as probe, duration_ns // 8 * i as t_ns, duration_ns from dur, range(0, 10) as r(i))"
_CREATED_SQL = "cast(o_orderdate as date) + cast(o_orderkey * 37 % 1500 - 400 as integer)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    dur = views.samples(spark, sf_dir).groupBy("recording_id").agg(F.max("duration_ns").alias("duration_ns"))
    return dur.withColumn("probe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).withColumn("t_ns", F.floor(F.col("duration_ns") / 8).cast("long") * F.col("probe"))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in several ways of writing, some of them wrong."""
    k, day = F.col("o_orderkey").cast("long"), F.col("o_orderdate").cast("date")
    kinds = F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, " yyyy/ M/d "), F.lit("31/02/2020"), F.date_format(day, "MMMM d"), F.lit("1850-01-02"), F.lit(""))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.get(kinds, (k % 7).cast("int")).alias("text"), F.date_add(day, (k * 37 % 1500 - 400).cast("int")).alias("created"))


@query("select o_orderkey, case when o_orderkey % 7 < 3 then strftime(o_orderdate, '%Y-%m-%d') when o_orderkey % 7 = 5 then '1850-01-02' end as day, case when o_orderkey % 7 < 3 then true when o_orderkey % 7 = 5 then false end as plausible from orders")
def source_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = dates.parse(F.col("text"))
    return _written(spark, sf_dir).select("o_orderkey", day.cast("string").alias("day"), dates.plausible(day).alias("plausible"))


@query(f"""with d as (select o_orderkey, case when o_orderkey % 7 < 3 then cast(o_orderdate as date) end as own, {_CREATED_SQL} as created from orders), a as (select *, created - own as age from d),
w as (select *, case when age >= 730 then 'rejected embedded_date date ' || own || ': ' || age || ' days older than file creation' when age < -7 then 'rejected embedded_date date ' || own || ': ' || -age || ' days newer than file creation' end as warning from a)
select o_orderkey, case when own is not null and warning is null then own::varchar else created::varchar end as selected, case when own is not null and warning is null then 'embedded_date' else 'file_created_at' end as source, warning from w""")
def event_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = dates.parse(F.col("text"))
    own = _written(spark, sf_dir).select("o_orderkey", "created", F.when(dates.plausible(day), day).alias("own"))
    return own.select("o_orderkey", dates.select(F.col("own"), F.lit("embedded_date"), F.col("created")).alias("e")).select("o_orderkey", F.col("e.selected").cast("string").alias("selected"), "e.source", "e.warning")


_TOKENS = ("trace", "g", "compass", "Trace", "t", "", "c")
_COLOURS = ("#00ffAA", "#00ffA", "00ffaa", "#00ffag", "#123456")


@query(f"""with c as (select c_custkey, md5(c_name) as m, list_value{_TOKENS}[c_custkey % 7 + 1] as token, list_value{_COLOURS}[c_custkey % 5 + 1] as colour from customer)
select c_custkey, case token when 'trace' then 'trace' when 't' then 'trace' when 'g' then 'gauge' when 'compass' then 'compass' when 'c' then 'compass' end as plot, colour in ('#00ffAA', '#123456') as colour,
  case when c_custkey % 3 = 0 then substr(m, 1, 16) end as hash, case when c_custkey % 3 = 1 then 'hash must be 16-digit lowercase hex' end as error, case when c_custkey % 2 = 0 then m || m end as digest, c_custkey % 4 <> 1 as visible from c""")
def strict_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot tokens, colours, schema hashes, digests and visibility flags, good and bad ones."""
    k, m = F.col("c_custkey").cast("int"), F.md5(F.col("c_name").cast("binary"))
    token, colour = (F.get(F.array(*[F.lit(x) for x in xs]), k % len(xs)) for xs in (_TOKENS, _COLOURS))
    told = formats.schema_hash(F.when(k % 3 == 0, F.substring(m, 1, 16)).when(k % 3 == 1, F.upper(m)).otherwise(""))
    digest = formats.digest(F.when(k % 2 == 0, F.concat(F.upper(m), m)).otherwise(m))
    shown = formats.visible(F.array(F.lit(True), F.lit(False)), k % 4)
    return read(spark, sf_dir, "customer").select("c_custkey", formats.plot(token).alias("plot"), formats.colour(colour).alias("colour"), told["hash"].alias("hash"), told["error"].alias("error"), F.lower(F.hex(digest)).alias("digest"), shown.alias("visible"))


@query("""with s as (select o_orderkey, (o_orderkey * 7919) % 400000000 as ms from orders), f as (select *, printf('%d:%02d.%03d', ms // 60000, (ms // 1000) % 60, ms % 1000) as short, printf('%d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) as long from s),
t as (select *, case when o_orderkey % 3 = 0 then 'pit stop' when ms >= 3600000 then long else short end as text from f)
select o_orderkey, case when o_orderkey % 3 = 0 or ms > 360000000 then 'text' else 'time' end as kind, case when o_orderkey % 3 <> 0 and ms <= 360000000 then ms end as ms, text as shown, case when o_orderkey % 3 = 0 or ms > 360000000 then '' else 'timespan_ms' end as unit from t""")
def span_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of spans: race times become milliseconds, other texts stay."""
    ms = (F.col("o_orderkey").cast("long") * 7919) % 400_000_000
    part = lambda unit, most: (F.floor(ms / unit) % most).cast("long")
    long = F.format_string("%d:%02d:%02d.%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)
    short = F.format_string("%d:%02d.%03d", F.floor(ms / 60_000), part(1000, 60), ms % 1000)
    text = F.when(F.col("o_orderkey") % 3 == 0, "pit stop").when(ms >= 3_600_000, long).otherwise(short)
    return read(spark, sf_dir, "orders").select("o_orderkey", formats.span_value(text).alias("s")).select("o_orderkey", "s.*")


@query(f"with {SAMPLES_SQL} select recording_id, channel, count(*) as n from samples where recording_id % 3 = 0 or channel in ('view', 'error') group by 1, 2")
def channel_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = report.retain(views.channels(spark, sf_dir), views.samples(spark, sf_dir), (F.col("recording_id") % 3 == 0) | F.col("name").isin("view", "error"))
    return kept[1].groupBy("recording_id", "channel").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {SAMPLES_SQL}, c as (select recording_id, arg_min(channel, case channel when 'purchase' then 0 when 'view' then 1 else 2 end) as channel from samples where channel in ('purchase', 'view', 'click') group by 1),
f as (select s.recording_id, arg_min(k, local_idx) as k from samples s join c using (recording_id, channel) group by 1) select recording_id, case when k % 4 = 0 then (k // 4)::varchar else (k / 4.0::double)::varchar end as first from f""")
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).withColumn("value", F.col("k") / 4.0)
    return report.first_value(views.channels(spark, sf_dir), s, ("purchase", "view", "click"))


@query(f"with {_COUNTER_SQL} select recording_id, count(*) filter (complete) as valid_laps from counter group by 1")
def valid_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.valid_laps(_counter(spark, sf_dir), _BY)


@query(f"""with {SAMPLES_SQL}, {_DUR_SQL}, {_ASKED_SQL}, u as (select recording_id, t_ns, arg_max(k, event_id) as k from samples group by 1, 2)
select p.recording_id, probe, case when p.t_ns < duration_ns then k + (p.recording_id % 2) end as number, case when p.t_ns < duration_ns then k + (p.recording_id % 2) - 1 end as previous from probes p asof left join u on p.recording_id = u.recording_id and p.t_ns >= u.t_ns""")
def counter_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lap numbers at points of time; every other recording counts finished laps."""
    s = views.samples(spark, sf_dir).withColumns({"value": F.col("k").cast("double"), "chunk_idx": F.lit(0), "local_idx": F.col("event_id")})
    asked, completed = _asked(spark, sf_dir), F.col("recording_id") % 2 == 1
    one = report.counter_number_at(asked, s, _BY, F.col("duration_ns"), completed)
    return one.select("recording_id", "probe", F.col("number").cast("long").alias("number"), (F.col("number") - 1).cast("long").alias("previous"))


@query(f"""with {_COUNTER_SQL}, {_DUR_SQL}, {_ASKED_SQL} select p.recording_id, probe, c.number as lap, round((p.t_ns - c.start_ns)::double / (c.end_ns - c.start_ns), 9) as lap_progress
from probes p left join counter c on c.recording_id = p.recording_id and p.t_ns >= c.start_ns and p.t_ns < c.end_ns""")
def lap_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = report.lap_at(_asked(spark, sf_dir), _counter(spark, sf_dir), _BY)
    return met.select("recording_id", "probe", "lap", F.round("lap_progress", 9).alias("lap_progress"))


_POSITION_SQL = f"""{SAMPLES_SQL}, pos as (select recording_id, channel, t_ns, arg_max(case channel when 'view' then 30 + k % 200 / 10.0::double else -100 + k % 300 / 10.0::double end, event_id) as v from samples where channel in ('view', 'click') group by 1, 2, 3),
nx as (select *, lead(t_ns) over w as nt, lead(v) over w as nv from pos window w as (partition by recording_id, channel order by t_ns)),
rec as (select recording_id, max(duration_ns) as duration_ns from samples where recording_id in (select recording_id from pos group by 1 having count(distinct channel) = 2) group by 1),
ask as (select recording_id, k, channel, duration_ns * k // 32 as t_ns from rec, range(0, 32) as r(k), (values ('view'), ('click')) as c(channel)),
got as (select a.recording_id, a.k, a.channel, case when nt is not null then v + (nv - v) * ((a.t_ns - nx.t_ns)::double / (nt - nx.t_ns)) else v end as v from ask a asof left join nx on a.recording_id = nx.recording_id and a.channel = nx.channel and a.t_ns >= nx.t_ns),
fx as (select recording_id, k, max(v) filter (channel = 'view') as lat, max(v) filter (channel = 'click') as lon from got group by 1, 2),
mean as (select recording_id, avg(lat) as lat, avg(lon) as lon, count(*) as n from fx where lat is not null and lon is not null group by 1)"""


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).withColumn("value", F.when(F.col("channel") == "view", 30 + F.col("k") % 200 / 10.0).otherwise(-100 + F.col("k") % 300 / 10.0))
    channels = views.channels(spark, sf_dir).drop("steps").withColumn("unit", F.lit("deg"))
    return report.mean_fix(channels, s, ("view",), ("click",))


@query(f"with {_POSITION_SQL} select recording_id, round(lat, 6) as lat, round(lon, 6) as lon, n from mean")
def gps_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir).select("recording_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


@query(f"with {_TRACKS_SQL}, {_POSITION_SQL}, d as (select recording_id, slug, {_HAV_SQL} as m from mean, t) select recording_id, arg_min(slug, m) as slug, round(min(m) / 1000, 3) as km from d where m <= {_REACH} group by 1")
def recording_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.match_track(_means(spark, sf_dir), _tracks(spark), _REACH)
    return found.select("recording_id", "slug", F.round(F.col("distance_m") / 1000, 3).alias("km"))


@query("""select c_custkey, slot, cast(case when least(c_custkey % 60, 19) <= 1 then 1 else 1 + ((c_custkey % 60 - 1) * slot) // (least(c_custkey % 60, 19) - 1) end as bigint) as index
from customer, range(0, 19) as r(slot) where slot < least(c_custkey % 60, 19)""")
def spaced_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 60).cast("long").alias("n"))
    return report.spaced(c, F.col("n")).select("c_custkey", "slot", "index")


@query(f"""with {SAMPLES_SQL}, {_DUR_SQL}, p as (select recording_id, i as probe, duration_ns // 8 * i as t_ns, i * 50000000 - 100000000 as offset_ns from dur, range(0, 10) as r(i)),
u as (select recording_id, channel, t_ns, arg_max(value, event_id) as value, arg_max(k, event_id) as k from samples where channel in ('view', 'click') group by 1, 2, 3),
v as (select * from u where channel = 'view'), c as (select * from u where channel = 'click'),
a as (select p.*, k % 7 - 2 as fi from p asof left join v on p.recording_id = v.recording_id and p.t_ns >= v.t_ns),
b as (select a.*, value as sync from a asof left join c on a.recording_id = c.recording_id and a.t_ns >= c.t_ns)
select recording_id, probe, case when fi >= 0 then fi end as file_index, round(sync, 6) as sync_time, case when t_ns + offset_ns >= 0 then t_ns + offset_ns end as pts_ns, cast(case when t_ns + offset_ns >= 0 then least((t_ns + offset_ns) // 40000000, 249) end as bigint) as frame from b""")
def video_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).withColumn("local_idx", F.col("event_id"))
    index = s.where("channel = 'view'").withColumn("value", (F.col("k") % 7 - 2).cast("double"))
    asked = _asked(spark, sf_dir).select("recording_id", "probe", "t_ns", (F.col("probe") * 50_000_000 - 100_000_000).alias("offset_ns"))
    frames = asked.select("recording_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(249).cast("long")))).withColumn("pts_ns", F.col("frame") * 40_000_000)
    met = report.video_reference(asked, index, s.where("channel = 'click'"), frames, _BY)
    return met.select("recording_id", "probe", "file_index", F.round("sync_time", 6).alias("sync_time"), "pts_ns", "frame")


@query(f"""with {SAMPLES_SQL}, c as (select recording_id, channel, count(*) as n, max(duration_ns) as d from samples group by 1, 2)
select recording_id, printf('{{"channels":%d,"sampled_channels":%d,"samples":%d,"duration_ns":%d}}', count(*), count(*), sum(n)::bigint, max(d)) as report from c group by 1""")
def inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.inspection(summary.file_summary(views.channels(spark, sf_dir)))
