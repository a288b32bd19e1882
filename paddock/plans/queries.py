"""The registered queries: every operator on the driver's tables, with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions import clock, geo, names, timespan, units
from paddock.operators import laps, lattice, normalize, passes, runs, sampling, sessions, summary, tracks, validate, video
from paddock.plans import views
from paddock.plans.views import SAMPLES_SQL, read
from paddock.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_BY = ["recording_id"]
_ORDER = ["t_ns", "event_id"]


def query(sql: str | None = None):
    """Register a query under its name, with its SQL form if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- laps -------------------------------------------------------------------------------------------

_COUNTER_SQL = f"""{SAMPLES_SQL},
marks as (select * from (select *, max(k) over (partition by recording_id order by t_ns, event_id rows between unbounded preceding and 1 preceding) as top from samples) where top is null or k > top),
cl as (select recording_id, k as number, t_ns as start_ns, coalesce(lead(t_ns) over w, duration_ns) as end_ns,
         (top is not null and lead(t_ns) over w is not null) as complete, count(*) over (partition by recording_id) - 1 as crossings
       from marks window w as (partition by recording_id order by t_ns, event_id)),
counter as (select recording_id, number, start_ns, end_ns, end_ns - start_ns as duration_ns, complete, crossings from cl where number > 0 and end_ns > start_ns)"""


def _counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).withColumn("value", F.col("k").cast("double"))
    return laps.counter_laps(s, _BY, _ORDER, F.col("duration_ns"))


@query(f"""with {_COUNTER_SQL},
hit as (select s.channel, s.unit, c.recording_id, c.number, c.start_ns, c.end_ns, s.value from samples s join counter c on s.recording_id = c.recording_id and c.complete and s.t_ns >= c.start_ns and s.t_ns < c.end_ns)
select recording_id, number, channel, max(value) as max_value, count(*) as n,
  case channel when 'click' then max(value) * (1.0::double / 3.6::double) when 'view' then max(value) end as max_mps,
  printf('%d:%02d.%03d', (any_value(end_ns - start_ns) // 60000000000)::bigint, ((any_value(end_ns - start_ns) // 1000000000) % 60)::bigint, ((any_value(end_ns - start_ns) // 1000000) % 1000)::bigint) as lap_time
from hit group by recording_id, number, start_ns, end_ns, channel""")
def lap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: laps from the counter, each channel's maximum per complete lap, in metres per second, with the lap time."""
    stats = laps.lap_statistics(views.samples(spark, sf_dir), _counter(spark, sf_dir), _BY, "channel")
    unit = F.element_at(F.create_map(*[F.lit(x) for n, (_, u) in views.CHANNELS.items() for x in (n, u)]), F.col("channel"))
    return stats.select("recording_id", "number", "channel", "max_value", "n", units.convert(F.col("max_value"), unit, F.lit("m/s")).alias("max_mps"), timespan.format_ns(F.col("end_ns") - F.col("start_ns")).alias("lap_time"))


@query(f"with {_COUNTER_SQL} select * from counter")
def counter_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counter(spark, sf_dir)


# Two counters a recording: the JSON counter as Lap Number, and how often it passed 90 as beaconEventCount.
_TWO_SQL = f"""{SAMPLES_SQL},
two as (select recording_id, 0 as channel_idx, t_ns, event_id, duration_ns, k % 3 as v, 0 as up from samples
  union all select recording_id, 1, t_ns, event_id, duration_ns, cast(sum(case when k >= 90 then 1 else 0 end) over (partition by recording_id order by t_ns, event_id rows unbounded preceding) as bigint), 1 from samples),
m2 as (select * from (select *, max(v) over (partition by recording_id, channel_idx order by t_ns, event_id rows between unbounded preceding and 1 preceding) as top from two) where top is null or v > top),
l2 as (select recording_id, channel_idx, v + up as number, t_ns as start_ns, coalesce(lead(t_ns) over w, duration_ns) as end_ns,
  (top is not null and lead(t_ns) over w is not null) as complete, count(*) over (partition by recording_id, channel_idx) - 1 as crossings
  from m2 window w as (partition by recording_id, channel_idx order by t_ns, event_id)),
k2 as (select * from l2 where number > 0 and end_ns > start_ns),
best as (select recording_id, arg_min(channel_idx, (case when crossings >= 2 then 0 when crossings = 1 then 1 else 2 end) * 1000000 + (case when crossings >= 2 then -crossings else 0 end) * 100 + channel_idx * 10) as channel_idx from k2 group by 1)"""


@query(f"with {_TWO_SQL} select k2.recording_id, k2.channel_idx, number, start_ns, end_ns, end_ns - start_ns as duration_ns, complete, crossings from k2 join best using (recording_id, channel_idx)")
def counter_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = views.samples(spark, sf_dir)
    w = Window.partitionBy("recording_id").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    one = s.select("recording_id", F.lit(0).alias("channel_idx"), *_ORDER, "duration_ns", (F.col("k") % 3).cast("double").alias("value"))
    two = s.select("recording_id", F.lit(1).alias("channel_idx"), *_ORDER, "duration_ns", F.sum(F.when(F.col("k") >= 90, 1).otherwise(0)).over(w).cast("double").alias("value"))
    named = spark.createDataFrame([(0, "Lap Number"), (1, "beaconEventCount")], "channel_idx int, name string")
    channels = s.select("recording_id").distinct().join(F.broadcast(named))
    held = laps.counter_laps(one.unionByName(two), [*_BY, "channel_idx"], _ORDER, F.col("duration_ns"), F.col("channel_idx") == 1)
    return laps.select_counter(held, channels)


_TIMER_SQL = f"""{SAMPLES_SQL},
tm as (select *, lag(value) over (partition by recording_id order by t_ns, event_id) as before, greatest(0.0, max(value) over (partition by recording_id)) as most from samples where channel = 'click'),
resets as (select recording_id, greatest(0, t_ns - cast(round(greatest(0.0, value) * (case when most > 1000 then 1e6 else 1e9 end)) as bigint)) as t_ns from tm where before - value > (case when most > 1000 then 5000.0 else 5.0 end)),
dur as (select distinct recording_id, duration_ns from samples),
bounds as (select recording_id, t_ns, row_number() over (partition by recording_id order by t_ns) as kk from resets union all select distinct recording_id, 0, 0 from resets),
tl as (select b.recording_id, kk + 1 as number, t_ns as start_ns, coalesce(lead(t_ns) over w, d.duration_ns) as end_ns, (kk > 0 and kk + 1 < count(*) over (partition by b.recording_id)) as complete
  from bounds b join dur d using (recording_id) window w as (partition by b.recording_id order by kk)),
timer as (select recording_id, number, start_ns, end_ns, end_ns - start_ns as duration_ns, complete from tl where end_ns >= start_ns)"""


def _timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir)
    resets = laps.timer_resets(s.where("channel = 'click'"), _BY, _ORDER, F.lit(False))
    return laps.timer_laps(resets, s.select("recording_id", "duration_ns").distinct(), _BY)


@query(f"with {_TIMER_SQL} select * from timer")
def timer_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timer(spark, sf_dir)


_SNAP = 3_600_000_000_000
_REFINE_SQL = f"""{_COUNTER_SQL}, {_TIMER_SQL.split(SAMPLES_SQL + ",", 1)[1]},
rs as (select distinct recording_id, start_ns as r from timer where complete or start_ns > 0),
ids as (select *, row_number() over (partition by recording_id order by start_ns, number) as id, row_number() over (partition by recording_id order by start_ns desc, number desc) as back from counter),
pts as (select recording_id, id, 's' as side, start_ns as b from ids union all select recording_id, id, 'e', end_ns from ids),
near as (select p.recording_id, p.id, p.side, arg_min(r, abs(r - b) * 2 + (case when r > b then 1 else 0 end)) as r from pts p join rs using (recording_id) where abs(r - b) <= {_SNAP} group by p.recording_id, p.id, p.side),
mv as (select i.recording_id, number, complete, case when i.id = 1 and not complete then start_ns else coalesce(s.r, start_ns) end as start_ns, case when back = 1 and not complete then end_ns else coalesce(e.r, end_ns) end as end_ns
  from ids i left join near s on s.recording_id = i.recording_id and s.id = i.id and s.side = 's' left join near e on e.recording_id = i.recording_id and e.id = i.id and e.side = 'e'),
refined as (select recording_id, number, start_ns, end_ns, end_ns - start_ns as duration_ns, complete from mv where end_ns > start_ns)"""


@query(f"with {_REFINE_SQL} select * from refined")
def refine_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter laps snapped to resets; events are sparse, so the reach is an hour here."""
    return laps.refine(_counter(spark, sf_dir), _timer(spark, sf_dir), _BY, _SNAP)


@query(f"""with {_REFINE_SQL},
ranked as (select *, 'counter' as origin, 1 as r from refined where recording_id in (select recording_id from counter where crossings > 0)
  union all select *, 'timer', 2 from timer union all select recording_id, number, start_ns, end_ns, duration_ns, complete, 'constant', 3 from counter)
select recording_id, number, start_ns, end_ns, duration_ns, complete, origin from (select *, min(r) over (partition by recording_id) as best from ranked) where r = best""")
def pick_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counter, timer = _counter(spark, sf_dir), _timer(spark, sf_dir)
    refined = laps.refine(counter.where("crossings > 0"), timer, _BY, _SNAP)
    return laps.pick(counter.limit(0), counter, refined, timer, _BY)


@query(f"""with {_COUNTER_SQL}, ref as (select recording_id, cast(round(arg_min(value, {{'t': t_ns, 'e': event_id}}) * (case when max(value) > 1000 then 1e6 else 1e9 end) * 100) as bigint) as reference_ns from samples where channel = 'view' and value > 0 group by 1),
ok as (select c.*, r.reference_ns from counter c left join ref r using (recording_id) where complete and duration_ns >= 10000000000 and (reference_ns is null or (duration_ns >= reference_ns // 2 and duration_ns <= reference_ns * 3 // 2)))
select recording_id, number, start_ns, end_ns, duration_ns, complete from (select *, row_number() over (partition by recording_id order by duration_ns, start_ns) as rn from ok) where rn = 1""")
def fastest_lap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fastest laps against a reference of a hundred times the first view value."""
    s = views.samples(spark, sf_dir).where("channel = 'view' and value > 0")
    ref = laps.reference_lap_ns(s, _BY, _ORDER)
    scaled = s.groupBy("recording_id").agg(F.min_by("value", F.struct(*_ORDER)).alias("v"), F.max("value").alias("m")).select("recording_id", F.round(F.col("v") * F.when(F.col("m") > 1000, 1e6).otherwise(1e9) * 100).cast("long").alias("reference_ns"))
    return laps.fastest_lap(_counter(spark, sf_dir), _BY, scaled.join(ref.select("recording_id"), "recording_id", "left_semi"))


_EDGES_SQL = f"{SAMPLES_SQL}, edges as (select recording_id, t_ns from (select *, lag(value) over (partition by recording_id order by t_ns, event_id) as before from (select recording_id, t_ns, event_id, cast(k - 60 as double) as value from samples)) where value > 0 and before <= 0 and t_ns > 0)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).withColumn("value", (F.col("k") - 60).cast("double"))
    return laps.beacon_edges(s, _BY, _ORDER, True)


@query(f"with {_EDGES_SQL} select * from edges")
def beacon_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


_SPACING = 86_400_000_000_000


@query(f"""with recursive {_EDGES_SQL}, kept as (select recording_id, min(t_ns) as t_ns from edges group by 1
  union all select recording_id, nxt from (select k.recording_id, (select min(e.t_ns) from edges e where e.recording_id = k.recording_id and e.t_ns >= k.t_ns + {_SPACING}) as nxt from kept k) where nxt is not null)
select recording_id, t_ns from kept""")
def beacon_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at least a day apart from the last kept one."""
    return laps.beacon_markers(_edges(spark, sf_dir), _BY, _SPACING)


# ---- names, units, race times -----------------------------------------------------------------------


@query("""select p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) as norm, contains(lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')), 're') as has_re from part""")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", names.normalize(F.col("p_name")).alias("norm"), names.contains(F.col("p_name"), F.lit("R-e")).alias("has_re"))


_NAMES = ["Ground Speed", "Speed", "GPS Speed", "Lap Number", "lap", "Beacon Event Count", "GPS Latitude", "lat", "Driver ID", "Current Lap Time", "Ref Lap Time", "Satellites", "lon", "GPS Longitude", "Lap Progress %", "GPS Week", "GPS ITOW", "Global Time", "Unix Time", "GPS Fix Type", "GPS Pos Accuracy", "HDOP", "GPS Fix Valid"]
_WANTED = names.ROLES


@query(
    "with n(idx, name) as (values " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES)) + "), w(role, rank, wanted) as (values "
    + ", ".join(f"('{r}', {k}, '{n}')" for r, ns in _WANTED.items() for k, n in enumerate(ns))
    + """), c as (select c_custkey as recording_id, idx as channel_idx, case when (c_custkey + idx * 7) % 3 <> 0 then name else 'other ' || name end as name from customer, n)
select recording_id, role, arg_min(channel_idx, rank * 1000 + channel_idx) as channel_idx from c join w on wanted = lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) group by 1, 2"""
)
def role_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(i).alias("channel_idx"), F.lit(n).alias("name")) for i, n in enumerate(_NAMES)])
    ids = spread(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recording_id")), "recording_id")
    c = ids.select("recording_id", F.explode(listed).alias("n")).select("recording_id", "n.*")
    c = c.withColumn("name", F.when((F.col("recording_id") + F.col("channel_idx") * 7) % 3 != 0, F.col("name")).otherwise(F.concat(F.lit("other "), F.col("name"))))
    return names.resolve_roles(c, _WANTED)


_PAIRS = [("km/h", "m/s"), ("MPH", "km/h"), ("C", "F"), ("psi", "bar"), ("deg", "rad"), ("gear", "gear"), ("m/s", "bar"), ("gear", "%"), ("", "m")]
_UNITS_SQL = ", ".join(f"('{n}', '{d}', {f!r}::double, {o!r}::double, '{n}'{''.join(chr(44) + chr(39) + '' + chr(39) for _ in ())})" for d, us in units.UNITS.items() for n, f, o, _ in us)


@query(
    "with u(canonical, dimension, factor, offs, x) as (values " + _UNITS_SQL + "), p(kind, a, b) as (values " + ", ".join(f"({i}, '{a if a != 'MPH' else 'mph'}', '{b}')" for i, (a, b) in enumerate(_PAIRS)) + """)
select l_orderkey, l_linenumber, kind, case when ua.canonical is null or ub.canonical is null then 'unknown_unit' when ua.canonical = ub.canonical then null when ua.dimension <> ub.dimension then 'dimension_mismatch' when ua.dimension in ('count', 'marker') then 'not_convertible' end as error,
  round(case when ua.canonical = ub.canonical then l_quantity::double when ua.dimension = ub.dimension and ua.dimension not in ('count', 'marker') then (l_quantity::double * ua.factor + ua.offs - ub.offs) / ub.factor end, 6) as converted
from lineitem join p on kind = (l_orderkey + l_linenumber) % 9 left join u ua on ua.canonical = a left join u ub on ub.canonical = b"""
)
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities through unit pairs that convert and pairs that don't."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _PAIRS])
    kind = ((F.col("l_orderkey") + F.col("l_linenumber")) % len(_PAIRS)).cast("int")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), kind.alias("kind")).withColumn("p", F.get(pairs, F.col("kind")))
    a, b = F.col("p.a"), F.col("p.b")
    return li.select("l_orderkey", "l_linenumber", "kind", units.conversion_error(a, b).alias("error"), F.round(units.convert(F.col("q"), a, b), 6).alias("converted"))


_MS_SQL = "(o_orderkey * 7919) % 400000000"
_FMT_SQL = "case when ms between 0 and 360000000 then case when ms >= 3600000 then printf('%d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) else printf('%d:%02d.%03d', ms // 60000, (ms // 1000) % 60, ms % 1000) end end"


@query(f"select o_orderkey, {_FMT_SQL} as span from (select o_orderkey, {_MS_SQL} as ms from orders)")
def timespan_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (F.col("o_orderkey") * 7919) % 400_000_000
    return read(spark, sf_dir, "orders").select("o_orderkey", timespan.format_ms(ms).alias("span"))


_TEXT_SQL = "printf('%d:%02d.%03d', o_orderkey % 200, (o_orderkey * 7) % 64, (o_orderkey * 13) % 1000)"


@query(f"""select o_orderkey, case when s < 60 then ((o_orderkey % 200) * 60 + s) * 1000 + (o_orderkey * 13) % 1000 end::int as ms, case when s < 60 and h < 60 then cast(((o_orderkey % 90) * 3600 + h * 60 + s) * 1000 + (o_orderkey * 13) % 1000 as int) end as long_ms
from (select o_orderkey, (o_orderkey * 7) % 64 as s, (o_orderkey * 3) % 61 as h from orders)""")
def timespan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    short = F.format_string("%d:%02d.%03d", k % 200, (k * 7) % 64, (k * 13) % 1000)
    long = F.format_string("%d:%02d:%02d.%03d", k % 90, (k * 3) % 61, (k * 7) % 64, (k * 13) % 1000)
    return read(spark, sf_dir, "orders").select("o_orderkey", timespan.parse_ms(short).alias("ms"), timespan.parse_ms(long).alias("long_ms"))


@query(f"select o_custkey, cast((sum(ms) + count(*) // 2) // count(*) as bigint) as mean_ms from (select o_custkey, {_MS_SQL} as ms from orders) group by 1")
def timespan_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (F.col("o_orderkey") * 7919) % 400_000_000
    return read(spark, sf_dir, "orders").withColumn("ms", ms).groupBy("o_custkey").agg(timespan.mean_ms(F.col("ms")).alias("mean_ms"))


# ---- sampling ---------------------------------------------------------------------------------------

_PROBES_SQL = f"{SAMPLES_SQL}, dur as (select recording_id, max(duration_ns) as duration_ns from samples group by 1), probes as (select recording_id, i as probe, duration_ns // 8 * i as t_ns, duration_ns from dur, range(0, 10) as r(i))"
_EACH_SQL = "vu as (select recording_id, channel_idx, t_ns, arg_max(value, event_id) as value from samples group by 1, 2, 3), vn as (select *, lead(t_ns) over w as nt, lead(value) over w as nv from vu window w as (partition by recording_id, channel_idx order by t_ns)), ask as (select p.*, channel_idx from probes p join (select distinct recording_id, channel_idx from samples) using (recording_id))"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dur = views.samples(spark, sf_dir).groupBy("recording_id").agg(F.max("duration_ns").alias("duration_ns"))
    return dur.withColumn("probe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).select("recording_id", "probe", (F.floor(F.col("duration_ns") / 8) * F.col("probe")).alias("t_ns"))


def _sampled(spark: SparkSession, sf_dir: str, linear: bool) -> DataFrame:
    """Every channel at the recording's probes."""
    channels = views.channels(spark, sf_dir)
    asked = _probes(spark, sf_dir).join(channels.select("recording_id", "channel_idx"), "recording_id")
    return sampling.sample_at(asked, views.samples(spark, sf_dir), channels, linear).select("recording_id", "channel_idx", "probe", "t_ns", F.round("value", 6).alias("value"))


@query(f"with {_PROBES_SQL}, {_EACH_SQL} select p.recording_id, p.channel_idx, probe, p.t_ns, case when p.t_ns < duration_ns then round(vn.value, 6) end as value from ask p asof left join vn on p.recording_id = vn.recording_id and p.channel_idx = vn.channel_idx and p.t_ns >= vn.t_ns")
def sample_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir, False)


@query(f"""with {_PROBES_SQL}, {_EACH_SQL} select p.recording_id, p.channel_idx, probe, p.t_ns, case when p.t_ns < duration_ns then round(case when nt is not null then vn.value + (nv - vn.value) * ((p.t_ns - vn.t_ns)::double / (nt - vn.t_ns)::double) else vn.value end, 6) end as value
from ask p asof left join vn on p.recording_id = vn.recording_id and p.channel_idx = vn.channel_idx and p.t_ns >= vn.t_ns""")
def sample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir, True)


_CHUNKS_SQL = "chunks as (select o_custkey as recording_id, 0 as channel_idx, rn - 1 as chunk_idx, p as sample_period_ns, n as sample_count, sum(n) over w - n as sample_base, sum(n * p + gap) over w - n * p - gap as time_base_ns from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn, case o_orderkey % 3 when 0 then 10000000 when 1 then 10100000 else 20000000 end as p, 1 + o_orderkey % 5 as n, (o_orderkey % 2) * 7000000 as gap from orders) window w as (partition by o_custkey order by o_orderkey))"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    p = F.when(k % 3 == 0, 10_000_000).when(k % 3 == 1, 10_100_000).otherwise(20_000_000).cast("long")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", p.alias("p"), (1 + k % 5).alias("n"), ((k % 2) * 7_000_000).alias("gap"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return o.select(
        F.col("o_custkey").alias("recording_id"), F.lit(0).alias("channel_idx"), (F.row_number().over(w) - 1).alias("chunk_idx"), F.col("p").alias("sample_period_ns"), F.col("n").alias("sample_count"),
        (F.sum("n").over(upto) - F.col("n")).alias("sample_base"), (F.sum(F.col("n") * F.col("p") + F.col("gap")).over(upto) - F.col("n") * F.col("p") - F.col("gap")).alias("time_base_ns"),
    )


@query(f"with {_CHUNKS_SQL} select recording_id, chunk_idx, i as local_idx, cast(sample_base + i as bigint) as global_idx, cast(time_base_ns + i * sample_period_ns as bigint) as t_ns from chunks, range(0, 5) as r(i) where i < sample_count")
def chunk_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.expand_chunks(_chunks(spark, sf_dir)).select("recording_id", "chunk_idx", "local_idx", "global_idx", "t_ns")


@query(f"""with {_CHUNKS_SQL}, w as (select recording_id, sample_period_ns as p, sum(sample_count) as n from chunks group by 1, 2), d as (select recording_id, arg_max(p, n * 1000000000 - p) as p from w group by 1)
select recording_id, cast(case when p >= 1000000 and abs((p + 500000) // 1000000 * 1000000 - p) * 50 <= p then (p + 500000) // 1000000 * 1000000 else p end as bigint) as period_ns from d""")
def period_modal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_period(_chunks(spark, sf_dir), _BY)


@query(f"""with {_CHUNKS_SQL}, s as (select recording_id, chunk_idx, i as local_idx, time_base_ns, sample_count, sample_period_ns, cast((recording_id * 31 + (sample_base + i) * 17) % 100 as double) as value, sample_base + i as g from chunks, range(0, 5) as r(i) where i < sample_count),
pr as (select recording_id, i * 9000000 as t_ns from (select distinct recording_id from chunks), range(0, 12) as q(i)),
dur as (select recording_id, max(time_base_ns + sample_count * sample_period_ns) as duration_ns from chunks group by 1),
ends as (select *, time_base_ns + sample_count * sample_period_ns - 1 as last_ns from chunks),
c as (select pr.recording_id, pr.t_ns, e.chunk_idx, least(sample_count - 1, greatest(0, pr.t_ns - time_base_ns) // sample_period_ns) as local_idx from pr asof left join ends e on e.recording_id = pr.recording_id and e.last_ns >= pr.t_ns)
select c.recording_id, c.t_ns, case when c.t_ns < duration_ns then s.value end as value from c join dur using (recording_id) left join s on s.recording_id = c.recording_id and s.chunk_idx = c.chunk_idx and s.local_idx = c.local_idx""")
def sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step samples of grids with gaps, where a gap reads the next chunk."""
    chunks = _chunks(spark, sf_dir)
    s = sampling.expand_chunks(chunks).withColumn("value", ((F.col("recording_id") * 31 + F.col("global_idx") * 17) % 100).cast("double"))
    pr = chunks.select("recording_id", "channel_idx").distinct().withColumn("t_ns", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")), lambda i: i * 9_000_000)))
    dur = chunks.groupBy("recording_id", "channel_idx").agg(F.max(F.col("time_base_ns") + F.col("sample_count") * F.col("sample_period_ns")).alias("duration_ns")).withColumn("steps", F.lit(False))
    return sampling.sample_at_grid(pr, chunks, s, dur, False).select("recording_id", "t_ns", "value")


# ---- runs -------------------------------------------------------------------------------------------

_RUNS_SQL = f"""{SAMPLES_SQL}, rv as (select recording_id, t_ns, event_id, duration_ns, cast(k // 25 - 1 as bigint) as v from samples),
st as (select * from (select *, lag(v) over (partition by recording_id order by t_ns, event_id) as b from rv) where b is null or b <> v),
rr as (select recording_id, row_number() over w as run, v as value, t_ns as start_ns, coalesce(lead(t_ns) over w, greatest(duration_ns, t_ns)) as end_ns from st window w as (partition by recording_id order by t_ns, event_id))"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).withColumn("value", (F.floor(F.col("k") / 25) - 1).cast("double"))
    return runs.integer_runs(s, _BY, _ORDER, F.col("duration_ns"))


@query(f"with {_RUNS_SQL} select * from rr")
def integer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


_STINT = 36_000_000_000_000


@query(f"with {_RUNS_SQL} select recording_id, value as driver_id, start_ns, end_ns from (select *, count(*) over (partition by recording_id) as n from rr) where (n = 1 or end_ns - start_ns >= {_STINT}) and value >= 0")
def driver_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.driver_stints(_runs(spark, sf_dir), _BY, _STINT)


@query(f"with {SAMPLES_SQL} select recording_id, cast(round(value) as bigint) as driver_id, count(*) as n from samples group by 1, 2")
def driver_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.histogram(views.samples(spark, sf_dir), _BY)


@query(f"with {SAMPLES_SQL}, c as (select recording_id, channel_idx, count(*) as n, max(duration_ns) as d from samples group by 1, 2) select recording_id, count(*) as channels, count(*) as sampled_channels, cast(sum(n) as bigint) as samples, max(d) as duration_ns from c group by 1")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.file_summary(views.channels(spark, sf_dir))


_BYTES = "list_transform(string_split(lower({}), ''), lambda c: ascii(c)::hugeint)"


@query(f"""with {SAMPLES_SQL}, c as (select distinct recording_id, channel_idx, {_BYTES.format("channel")} || [0::hugeint] || {_BYTES.format("unit")} || [0::hugeint, 7, 0] as b from samples),
r as (select recording_id, flatten(list(b order by channel_idx)) as b from c group by 1)
select recording_id, lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::hugeint, b), lambda h, x: xor(h, x) * 1099511628211::hugeint % 18446744073709551616::hugeint)::ubigint)), 16, '0') as schema_hash from r""")
def schema_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.schema_hash(views.channels(spark, sf_dir))


# ---- clocks -----------------------------------------------------------------------------------------

_ZONES = ("America/New_York", "Europe/Berlin", "Asia/Tokyo", "Australia/Adelaide")


@query(f"""with z(i, zone) as (values {", ".join(f"({i}, '{n}')" for i, n in enumerate([*_ZONES, "Nowhere/None"]))}), o as (select o_orderkey, epoch_us(o_orderdate::timestamp) * 1000 + (o_orderkey * 977 % 86400) * 1000000000 + 7 as ns, zone from orders join z on i = o_orderkey % 5)
select o_orderkey, case when zone <> 'Nowhere/None' then epoch_us(timezone(zone, make_timestamp(ns // 1000000000 * 1000000))) * 1000 + ns % 1000000000 end as utc_ns from o""")
def civil_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.get(F.array(*[F.lit(z) for z in (*_ZONES, "Nowhere/None")]), (F.col("o_orderkey") % 5).cast("int"))
    ns = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + (F.col("o_orderkey") * 977 % 86400) * 1_000_000_000 + 7
    return read(spark, sf_dir, "orders").select("o_orderkey", clock.civil_to_utc_ns(ns, zone, _ZONES).alias("utc_ns"))


@query("select o_orderkey, ((o_orderkey % 2300) * 604800000 + (o_orderkey * 7919) % 604800000 + 315964800000) * 1000000 as gps_ns, ((((o_orderkey % 2300) * 604800000 + (o_orderkey * 7919) % 604800000 + 315964800000) * 1000000) % 86400000000000 + 86400000000000) % 86400000000000 as day_ns from orders")
def clock_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    at = clock.gps_ns(k % 2300, (k * 7919) % 604_800_000)
    return read(spark, sf_dir, "orders").select("o_orderkey", at.alias("gps_ns"), clock.time_of_day_ns(F.lit(0).cast("long"), at, F.lit("gps")).alias("day_ns"))


_UNIX_SQL = f"{SAMPLES_SQL}, uc as (select recording_id, t_ns, event_id, 1.5e9::double + t_ns / 1e9 * (case when recording_id % 3 = 0 then 1.1 else 1.0 end) + (case when recording_id % 5 = 0 then (k % 2) * -1e7 else 0 end) as value from samples), ul as (select *, lag(value) over (partition by recording_id order by t_ns, event_id) as b from uc)"


@query(f"""with {_UNIX_SQL}, g as (select recording_id, count(*) as n, min(value) as lo, max(value) as hi, coalesce(bool_or(value < b), false) as fell, arg_min(value, {{'t': t_ns, 'e': event_id}}) as va, arg_max(value, {{'t': t_ns, 'e': event_id}}) as vb, min(t_ns) as ta, max(t_ns) as tb from ul group by 1)
select recording_id, cast(round(va * 1e9) as bigint) as absolute_start_ns, cast(round(vb * 1e9) as bigint) as absolute_end_ns, cast(round(va * 1e9) as bigint) - ta as clock_offset_ns from g
where n >= 2 and lo >= 946684800 and hi <= 4102444800 and not fell and abs(vb - va - (tb - ta) / 1e9) <= greatest((tb - ta) / 1e9 * 0.02, 2.0)""")
def clock_unix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("recording_id")
    v = F.lit(1.5e9) + F.col("t_ns") / 1e9 * F.when(r % 3 == 0, 1.1).otherwise(1.0) + F.when(r % 5 == 0, (F.col("k") % 2) * -1e7).otherwise(0)
    return summary.unix_clock(views.samples(spark, sf_dir).withColumn("value", v), _BY, _ORDER)


# ---- sessions ---------------------------------------------------------------------------------------

_GAP = 20 * 86_400_000_000_000
_FILES_SQL = "files as (select o_orderkey as file_id, o_custkey as session_key, epoch_us(o_orderdate::timestamp) * 1000 as absolute_start_ns, epoch_us(o_orderdate::timestamp) * 1000 + (1 + o_orderkey % 40) * 86400000000000 as absolute_end_ns from orders)"
_GROUP_SQL = f"""{_FILES_SQL}, gl as (select *, case when absolute_start_ns <= lag(absolute_end_ns) over w + {_GAP} then 0 else 1 end as nw from files window w as (partition by session_key order by absolute_start_ns nulls first, file_id)),
gr as (select *, sum(nw) over (partition by session_key order by absolute_start_ns nulls first, file_id rows unbounded preceding) as session_no from gl),
grouped as (select file_id, session_key, absolute_start_ns, absolute_end_ns, cast(session_no as bigint) as session_no, concat_ws(':', session_key, cast(session_no as bigint)) as session from gr)"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("session_key"), start.alias("absolute_start_ns"), (start + (1 + F.col("o_orderkey") % 40) * 86_400_000_000_000).alias("absolute_end_ns"))
    return sessions.group(o, _GAP)


@query(f"with {_GROUP_SQL} select * from grouped")
def session_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir)


@query(f"with {_GROUP_SQL} select session, array_to_string(list(file_id order by absolute_start_ns, file_id), ',') as files, min(absolute_start_ns) as absolute_start_ns, max(absolute_end_ns) as absolute_end_ns, max(absolute_end_ns) - min(absolute_start_ns) as duration_ns from grouped group by session")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.summary(_grouped(spark, sf_dir)).withColumn("files", F.array_join(F.transform("files", lambda f: f.cast("string")), ","))


_PARTS_SQL = f"""{_GROUP_SQL}, base as (select session, min(absolute_start_ns) as b from grouped group by 1), parts as (select session, file_id % 2 as number, absolute_start_ns - b as start_ns, absolute_end_ns - b as end_ns from grouped join base using (session)),
t1 as (select *, case when lag(number) over w = number then 0 else 1 end as turn from parts window w as (partition by session order by start_ns, end_ns, number)),
t2 as (select *, sum(turn) over (partition by session order by start_ns, end_ns, number rows unbounded preceding) as run from t1),
t3 as (select *, max(end_ns) over (partition by session, run order by start_ns, end_ns rows between unbounded preceding and 1 preceding) as far from t2),
t4 as (select *, sum(case when far is null or start_ns > far + {_GAP} then 1 else 0 end) over (partition by session, run order by start_ns, end_ns rows unbounded preceding) as isl from t3),
merged as (select session, number, min(start_ns) as start_ns, max(end_ns) as end_ns from t4 group by session, run, isl, number)"""


@query(f"with {_PARTS_SQL} select session, number, start_ns, end_ns, end_ns - start_ns as duration_ns, (row_number() over (partition by session order by start_ns, number) > 1 and row_number() over (partition by session order by start_ns desc, number desc) > 1) as complete from merged")
def session_merge_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grouped(spark, sf_dir)
    base = g.groupBy("session").agg(F.min("absolute_start_ns").alias("b"))
    parts = g.join(base, "session").select("session", (F.col("file_id") % 2).alias("number"), (F.col("absolute_start_ns") - F.col("b")).alias("start_ns"), (F.col("absolute_end_ns") - F.col("b")).alias("end_ns"))
    return sessions.merge_laps(parts, _GAP)


@query(f"""with {_GROUP_SQL}, base as (select session, min(absolute_start_ns) as b from grouped group by 1), f as (select session, file_id, absolute_start_ns - b as offset_ns, absolute_end_ns - absolute_start_ns as duration_ns from grouped join base using (session)),
p as (select session, i * 8640000000000 * 25 as t_ns from base, range(0, 6) as r(i)), m as (select p.session, t_ns, file_id, t_ns - offset_ns as file_time_ns, row_number() over (partition by p.session, t_ns order by offset_ns, file_id) as rn from p join f on p.session = f.session and t_ns >= offset_ns and t_ns < offset_ns + duration_ns)
select session, t_ns, file_id, file_time_ns from m where rn = 1""")
def session_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grouped(spark, sf_dir)
    base = g.groupBy("session").agg(F.min("absolute_start_ns").alias("b"))
    files = g.join(base, "session").select("session", "file_id", (F.col("absolute_start_ns") - F.col("b")).alias("offset_ns"), (F.col("absolute_end_ns") - F.col("absolute_start_ns")).alias("duration_ns"))
    probes = base.select("session", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")), lambda i: i * 8_640_000_000_000 * 25)).alias("t_ns"))
    return sessions.positions(probes, files)


# ---- passes -----------------------------------------------------------------------------------------

_FIX_SQL = f"{SAMPLES_SQL}, fx as (select recording_id, event_id, t_ns, case when k % 17 = 0 then 0.0 else 43.0 + k * 1e-4 end as lat, case when k % 17 = 0 then 0.0 else -88.0 + (k * 37 % 100) * 1e-4 end as lon, case when k % 4 = 0 then null else (k % 5)::double end as fix_type, (k % 9)::double as satellites, case when k % 3 = 0 then k / 10.0::double when k % 7 = 0 then 5e6 end as accuracy, case when k % 2 = 0 then (k % 11)::double end as dop from samples)"


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return views.samples(spark, sf_dir).select(
        "recording_id", "event_id", "t_ns", F.col("event_id").alias("local_idx"),
        F.when(k % 17 == 0, 0.0).otherwise(43.0 + k * 1e-4).alias("lat"),
        F.when(k % 17 == 0, 0.0).otherwise(-88.0 + (k * 37 % 100) * 1e-4).alias("lon"),
        F.when(k % 4 != 0, (k % 5).cast("double")).alias("fix_type"),
        (k % 9).cast("double").alias("satellites"),
        F.when(k % 3 == 0, k / 10.0).when(k % 7 == 0, 5e6).cast("double").alias("accuracy"),
        F.when(k % 2 == 0, (k % 11).cast("double")).alias("dop"),
    )


@query(f"""with {_FIX_SQL}, g as (select *, (not (abs(lat) < 1e-7 and abs(lon) < 1e-7)) and (case when fix_type is not null then fix_type >= 2 else satellites >= 4 end) and (accuracy is null or accuracy < 4e6) as valid from fx)
select event_id, valid, round(case when valid then cast(case when accuracy > 0 then accuracy when dop > 0 and dop < 99 then dop * 5 else 15 end as float)::double end, 4) as sigma_m from g""")
def gps_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = passes.grade_fixes(_fixes(spark, sf_dir))
    sigma = F.when(~F.isnan("sigma_m"), F.col("sigma_m").cast("double"))
    return graded.select("event_id", "valid", F.round(sigma, 4).alias("sigma_m"))


@query(f"""with recursive {_FIX_SQL}, fs as (select recording_id, event_id, t_ns // 10000000 as t, lat, lon, not (abs(lat) < 1e-7 and abs(lon) < 1e-7) as sane from fx),
o as (select *, row_number() over (partition by recording_id order by t, event_id) as n from fs),
st as (select recording_id, 0::bigint as n, null::bigint as event_id, null::bigint as t_ns, false as accepted, null::bigint as t, null::double as lat, null::double as lon, 0 as streak from (select distinct recording_id from o)
  union all select recording_id, n, event_id, t2, ok, case when ok then t2 else t end, case when ok then o_lat else lat end, case when ok then o_lon else lon end, case when ok then 0 when sane then streak + 1 else streak end from (
    select s.recording_id, o.n, o.event_id, o.t as t2, o.lat as o_lat, o.lon as o_lon, o.sane, s.t, s.lat, s.lon, s.streak,
      o.sane and (s.t is null or o.t <= s.t or s.streak >= 8 or 6371000.0 * sqrt(pow(radians(o.lon - s.lon) * cos(radians((o.lat + s.lat) * 0.5)), 2) + pow(radians(o.lat - s.lat), 2)) / ((o.t - s.t) / 1e9) <= 150) as ok
    from st s join o on o.recording_id = s.recording_id and o.n = s.n + 1))
select recording_id, event_id, t_ns, accepted from st where n > 0""")
def gps_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = _fixes(spark, sf_dir).withColumn("flag", F.lit(True)).withColumn("t_ns", F.floor(F.col("t_ns") / 10_000_000))
    return passes.clean_fixes(fixes, _BY).select("recording_id", F.col("local_idx").alias("event_id"), "t_ns", "accepted")


@query(f"""with {SAMPLES_SQL}, sp as (select recording_id, event_id, t_ns, case when k % 10 = 0 then null when k % 11 = 0 then -1.0 else value end as raw from samples),
h as (select *, coalesce(last_value(case when raw >= 0 then raw end ignore nulls) over (partition by recording_id order by t_ns, event_id rows between unbounded preceding and current row), 0.0) as s from sp),
g as (select *, (t_ns - lag(t_ns) over w) / 1e9 as dt, coalesce(0.5 * (lag(s) over w + s) * ((t_ns - lag(t_ns) over w) / 1e9), 0.0) as seg from h window w as (partition by recording_id order by t_ns, event_id))
select event_id, round(sum(seg) over u, 2) as odometer_m from g window u as (partition by recording_id order by t_ns, event_id rows unbounded preceding)""")
def odometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    s = views.samples(spark, sf_dir).withColumn("raw", F.when(k % 10 == 0, F.lit(float("nan"))).when(k % 11 == 0, -1.0).otherwise(F.col("value")))
    return passes.odometer(s, _BY, _ORDER, F.col("raw")).select("event_id", F.round("odometer_m", 2).alias("odometer_m"))


@query(f"with {SAMPLES_SQL}, c as (select distinct recording_id, channel_idx, channel from samples) select s.recording_id, s.channel, count(*) as n from samples s where not (s.channel in ('error', 'signup') and s.recording_id % 2 = 0) group by 1, 2")
def pass_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = views.channels(spark, sf_dir), views.samples(spark, sf_dir)
    outputs = c.where("name in ('error', 'signup') and recording_id % 2 = 0").select("recording_id", "name")
    return passes.strip(c, s, outputs)[1].groupBy("recording_id", "channel").agg(F.count(F.lit(1)).alias("n"))


def _as_logger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recordings with a speed, and all but every fourth with positions in degrees."""
    shown = {"view": "Speed", "click": "GPS Latitude", "purchase": "GPS Longitude"}
    to = F.create_map(*[F.lit(x) for pair in shown.items() for x in pair])
    moved = (F.col("recording_id") % 4 != 0) | (F.col("name") == "view")
    c = views.channels(spark, sf_dir).withColumn("unit", F.when(moved & F.col("name").isin("click", "purchase"), "deg").otherwise(F.col("unit")))
    c = c.withColumn("name", F.when(moved, F.coalesce(F.try_element_at(to, F.col("name")), "name")).otherwise(F.col("name")))
    s = views.samples(spark, sf_dir).withColumn("value", F.when(F.col("channel").isin("click", "purchase"), 40 + F.col("k") % 50 * 1e-4).otherwise(F.col("value")))
    return c.drop("steps"), s.select("recording_id", "channel_idx", "chunk_idx", "local_idx", "t_ns", "value")


_PASSES = [("gps.quality", 1), ("gps.clean", 1), ("speed.distance", 1)]
_REGISTRY_SQL = f"""{SAMPLES_SQL}, rec as (select recording_id, recording_id % 4 <> 0 and count(distinct channel) filter (channel in ('click', 'purchase')) = 2 as placed, bool_or(channel = 'view') as fast from samples group by 1),
ps(place, name, version) as (values {", ".join(f"({i}, '{n}', {v})" for i, (n, v) in enumerate(_PASSES))}),
rp as (select recording_id, place, name, version, case when name = 'speed.distance' then case when not fast then 'no speed channel present' end when not placed then 'no GPS coordinate channels present' end as reason from rec, ps)"""


@query(f"with {_REGISTRY_SQL} select recording_id, name, version, case when reason is null then 'applied' else 'skipped' end as outcome, reason from rp")
def pass_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all passes; recordings without positions skip two of them."""
    c, s = _as_logger(spark, sf_dir)
    none = spark.createDataFrame([], "recording_id bigint, name string, version int")
    return passes.apply(c, s, none)[2]


@query(f"""with {_REGISTRY_SQL} select recording_id, cast(row_number() over (partition by recording_id order by place) - 1 as int) as position, name, version,
  case name when 'gps.quality' then 'default_sigma_m=15;min_fix=2;min_satellites=4;sentinel_m=4000000;uere_m=5' when 'gps.clean' then 'max_speed_mps=150;reanchor_after=8' else 'drift_rate=0.005;gap_uncertainty=0.5;max_gap_s=1' end as params from rp where reason is null""")
def pass_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = passes.provenance(pass_registry(spark, sf_dir))
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit("="), p["value"])), ";")
    return told.select("recording_id", "position", "name", "version", params.alias("params"))


# ---- geography --------------------------------------------------------------------------------------

_TRACKS = [("alpha", "Alpha Park", 43.80, -87.99), ("bravo", "Bravo Ring", 50.33, 6.94), ("delta", "Delta Circuit", 35.37, 138.93), ("echo", "Echo Raceway", -37.85, 144.97), ("golf", "Golf Speedway", 27.45, -81.35), ("hotel", "Hotel Field", 43.79, -87.5)]
_TRACKS_SQL = "t(ordinal, slug, name, t_lat, t_lon) as (values " + ", ".join(f"({i}, '{s}', '{n}', {a}::double, {b}::double)" for i, (s, n, a, b) in enumerate(_TRACKS)) + ")"
_HAV_SQL = "2 * 6371000.0 * asin(sqrt(pow(sin(radians(t_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(t_lat)) * pow(sin(radians(t_lon - lon) / 2), 2)))"
_POINTS_SQL = "pt as (select c_custkey, (c_custkey * 37 % 1600) / 10.0::double - 80 as lat, (c_custkey * 91 % 3600) / 10.0::double - 180 as lon from customer)"
_REACH = 3_000_000.0


def _tracks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, n, [n.split()[0]], "UTC", a, b) for i, (s, n, a, b) in enumerate(_TRACKS)], "ordinal int, slug string, name string, aka array<string>, timezone string, latitude double, longitude double")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", ((k * 37 % 1600) / 10.0 - 80).cast("double").alias("lat"), ((k * 91 % 3600) / 10.0 - 180).cast("double").alias("lon"))


@query(f"with {_TRACKS_SQL}, {_POINTS_SQL} select c_custkey, slug, round({_HAV_SQL} / 1000, 3) as km from pt, t")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to all of six fixed places."""
    places = F.array(*[F.struct(F.lit(s).alias("slug"), F.lit(a).alias("a"), F.lit(b).alias("b")) for s, _, a, b in _TRACKS])
    p = _points(spark, sf_dir).withColumn("t", F.explode(places))
    return p.select("c_custkey", "t.slug", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("t.a"), F.col("t.b")) / 1000, 3).alias("km"))


@query(f"with {_TRACKS_SQL}, {_POINTS_SQL}, d as (select c_custkey, slug, ordinal, {_HAV_SQL} as m from pt, t) select c_custkey, arg_min(slug, m) as slug, round(min(m) / 1000, 3) as km from d where m <= {_REACH} group by 1")
def nearest_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.nearest_track(_points(spark, sf_dir), _tracks(spark), _REACH, ["c_custkey"])
    return found.select("c_custkey", "slug", F.round(F.col("distance_m") / 1000, 3).alias("km"))


_LINE = [(43.80, -87.99), (43.81, -87.98), (43.80, -87.96), (43.79, -87.97), (43.80, -87.99)]
_SEGS_SQL = "ln(idx, lat0, lon0) as (values " + ", ".join(f"({i}, {a}::double, {b}::double)" for i, (a, b) in enumerate(_LINE)) + """), sg as (select idx, lat0, lon0, lead(lat0) over (order by idx) as lat1, lead(lon0) over (order by idx) as lon1 from ln),
sl as (select *, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(lat1 - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat1)) * pow(sin(radians(lon1 - lon0) / 2), 2))) as len from sg where lat1 is not null),
sc as (select *, coalesce(sum(len) over (order by idx rows between unbounded preceding and 1 preceding), 0) as cum, sum(len) over () as total from sl)"""


@query(f"""with {_SEGS_SQL}, q as (select c_custkey, 43.79 + (c_custkey * 37 % 1000) / 50000.0::double as lat, -87.99 + (c_custkey * 91 % 1000) / 33000.0::double as lon from customer),
v as (select c_custkey, idx, cum, len, total, (lon0 - lon) * cos(radians(lat)) * 111320.0 as ax, (lat0 - lat) * 110540.0 as ay, (lon1 - lon0) * cos(radians(lat)) * 111320.0 as dx, (lat1 - lat0) * 110540.0 as dy from q, sc),
f as (select *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) as fr from v), g as (select *, sqrt(pow(ax + dx * fr, 2) + pow(ay + dy * fr, 2)) as dist from f)
select c_custkey, round(arg_min((cum + fr * len) / total, dist), 6) as progress, round(min(dist), 3) as distance_m from g group by 1""")
def segment_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.createDataFrame([("alpha", i, a, b) for i, (a, b) in enumerate(_LINE)], "slug string, idx int, lat double, lon double")
    k = F.col("c_custkey")
    pts = read(spark, sf_dir, "customer").select("c_custkey", F.lit("alpha").alias("slug"), (43.79 + (k * 37 % 1000) / 50000.0).alias("lat"), (-87.99 + (k * 91 % 1000) / 33000.0).alias("lon"))
    found = tracks.progress(pts, F.broadcast(tracks.segments(line, ["slug"])), ["slug"], ["c_custkey"])
    return found.select("c_custkey", F.round("progress", 6).alias("progress"), F.round("distance_m", 3).alias("distance_m"))


@query(f"""with {_TRACKS_SQL}, vn as (select distinct case n_nationkey % 5 when 0 then 'Alpha-Park' when 1 then 'bravo' when 2 then 'DELTA circuit  GP' when 3 then 'Ech' else n_name end as venue from nation),
nn as (select venue, trim(regexp_replace(regexp_replace(lower(regexp_replace(venue, '[\\s_-]+', ' ', 'g')), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) as v from vn),
nm as (select ordinal, slug, lower(x) as c from (select ordinal, slug, unnest([name, slug, split_part(name, ' ', 1)]) as x from t))
select venue, arg_min(slug, ordinal) as slug from nn join nm on v = c or starts_with(c, v || ' ') or starts_with(v, c || ' ') group by 1""")
def venue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    v = F.when(k == 0, "Alpha-Park").when(k == 1, "bravo").when(k == 2, "DELTA circuit  GP").when(k == 3, "Ech").otherwise(F.col("n_name"))
    return tracks.venue_track(read(spark, sf_dir, "nation").select(v.alias("venue")), _tracks(spark)).select("venue", "slug")


# ---- normalised samples -----------------------------------------------------------------------------


@query(f"""with {_PROBES_SQL}, x as (select recording_id, channel, t_ns, arg_max(value, event_id) as value from samples where channel in ('view', 'click', 'signup') group by 1, 2, 3),
xn as (select *, lead(t_ns) over w as nt, lead(value) over w as nv from x window w as (partition by recording_id, channel order by t_ns)),
ask as (select p.*, c.channel from probes p, (values ('view'), ('click'), ('signup')) as c(channel)),
got as (select a.recording_id, a.probe, a.t_ns, a.channel, case when a.t_ns < a.duration_ns then case when a.channel <> 'signup' and nt is not null then xn.value + (nv - xn.value) * ((a.t_ns - xn.t_ns)::double / (nt - xn.t_ns)::double) else xn.value end end as v from ask a asof left join xn on a.recording_id = xn.recording_id and a.channel = xn.channel and a.t_ns >= xn.t_ns)
select recording_id, t_ns, round(max(case when channel = 'view' then v end), 6) as speed_mps, round(max(case when channel = 'click' then greatest(0.0, least(1.0, v / 100)) end), 6) as throttle_fraction, round(max(case when channel = 'signup' then v end), 6) as rpm, cast((t_ns + recording_id * 1000000000) % 86400000000000 as bigint) as time_of_day_ns from got group by recording_id, t_ns""")
def normalized_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    c = views.channels(spark, sf_dir).withColumns(
        {"unit": F.when(name == "click", "%").otherwise(F.col("unit")), "name": F.when(name == "view", "Ground Speed").when(name == "click", "Throttle Pos").when(name == "signup", "RPM").otherwise(name)}
    )
    rec = c.select("recording_id").distinct().select("recording_id", F.lit("utc").alias("clock"), (F.col("recording_id") * 1_000_000_000).alias("clock_offset_ns"), F.lit(None).cast("double").alias("length_m"))
    s = views.samples(spark, sf_dir)
    wide = normalize.to_wide(_probes(spark, sf_dir).select("recording_id", "t_ns"), c, s, rec)
    r = lambda x: F.round(x, 6).alias(x)
    return wide.select("recording_id", "t_ns", r("speed_mps"), r("throttle_fraction"), r("rpm"), "time_of_day_ns")


# ---- validation -------------------------------------------------------------------------------------

_CHECK_SQL = f"""{SAMPLES_SQL}, vv as (select recording_id, channel_idx, local_idx, t_ns, unit, case when k % 31 = 0 then null when k % 29 = 0 then 2e15 when k % 23 = 0 then -1e7 else value end as v, count(*) over (partition by recording_id, channel_idx) as n from samples),
vb as (select *, case unit when 'C' then 0.0 when 'bar' then -1e6 when 'rpm' then -30000.0 else -500.0 end as lo, case unit when 'C' then 5000.0 when 'bar' then 1e9 when 'rpm' then 30000.0 else 500.0 end as hi from vv where local_idx % greatest(1, n // 4) = 0),
ck as (select recording_id, channel_idx, count(*) as seen, count(*) filter (v is null) as nonfinite, count(*) filter (abs(v) > 1e15) as absurd, count(*) filter (abs(v) <= 1e15 and (v < lo or v > hi)) as out_of_band, min(t_ns) filter (v is null) as first_nonfinite_ns from vb group by 1, 2)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    v = F.when(k % 31 == 0, float("nan")).when(k % 29 == 0, 2e15).when(k % 23 == 0, -1e7).otherwise(F.col("value"))
    return validate.check_values(views.samples(spark, sf_dir).withColumn("value", v), views.channels(spark, sf_dir), 4)


@query(f"with {_CHECK_SQL} select * from ck")
def validate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("recording_id", "channel_idx", "seen", "nonfinite", "absurd", "out_of_band", "first_nonfinite_ns")


@query(f"with {_CHECK_SQL}, a as (select recording_id, count(*) filter (absurd > 0) as absurd_channels, count(*) as active_channels from ck group by 1) select *, (absurd_channels >= 4 and absurd_channels * 20 >= active_channels) as widespread from a")
def validate_widespread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.widespread(_checked(spark, sf_dir))


@query(f"""with {_CHUNKS_SQL}, cc as (select recording_id, chunk_idx, case when chunk_idx % 7 = 3 then 0 else sample_period_ns end as p, sample_count as n, case when chunk_idx % 5 = 2 then time_base_ns - 50000000 else time_base_ns end as b from chunks), cl as (select *, lag(b + greatest(0, n - 1) * p) over (partition by recording_id order by chunk_idx) as last from cc)
select recording_id, chunk_idx, 'layout.zero_sample_period' as code from cl where p = 0 union all select recording_id, chunk_idx, 'layout.chunk_time_overlap' from cl where b <= last""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("chunk_idx")
    c = _chunks(spark, sf_dir).withColumns({"sample_period_ns": F.when(i % 7 == 3, 0).otherwise(F.col("sample_period_ns")), "time_base_ns": F.when(i % 5 == 2, F.col("time_base_ns") - 50_000_000).otherwise(F.col("time_base_ns"))})
    return validate.check_chunks(c).select("recording_id", "chunk_idx", "code")


@query(f"with {SAMPLES_SQL}, c as (select recording_id, channel_idx, count(*) as n from samples group by 1, 2), f as (select recording_id, cast(sum(n * 8) as bigint) as footprint from c group by 1) select recording_id, footprint, recording_id * 6 % 1000 as file_len, (recording_id * 6 % 1000 > 0 and footprint > recording_id * 6 % 1000) as exceeds from f")
def validate_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.channels(spark, sf_dir)
    return validate.check_footprint(c, c.select("recording_id", (F.col("recording_id") * 6 % 1000).alias("file_len")).distinct())


_DIAG_SQL = f"{SAMPLES_SQL}, dg as (select recording_id, t_ns, event_id, case when k % 10 = 0 then 'error' when k % 3 = 0 then 'warning' else 'info' end as severity, case when k % 20 = 0 then 'layout.footprint_exceeds_file' else 'value.not_finite' end as code from samples)"


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    sev = F.when(k % 10 == 0, "error").when(k % 3 == 0, "warning").otherwise("info")
    return views.samples(spark, sf_dir).select("recording_id", "t_ns", "event_id", sev.alias("severity"), F.when(k % 20 == 0, "layout.footprint_exceeds_file").otherwise("value.not_finite").alias("code"))


@query(f"with {_DIAG_SQL} select recording_id, count(*) filter (severity = 'info') as info, count(*) filter (severity = 'warning') as warning, count(*) filter (severity = 'error') as error, case max(case severity when 'error' then 3 when 'warning' then 2 else 1 end) when 3 then 'error' when 2 then 'warning' else 'info' end as max_severity from dg group by 1")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.severity_summary(_diagnostics(spark, sf_dir))


@query(f"with {_DIAG_SQL} select recording_id, bool_or(code = 'layout.footprint_exceeds_file' and severity in ('warning', 'error')) as fault from dg group by 1")
def decode_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.decode_fault(_diagnostics(spark, sf_dir))


@query(f"with {_DIAG_SQL} select recording_id, event_id, greatest(0, count(*) over (partition by recording_id) - 10) as suppressed from dg qualify row_number() over (partition by recording_id order by t_ns, event_id) <= 10")
def diagnostics_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.capped(_diagnostics(spark, sf_dir), _ORDER, 10).select("recording_id", "event_id", "suppressed")


# ---- lattices, sidecars, video ----------------------------------------------------------------------

_HOUR = 3_600_000_000_000


@query(f"""with {SAMPLES_SQL}, sl as (select recording_id, channel_idx, local_idx, (t_ns + {_HOUR} // 2) // {_HOUR} as slot, case when k % 9 = 0 then null else value end as v from samples),
f as (select recording_id, channel_idx, slot, first(v order by local_idx) as value from sl group by 1, 2, 3), e as (select recording_id, channel_idx, max(slot) as last, count(value) as n from f group by 1, 2)
select s.recording_id, s.channel_idx, s.slot, s.slot * {_HOUR} as t_ns, f.value from (select recording_id, channel_idx, unnest(range(0, last + 1)) as slot from e where n > 0) s left join f on f.recording_id = s.recording_id and f.channel_idx = s.channel_idx and f.slot = s.slot""")
def lattice_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir).withColumn("value", F.when(F.col("k") % 9 == 0, float("nan")).otherwise(F.col("value")))
    s = s.withColumns({"t0_ns": F.lit(0).cast("long"), "period_ns": F.lit(_HOUR).cast("long")})
    return lattice.align(s, None, [*_BY, "channel_idx"]).select("recording_id", "channel_idx", "slot", "t_ns", "value")


@query("select o_custkey as recording_id, list_reduce(list(distinct cast((o_orderkey % 7 + 1) * 250000 as bigint)), lambda a, b: gcd(a, b)) as q_ns from orders group by 1")
def quantum_gcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recording_id"), ((F.col("o_orderkey") % 7 + 1) * 250_000).cast("long").alias("p"))
    return lattice.quantum(v, _BY, "p")


_Q = 10_000_000


@query(f"""with {_COUNTER_SQL}, s as (select recording_id, number, case when (start_ns % {_Q}) * 2 < {_Q} then start_ns - start_ns % {_Q} else start_ns + {_Q} - start_ns % {_Q} end as a, case when (end_ns % {_Q}) * 2 < {_Q} then end_ns - end_ns % {_Q} else end_ns + {_Q} - end_ns % {_Q} end as b, case when duration_ns % {_Q} = 0 then duration_ns else duration_ns + {_Q} - duration_ns % {_Q} end as up from counter)
select recording_id, number, a as start_ns, case when b <= a then a + {_Q} else b end as end_ns, up as duration_up_ns from s""")
def snap_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.lit(_Q)
    held = _counter(spark, sf_dir).withColumn("duration_up_ns", lattice.snap_up(F.col("duration_ns"), q))
    return lattice.snap_intervals(held, q).select("recording_id", "number", "start_ns", "end_ns", "duration_up_ns")


@query(f"""with {SAMPLES_SQL}, g as (select recording_id, recording_id * 1000000 as utc, recording_id * 1000000 + (recording_id % 7) * 1000000000 - 2000000000 as gutc from (select distinct recording_id from samples)),
x as (select s.recording_id, s.channel as name, s.t_ns, s.value, gutc - utc as shift, min(s.t_ns) over (partition by s.recording_id) as first from samples s join g using (recording_id))
select recording_id, name, t_ns + shift as t_ns, value from x where first + shift >= 0 and recording_id % 5 <> 0""")
def sidecar_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All channels as a sidecar with its own clock; every fifth recording has a channel of the same name already."""
    s = views.samples(spark, sf_dir)
    r = F.col("recording_id")
    host = s.select("recording_id").distinct().select("recording_id", (r * 1_000_000).alias("utc_ns"), F.lit("h").alias("schema_hash"), F.when(r % 5 == 0, F.array(F.lit("error"))).otherwise(F.array(F.lit("Speed"))).alias("names"))
    groups = host.select("recording_id", F.lit(0).alias("group_id"), (F.col("utc_ns") + (r % 7) * 1_000_000_000 - 2_000_000_000).alias("utc_ns"), F.lit("h").alias("host_hash"))
    own = s.select("recording_id", F.lit(0).alias("group_id"), F.col("channel").alias("name"), "t_ns", "value")
    return lattice.attach(host, groups, own)[0].select("recording_id", "name", "t_ns", "value")


@query(f"""with {_PROBES_SQL}, fr as (select recording_id, row_number() over (partition by recording_id order by t_ns, event_id) - 1 as frame, t_ns + 5000000 as pts from samples), fd as (select recording_id, pts, max(frame) as frame from fr group by 1, 2),
p as (select recording_id, probe, t_ns, t_ns + (recording_id % 3 - 1) * 104000000 as pts_at from probes)
select p.recording_id, p.probe, p.t_ns, case when pts_at >= 0 then case when fd.frame is not null then fd.frame when p.recording_id in (select recording_id from fr) then 0 end end as frame from p asof left join fd on p.recording_id = fd.recording_id and p.pts_at >= fd.pts""")
def video_frame_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("recording_id").orderBy(*_ORDER)
    fr = views.samples(spark, sf_dir).select("recording_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), (F.col("t_ns") + 5_000_000).alias("pts_ns"))
    pr = _probes(spark, sf_dir).select("recording_id", "probe", "t_ns", ((F.col("recording_id") % 3 - 1) * 104_000_000).alias("offset_ns"))
    return video.frame_at(pr, fr, _BY).select("recording_id", "probe", "t_ns", "frame")


# ---- scans ------------------------------------------------------------------------------------------

_LOG_SQL = "lg as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders)"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("recording_id"), "o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("i"))


@query(f"""with {_LOG_SQL} select o_custkey::varchar as recording_id, name, i * 500000000 as t_ns, case name when 'time' then i * 0.5 when 'velocity' then (o_orderkey % 300)::double when 'Tsample' then 0.5 else case when o_orderkey % 7 = 0 then null else 9 end end::double as value
from lg, (values ('sats'), ('time'), ('velocity'), ('Tsample')) as c(name)""")
def vbo_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sectioned text log per customer, a row per order, parsed back to samples; unparsable numbers are null here."""
    from paddock.sources import vbo

    at = 120_000 + F.col("i") * 0.5
    line = F.format_string("%s %.1f %d 0.5", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise("9"), at, F.col("o_orderkey") % 300)
    body = _numbered(spark, sf_dir).groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("x")))), lambda r: r["x"]), "\n").alias("b"))
    files = body.select("recording_id", F.concat(F.lit("[column names]\nsats time velocity Tsample\n[data]\n"), "b").alias("text"))
    c, s, _ = vbo.parse(files)
    met = s.join(c.select("recording_id", "channel_idx", "name"), ["recording_id", "channel_idx"])
    return met.select("recording_id", "name", "t_ns", F.when(~F.isnan("value"), F.col("value")).alias("value"))


@query(f"""with {_LOG_SQL} select o_custkey::varchar as recording_id, i as local_idx, i * 10000000 as t_ns, case when o_orderkey % 5 = 0 then null else (o_orderkey % 300) / 4.0::double end as value from lg""")
def mtj_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line-oriented recording per customer, written as text and parsed back; missing values are null here."""
    from paddock.sources import jsonl

    v = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 300) / 4.0)
    rows = _numbered(spark, sf_dir).select("recording_id", F.lit("Speed").alias("name"), F.lit("m/s").alias("unit"), F.col("i").alias("slot"), v.alias("value"))
    ids = rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))
    lat = ids.select("recording_id", F.lit("Speed").alias("name"), F.lit(0).cast("long").alias("t0_ns"), F.lit(10_000_000).cast("long").alias("period_ns"))
    head = ids.select("recording_id", F.lit(10_000_000).cast("long").alias("q_ns"), (F.col("n") * 10_000_000).alias("dur_ns"))
    none = spark.createDataFrame([], "recording_id string, number bigint, start_ns bigint, end_ns bigint, complete boolean")
    s = jsonl.parse(jsonl.to_lines(rows, lat, none, head))["samples"]
    return s.select("recording_id", "local_idx", "t_ns", F.when(~F.isnan("value"), F.col("value")).alias("value"))


@query("""with m as (select o_custkey::varchar as recording_id, (row_number() over (partition by o_custkey order by o_orderkey)) * 10000000000 + (o_orderkey % 9) * 1000000000 as t_ns from orders),
d as (select *, lead(t_ns) over w - t_ns as gap, row_number() over w as i from m window w as (partition by recording_id order by t_ns))
select recording_id, count(*) + 1 as total_laps, min(gap) as fastest_ns, arg_min(i + 1, gap * 100000 + i) as fastest_lap from d group by 1""")
def ldx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lap sidecars written as XML from markers and read back."""
    from paddock.sources import ldx

    m = _numbered(spark, sf_dir).select("recording_id", ((F.col("i") + 1) * 10_000_000_000 + (F.col("o_orderkey") % 9) * 1_000_000_000).alias("t_ns"))
    return ldx.parse(ldx.to_xml(m)).select("recording_id", F.col("total_laps").cast("long").alias("total_laps"), "fastest_ns", "fastest_lap")
