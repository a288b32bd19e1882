"""Registered queries of binary loggers, grouped sidecars and opening files, with their DuckDB forms."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.plans import fixtures, views
from paddock.plans.queries import _LOG_SQL, _numbered, query
from paddock.plans.views import SAMPLES_SQL, read
from paddock.session import materialize, ship, spread
from paddock.sources import aimd, opening, sidecar


def _files(rows: DataFrame, build: Callable[[dict[str, np.ndarray]], bytes]) -> DataFrame:
    """recording_id, content: one file of each recording's columns in order of i, built once."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"recording_id": b["recording_id"], "content": [build(dict(zip(held, of))) for of in zip(*[b[c] for c in held])]})

    held = [c for c in rows.columns if c != "recording_id"]
    each = F.array_sort(F.collect_list(F.struct("i", *[c for c in held if c != "i"])))
    gathered = spread(rows, "recording_id").groupBy("recording_id").agg(each.alias("rows")).select("recording_id", *[F.col("rows")[c].alias(c) for c in held])
    return materialize(gathered.mapInPandas(run, "recording_id string, content binary"))


# ---- camera recordings ------------------------------------------------------------------------------


def _camera(rows: dict[str, np.ndarray]) -> bytes:
    head = fixtures.packet(
        fixtures.definition(5, "Speed", 4, encoding=12), fixtures.definition(7, "Gear", 1), fixtures.definition(9, "Lap Number", 4, group=0x1003), fixtures.definition(11, "RPM", 4), fixtures.definition(12, "Wide", 8),
    )
    packets = [head]
    for k, i in zip(rows["o_orderkey"], rows["i"]):
        at = 1000 + 10 * int(i) + int(k) % 3
        packets.append(fixtures.packet(
            fixtures.scalar(at, 5, struct.pack("<i", int(k) % 2000 - 1000)), fixtures.scalar(at, 7, bytes([int(k) % 7])), fixtures.scalar(at, 9, struct.pack("<I", int(i) // 3)),
            fixtures.scalar(at, 99, b"(S)"), fixtures.scalar(at + 1, 11, struct.pack("<f", int(k) % 800 / 4)),
        ))
    return fixtures.camera(packets)


_CAMERA_SQL = f"""{_LOG_SQL}, st as (select o_custkey::varchar as recording_id, o_orderkey as k, i, 1000 + 10 * i + o_orderkey % 3 as stamp, count(*) over (partition by o_custkey) as n, first_value(1000 + 10 * i + o_orderkey % 3) over (partition by o_custkey order by i) as origin from lg),
cv as (select st.*, name, (stamp + case name when 'RPM' then 1 else 0 end - origin) * 1000000 as t_ns, case name when 'Speed' then k % 2000 - 1000 when 'Gear' then k % 7 when 'Lap Number' then i // 3 else (k % 800) / 4.0 end::double as value from st, (values ('Speed'), ('Gear'), ('Lap Number'), ('RPM')) as c(name))"""


def _named(raw: DataFrame, index: bool) -> DataFrame:
    names = aimd.channels(raw).select("recording_id", "channel_idx", "name")
    return aimd.samples(raw, index).join(names.hint("merge"), ["recording_id", "channel_idx"]).select("recording_id", "name", "local_idx", "t_ns", "value")


@query(f"with {_CAMERA_SQL} select recording_id, name, i as local_idx, t_ns, value from cv")
def aimd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera recording per customer, a packet an order, read back on the logger's stamps."""
    return _named(_files(_numbered(spark, sf_dir), _camera), False)


@query(f"""with {_CAMERA_SQL}, pk as (select distinct recording_id, case when least(n, 19) <= 1 then 1 else 1 + ((n - 1) * slot) // (least(n, 19) - 1) end as p from st, range(0, 19) as r(slot) where slot < least(n, 19)),
kept as (select cv.* from cv left join pk on pk.recording_id = cv.recording_id and pk.p = cv.i + 1 where name = 'Lap Number' or pk.p is not null)
select recording_id, name, row_number() over (partition by recording_id, name order by t_ns) - 1 as local_idx, t_ns, value from kept""")
def aimd_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files in index mode: whole lap channels, evenly spaced packets of the others."""
    return _named(_files(_numbered(spark, sf_dir), _camera), True)


@query("""select column0 as recording_id, channel_idx, id, name, sample_type from (values (0, 5, 'Speed', 'i32'), (1, 7, 'Gear', 'u8'), (2, 9, 'Lap Number', 'u32'), (3, 11, 'RPM', 'f32')) as c(channel_idx, id, name, sample_type),
(select distinct o_custkey::varchar as column0 from orders)""")
def aimd_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aimd.channels(_files(_numbered(spark, sf_dir), _camera)).select("recording_id", "channel_idx", "id", "name", "sample_type")


_ROUNDS = "g0 as (select *, atan2(z, p * (1 - 6.69437999014e-3::double)) as lat, 0.0::double as alt from gp)"
for _i in range(8):
    _ROUNDS += f""", n{_i} as (select * exclude (alt), 6378137.0::double / sqrt(1 - 6.69437999014e-3::double * pow(sin(lat), 2)) as n from g{_i}), a{_i} as (select *, p / cos(lat) - n as alt from n{_i}),
g{_i + 1} as (select * exclude (lat, n), atan2(z, p * (1 - 6.69437999014e-3::double * n / (n + alt))) as lat from a{_i})"""


@query(f"""with c as (select c_custkey, c_custkey % 6 as fix, case when c_custkey % 5 = 0 then 0 else c_custkey * 37 % 4001 - 2000 end as vx, case when c_custkey % 5 = 0 then 0 else c_custkey * 53 % 3001 - 1500 end as vy, case when c_custkey % 5 = 0 then 0 else c_custkey % 101 - 50 end as vz from customer),
gp as (select c_custkey, (20000000 + c_custkey * 7919 % 900000) / 100.0::double as x, (-455000000 + c_custkey * 104729 % 9000000) / 100.0::double as y, (440000000 + c_custkey * 1299709 % 900000) / 100.0::double as z, sqrt(x * x + y * y) as p, atan2(y, x) as lon, vx / 100.0::double as vx, vy / 100.0::double as vy, vz / 100.0::double as vz from c where fix in (2, 3, 4)),
{_ROUNDS}, h as (select *, -sin(lon) * vx + cos(lon) * vy as e, -sin(lat) * cos(lon) * vx - sin(lat) * sin(lon) * vy + cos(lat) * vz as no from g8), t as (select *, degrees(atan2(e, no)) as d from h)
select c_custkey, round(degrees(lat), 7) as latitude, round(degrees(lon), 7) as longitude, round(alt, 3) as altitude, round(sqrt(vx * vx + vy * vy + vz * vz), 6) as speed, round(case when sqrt(e * e + no * no) < 0.01 then 0 when d < 0 then d + 360 else d end, 5) as heading from t
union all select c_custkey, null, null, null, null, null from c where fix not in (2, 3, 4)""")
def gps_geodetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earth-centred fixes as positions, speeds and headings; null here where the fix isn't good."""
    k = F.col("c_custkey")
    moving = lambda v: F.when(k % 5 == 0, 0).otherwise(v)
    rows = read(spark, sf_dir, "customer").select(k.cast("long").alias("c_custkey")).withColumns({
        "fix": k % 6, "x": 20_000_000 + k * 7919 % 900_000, "y": -455_000_000 + k * 104_729 % 9_000_000, "z": 440_000_000 + k * 1_299_709 % 900_000,
        "vx": moving(k * 37 % 4001 - 2000), "vy": moving(k * 53 % 3001 - 1500), "vz": moving(k % 101 - 50),
        **{c: F.lit(0).cast("long") for c in ("position_cm", "speed_cm", "itow_ms", "dop")},
    })
    shown = lambda c, n: F.when(F.col("fix").isin(2, 3, 4), F.round(c, n)).alias(c)
    return aimd.geodetic(rows).select("c_custkey", shown("latitude", 7), shown("longitude", 7), shown("altitude", 3), shown("speed", 6), shown("heading", 5))


_STAMPS_SQL = f"""{SAMPLES_SQL}, s0 as (select recording_id::varchar as recording_id, channel_idx, t_ns // 1000000 * 1000000 as t_ns, local_idx from samples),
d0 as (select *, t_ns - lag(t_ns) over (partition by recording_id, channel_idx order by local_idx) as gap from s0), dc as (select recording_id, channel_idx, gap, count(*) as n from d0 where gap > 0 group by 1, 2, 3),
md as (select recording_id, channel_idx, gap as modal from dc qualify row_number() over (partition by recording_id, channel_idx order by n desc, gap) = 1),
rn as (select d0.*, coalesce(modal, 1) as modal, sum(case when gap > coalesce(modal, 1) * 2 then 1 else 0 end) over (partition by d0.recording_id, d0.channel_idx order by local_idx) as run from d0 left join md using (recording_id, channel_idx))"""


@query(f"""with recursive {_STAMPS_SQL}, piece as (
  select recording_id, channel_idx, min(local_idx) as lo, max(local_idx) as hi, any_value(modal) as modal, 0 as cut, 0 as depth from rn group by recording_id, channel_idx, run
  union all
  select recording_id, channel_idx, unnest([lo, cut_at]) as lo, unnest([cut_at - 1, hi]) as hi, modal, 1, depth + 1 from (
    select p.recording_id, p.channel_idx, p.lo, p.hi, p.modal, p.depth, arg_min(s.local_idx, (-abs(s.t_ns - (b.t_ns + greatest(1, (e.t_ns - b.t_ns + (p.hi - p.lo) // 2) // (p.hi - p.lo)) * (s.local_idx - p.lo))), s.local_idx)) as cut_at,
      max(abs(s.t_ns - (b.t_ns + greatest(1, (e.t_ns - b.t_ns + (p.hi - p.lo) // 2) // (p.hi - p.lo)) * (s.local_idx - p.lo)))) as worst
    from piece p join s0 s on s.recording_id = p.recording_id and s.channel_idx = p.channel_idx and s.local_idx between p.lo and p.hi join s0 b on b.recording_id = p.recording_id and b.channel_idx = p.channel_idx and b.local_idx = p.lo
      join s0 e on e.recording_id = p.recording_id and e.channel_idx = p.channel_idx and e.local_idx = p.hi where p.hi > p.lo group by 1, 2, 3, 4, 5, 6) where worst > greatest(1, modal // 2) and cut_at > lo),
-- a piece that was cut has a smaller one with the same start
last as (select recording_id, channel_idx, lo, min(hi) as hi, any_value(modal) as modal from piece group by 1, 2, 3),
ends as (select l.*, b.t_ns as t0, e.t_ns as t1 from last l join s0 b on b.recording_id = l.recording_id and b.channel_idx = l.channel_idx and b.local_idx = l.lo join s0 e on e.recording_id = l.recording_id and e.channel_idx = l.channel_idx and e.local_idx = l.hi)
select recording_id, channel_idx, row_number() over (partition by recording_id, channel_idx order by lo) - 1 as chunk_idx, cast(case when hi = lo then modal else greatest(1, (t1 - t0 + (hi - lo) // 2) // (hi - lo)) end as bigint) as sample_period_ns, hi - lo + 1 as sample_count, lo as sample_base, t0 as time_base_ns from ends""")
def clock_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight pieces of the recordings' millisecond stamps."""
    s = views.samples(spark, sf_dir).select(F.col("recording_id").cast("string").alias("recording_id"), "channel_idx", "local_idx", (F.floor(F.col("t_ns") / 1_000_000).cast("long") * 1_000_000).alias("t_ns"))
    return aimd.fit_chunks(s)


@query("""with v as (select c_custkey, c_custkey % 4 + 2 as n, c_custkey % 3 * 500 as empty, c_custkey % 5 * 300 as media from customer),
f as (select c_custkey, i, i * 3003 as ticks, case when i < n then 3003 * (i % 2) else -1500 end as shift, empty, media, 2 * n as m from v, range(0, 12) as r(i) where i < 2 * n),
p as (select c_custkey, i, cast(trunc((ticks + case when i < m // 2 then 1001 else -2002 end) * 1000000000::hugeint / 90000) as bigint) as t0, case when c_custkey % 7 = 0 then 0 else empty * 1000000000 // 1000 - media * 1000000000 // 90000 end as shown from f)
select c_custkey::varchar as recording_id, row_number() over (partition by c_custkey order by t0 + shown, i) - 1 as frame, cast(t0 + shown as bigint) as pts_ns from p where t0 + shown >= 0""")
def video_frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentation times from run-length tables and edit lists of a video a customer."""

    def build(held: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in held:
            rows = []
            for k in b["c_custkey"]:
                k = int(k)
                n = k % 4 + 2
                edits = [(k % 3 * 500, -1), (9000, k % 5 * 300)] if k % 7 else None
                rows.append(fixtures.camera([fixtures.packet()], (90_000, [(n, 3003), (n, 3003)], [(n, 1001), (n, -2002)], edits)))
            yield pd.DataFrame({"recording_id": b["c_custkey"].astype(str), "content": rows})

    ship(spark)
    raw = read(spark, sf_dir, "customer").select("c_custkey").mapInPandas(build, "recording_id string, content binary")
    return aimd.frame_times(aimd.tracks(raw))


# ---- grouped sidecars -------------------------------------------------------------------------------


def _sidecars(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A sidecar a customer with a group for even and odd orders, a span an order; written and read back."""
    k, i = F.col("o_orderkey"), F.col("i")
    rows = _numbered(spark, sf_dir).withColumn("group", (i % 2).cast("int"))
    kinds = F.when(k % 4 == 0, F.struct(F.lit("gap").alias("name"), F.lit(None).cast("string").alias("text"), (k % 90_000).cast("long").alias("ms"))).otherwise(
        F.struct(F.lit("note").alias("name"), F.when(k % 4 == 1, F.lit("1:02.345")).otherwise(F.concat(F.lit('a "b" '), k)).alias("text"), F.lit(None).cast("long").alias("ms"))
    )
    spans = rows.select(
        "recording_id", "group", F.concat(F.lit("s"), k).alias("name"), (i * 1_000_000_000 + k % 7 * 1_000_000).cast("long").alias("start_ns"), (i * 1_000_000_000 + 500_000_000 + k % 5 * 1_000_000).cast("long").alias("end_ns"), (k % 3 != 0).alias("visible"),
        F.when(k % 5 == 0, "#00Ff7f").otherwise("").alias("color"), F.when(k % 2 == 0, "T").otherwise("").alias("title"), F.lit("").alias("subtitle"), F.array(kinds).alias("meta"),
    )
    groups = rows.select("recording_id", "group").distinct().select(
        "recording_id", "group", F.concat(F.lit("g"), F.col("group")).alias("name"), F.lit(10_000_000).cast("long").alias("q_ns"), F.lit(1_000_000_000).cast("long").alias("duration_ns"), F.lit(1_700_000_000_000_000_000).cast("long").alias("utc_start_ns"), F.lit("Europe/Berlin").alias("timezone"), F.lit(True).alias("visible"),
    )
    return sidecar.parse(materialize(sidecar.to_lines(groups, spans)))


@query(f"""with {_LOG_SQL}, s as (select o_custkey::varchar as recording_id, (i % 2)::int as "group", 's' || o_orderkey as name, o_orderkey as k, i * 1000000000 + o_orderkey % 7 * 1000000 as a, i * 1000000000 + 500000000 + o_orderkey % 5 * 1000000 as b from lg)
select recording_id, "group", name, cast((a + 5000000) // 10000000 * 10000000 as bigint) as start_ns, cast((b + 5000000) // 10000000 * 10000000 as bigint) as end_ns, k % 3 <> 0 as visible, case when k % 5 = 0 then '#00Ff7f' else '' end as color, case when k % 2 = 0 then 'T' else '' end as title,
case when k % 4 = 0 then 'gap' else 'note' end as meta_name, case when k % 4 in (2, 3) then 'a "b" ' || k end as meta_text, case when k % 4 = 0 then k % 90000 when k % 4 = 1 then 62345 end::bigint as meta_ms from s""")
def sidecar_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.element_at("meta", 1)
    return _sidecars(spark, sf_dir)["spans"].select("recording_id", "group", "name", "start_ns", "end_ns", "visible", "color", "title", m["name"].alias("meta_name"), m["text"].alias("meta_text"), m["ms"].alias("meta_ms"))


@query(f"""with {_LOG_SQL}, s as (select o_custkey::varchar as recording_id, (i % 2)::int as "group", i * 1000000000 + 500000000 + o_orderkey % 5 * 1000000 as b from lg)
select recording_id, "group", 'g' || "group" as name, 10000000::bigint as q_ns, cast(greatest(1000000000, max((b + 5000000) // 10000000 * 10000000)) as bigint) as duration_ns, 1700000000000000000 as utc_start_ns, 'Europe/Berlin' as timezone, true as visible from s group by 1, 2""")
def sidecar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sidecars(spark, sf_dir)["groups"].select("recording_id", "group", "name", "q_ns", "duration_ns", "utc_start_ns", "timezone", "visible")


@query("""with l as (select c_custkey, c_custkey % 8 as k from customer)
select c_custkey, case k when 1 then 'gauge' when 2 then 'compass' when 3 then null else 'trace' end as plot, case when k = 4 then 5.0 when k = 5 then 1.5 end::double as low, case when k = 4 then 2.0 end::double as high, case k when 6 then 16 when 2 then 3 end::int as decimals,
case k when 3 then 'plt' when 4 then 'sc' when 6 then 'rnd' when 7 then 'fmt' end as problem from l""")
def channel_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 8
    line = F.when(k == 1, '{"plt":"g"}').when(k == 2, '{"plt":"compass","rnd":3}').when(k == 3, '{"plt":"bar"}').when(k == 4, '{"sc":[5,2]}').when(k == 5, '{"sc":[1.5,null]}').when(k == 6, '{"rnd":16}').when(k == 7, '{"fmt":"0.0 C"}').otherwise("{}")
    d = read(spark, sf_dir, "customer").select("c_custkey", sidecar.display(line).alias("d"))
    return d.select("c_custkey", "d.plot", "d.low", "d.high", "d.decimals", "d.problem")


# ---- opening ----------------------------------------------------------------------------------------


def _opened(spark: SparkSession, sf_dir: str, metadata: bool) -> dict[str, DataFrame]:
    """Text logs of even customers and camera recordings of odd ones, opened as one set of tables."""
    rows = _numbered(spark, sf_dir)
    even = F.col("recording_id").cast("long") % 2 == 0
    line = F.format_string("9 %.1f %d 0.5", 120_000 + F.col("i") * 0.5, F.col("o_orderkey") % 300)
    body = rows.where(even).groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("x")))), lambda r: r["x"]), "\n").alias("b"))
    texts = materialize(body.select("recording_id", F.concat(F.lit("[column names]\nsats time velocity Tsample\n[data]\n"), "b").alias("text")))
    return opening.tables({"vbo": texts, "aimd": _files(rows.where(~even), _camera)}, metadata)


@query(f"""with {_LOG_SQL}, n as (select o_custkey, count(*) as n from lg group by 1)
select o_custkey::varchar as recording_id, name, n as sample_count from n, (values (0, 'sats'), (0, 'time'), (0, 'velocity'), (0, 'Tsample'), (1, 'Speed'), (1, 'Gear'), (1, 'Lap Number'), (1, 'RPM')) as c(odd, name) where odd = o_custkey % 2""")
def open_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opened(spark, sf_dir, False)["channels"].select("recording_id", "name", "sample_count")


@query(f"""with {_CAMERA_SQL} select recording_id, i // 3 as number, t_ns as start_ns, i + 3 < n as complete from cv where name = 'Lap Number' and i % 3 = 0 and i >= 3 and recording_id::bigint % 2 = 1""")
def open_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps recovered in metadata mode from the recordings that have a lap counter."""
    return _opened(spark, sf_dir, True)["laps"].select("recording_id", "number", "start_ns", "complete")


def _lapped(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A recording a customer, by the customer's number in fives.

    0: text with a lap counter and a timer that resets half a second before it; 1: with the timer alone; 3: with a counter
    that never moves and the timer. 2: lines with a declared lap, a counter that isn't asked and a declared clock; 4: lines
    without declared laps, with a counter and a channel of Unix seconds.
    """
    k, i = F.col("recording_id").cast("long") % 5, F.col("i")
    rows = _numbered(spark, sf_dir)
    s = 43_200 + 4 * i
    at = F.floor(s / 3600) * 10_000 + F.floor(s % 3600 / 60) * 100 + s % 60
    counter = F.when(k == 0, F.floor(i / 3) + 1).otherwise(5)
    timer = F.when(i < 3, 4.0 * i).otherwise(i % 3 * 4 + 0.5)
    line = F.when(k.isin(0, 1, 3), F.format_string("9 %06d %d 4.0 %d %.1f", at, F.floor(i / 4) % 2 + 1, counter, timer)).otherwise((1_600_000_000 + i).cast("string"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("x")))), lambda r: r["x"])
    # files are built once; what reads them goes through them more than once
    body = materialize(spread(rows, "recording_id").groupBy("recording_id").agg(held.alias("x"), F.count(F.lit(1)).alias("n")))
    head = F.concat(F.lit("File created on 31/07/2006 at 09:55:20\n[column names]\nsats time driver Tsample "), F.when(k == 1, "Other").otherwise("Lap"), F.lit(" laptime\n[data]\n"))
    texts = body.where(k.isin(0, 1, 3)).select("recording_id", F.concat(head, F.array_join("x", "\n")).alias("text"))
    clock = F.when(k == 2, ',"clk":"utc","abs":1500000000000000000,"hint":"h","utc":1700000000000000000,"tz":"Europe/Berlin","drv":"D"').otherwise("")
    first = F.concat(F.lit('{"mtj":1,"q":10000000,"dur":'), (F.col("n") * 1_000_000_000).cast("string"), clock, F.lit("}"))
    counts = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda v: v.cast("string")), ",")
    lines = F.array(
        first, F.when(k == 2, "[[7,0,20000000,1]]").otherwise("[]"), F.concat(F.lit('{"n":"Lap","hz":1,"v":['), counts, F.lit("]}")),
        F.concat(F.lit('{"n":"Unix Time","u":"s","hz":1,"v":['), F.array_join("x", ","), F.lit("]}")),
    )
    plain = body.where(k.isin(2, 4)).select("recording_id", F.posexplode(lines).alias("n", "line"))
    return opening.tables({"vbo": texts, "plain": plain})


_LAPPED_SQL = f"""{_LOG_SQL}, nn as (select o_custkey as k, count(*) as n, (count(*) - 1) // 3 as last from lg group by 1), mm as (select *, unnest(range(0, last + 1)) as m from nn),
found as (select k, case when k % 5 = 3 then 5 else m + 1 end::bigint as number, case m when 0 then 0 else 12000000000 * m - 500000000 end::bigint as start_ns, case when m < last then 12000000000 * (m + 1) - 500000000 else 4000000000 * n end::bigint as end_ns,
    m > 0 and m < last as complete, case when n <= 3 then 'constant' when k % 5 = 0 then 'counter' else 'timer' end as origin from mm where k % 5 in (0, 1, 3) and (n > 3 or k % 5 <> 1)
  union all select k, 7, 0, 20000000, true, 'authoritative' from nn where k % 5 = 2)"""


@query(f"with {_LAPPED_SQL} select k::varchar as recording_id, number, start_ns, end_ns, complete, origin from found")
def laps_by_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps by the best origin of each recording: declared, counter with a timer, timer, a counter that stands."""
    return _lapped(spark, sf_dir)["laps"].select("recording_id", "number", "start_ns", "end_ns", "complete", "origin")


@query(f"""with {_LAPPED_SQL}, l as (select k, count(*) as laps, count_if(complete) as valid_laps, arg_min(number, (end_ns - start_ns, start_ns)) filter (complete) as fastest, min(end_ns - start_ns) filter (complete) as fastest_ns from found group by 1),
d as (select o_custkey as k, string_agg(distinct (i // 4 % 2 + 1)::bigint::varchar, ',' order by (i // 4 % 2 + 1)::bigint::varchar) as drivers from lg group by 1)
select k::varchar as recording_id, case when k % 5 in (0, 1, 3) then 6 else 2 end::bigint as n_channels, case when k % 5 in (0, 1, 3) then 6 else 2 end * n as samples, case when k % 5 in (0, 1, 3) then 'time_of_day' when k % 5 = 2 or n > 1 then 'utc' end as clock,
case when k % 5 in (0, 1, 3) then 43200000000000 when k % 5 = 2 then 1500000000000000000 when n > 1 then 1600000000000000000 end::bigint as absolute_start_ns,
case when k % 5 in (0, 1, 3) then 43200000000000 + 4000000000 * n when k % 5 = 2 then 1500000000000000000 + 1000000000 * n when n > 1 then 1600000000000000000 + 1000000000 * (n - 1) end::bigint as absolute_end_ns,
case when k % 5 in (0, 1, 3) then 'vbo:time_of_day' when k % 5 = 2 then 'h' when n > 1 then 'utc:18518' end as session_hint, case when k % 5 = 2 then 1700000000000000000 end as utc_start_ns, case when k % 5 in (0, 1, 3) then '31/07/2006' end as date,
case when k % 5 in (0, 1, 3) then drivers else '' end as drivers, coalesce(laps, 0) as laps, coalesce(valid_laps, 0) as valid_laps, fastest, fastest_ns from nn left join l using (k) left join d using (k)""")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of facts a recording, its clock and laps by precedence; the schema hash within the session key has a query of its own."""
    told = opening.file_metadata(_lapped(spark, sf_dir))
    return told.select(
        "recording_id", "n_channels", "samples", "clock", "absolute_start_ns", "absolute_end_ns", F.regexp_extract("session_key", "^(.*):[0-9a-f]{16}$", 1).alias("session_hint"), "utc_start_ns", "date", F.array_join("driver_ids", ",").alias("drivers"),
        "laps", "valid_laps", F.col("fastest_lap.number").alias("fastest"), F.col("fastest_lap.duration_ns").alias("fastest_ns"),
    )
