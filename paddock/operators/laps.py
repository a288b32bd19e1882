"""Lap recovery: counters, timers, their choice and refinement, interval statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.geo import finite
from paddock.functions.names import COMPLETED_COUNTERS, PROGRESS, ROLES, normalize
from paddock.operators.runs import whole

#: How far a counter's crossing may lie from a timer's reset of the same beacon; the shortest fastest lap.
SNAP_NS, LEAST_LAP_NS = 1_500_000_000, 10_000_000_000
_LAP = ("number", "start_ns", "end_ns", "duration_ns", "complete")


def counter_laps(samples: DataFrame, by: list[str], order: list[str], duration: Column, completed: Column | None = None) -> DataFrame:
    """by, number, start_ns, end_ns, duration_ns, complete, crossings from counters that only count upwards.

    A crossing is a value above all before; falls are passed over. The first interval began before the
    recording and the last runs on to ``duration``: both are incomplete. ``completed`` marks counters of
    finished laps, whose lap is one further. Numbers below 1 and empty intervals go.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    v = samples.withColumn("_v", whole(F.col("value"))).where("_v >= 0").withColumns({"_d": duration, "_up": (completed if completed is not None else F.lit(False)).cast("int")})
    top = F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marks = v.withColumn("_top", top).where(F.col("_top").isNull() | (F.col("_v") > F.col("_top")))
    every = Window.partitionBy(*by)
    laps = marks.select(
        *by,
        (F.col("_v") + F.col("_up")).alias("number"),
        F.col("t_ns").alias("start_ns"),
        F.coalesce(F.lead("t_ns").over(w), F.col("_d")).alias("end_ns"),
        (F.col("_top").isNotNull() & F.lead("t_ns").over(w).isNotNull()).alias("complete"),
        (F.count(F.lit(1)).over(every) - 1).alias("crossings"),
    )
    return laps.where("number > 0 and end_ns > start_ns").withColumn("duration_ns", F.col("end_ns") - F.col("start_ns")).select(*by, *_LAP, "crossings")


def select_counter(laps: DataFrame, channels: DataFrame) -> DataFrame:
    """Of each recording's counters (laps with channel_idx) the laps of one: two crossings and more first, most crossings, name, place."""
    rank = F.array_position(F.array(*[F.lit(n) for n in ROLES["lap_number"]]), normalize(F.col("name")))
    named = laps.select("recording_id", "channel_idx", "crossings").distinct().join(channels.select("recording_id", "channel_idx", rank.alias("_rank")), ["recording_id", "channel_idx"]).where("_rank > 0")
    tier = F.when(F.col("crossings") >= 2, 0).when(F.col("crossings") == 1, 1).otherwise(2)
    best = F.min_by("channel_idx", F.struct(tier, F.when(F.col("crossings") >= 2, -F.col("crossings")).otherwise(0), "_rank", "channel_idx"))
    return laps.join(named.groupBy("recording_id").agg(best.alias("channel_idx")), ["recording_id", "channel_idx"], "left_semi")


def completed_counter(name: Column) -> Column:
    return normalize(name).isin(*COMPLETED_COUNTERS)


def timer_resets(samples: DataFrame, by: list[str], order: list[str], progress: Column) -> DataFrame:
    """by, t_ns: where a running lap timer falls back, or a lap progress wraps.

    A timer above 1000 counts milliseconds. It falls by more than five seconds; what it then reads has
    passed since the beacon, so the beacon lies that much earlier. Progress falls from three quarters of
    a lap to one; above 2 it is in percent.
    """
    w, every = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
    ok = F.when(finite(F.col("value")), F.col("value"))
    v = samples.withColumn("_p", progress).select(*by, *dict.fromkeys(["t_ns", *(c for c in order if c not in by)]), "value", "_p", F.greatest(F.lit(0.0), F.max(ok).over(every)).alias("_most"))
    v = v.withColumn("_before", F.lag("value").over(w)).where(finite(F.col("_before")) & finite(F.col("value")))
    full = F.when(F.col("_most") > 2, 100.0).otherwise(1.0)
    wraps = F.col("_p") & (F.col("_before") >= full * 0.75) & (F.col("value") <= full * 0.25)
    ms = F.col("_most") > 1000
    falls = ~F.col("_p") & (F.col("_before") - F.col("value") > F.when(ms, 5000.0).otherwise(5.0))
    elapsed = F.round(F.greatest(F.lit(0.0), F.col("value")) * F.when(ms, 1e6).otherwise(1e9)).cast("long")
    at = F.when(F.col("_p"), F.col("t_ns")).otherwise(F.greatest(F.lit(0).cast("long"), F.col("t_ns") - elapsed))
    return v.where(wraps | falls).select(*by, at.alias("t_ns"))


def timer_laps(resets: DataFrame, durations: DataFrame, by: list[str]) -> DataFrame:
    """Laps between resets, from 0 to duration_ns; the inner ones are complete. Recordings without a reset have none."""
    w, every = Window.partitionBy(*by).orderBy("_k"), Window.partitionBy(*by)
    n = F.row_number().over(Window.partitionBy(*by).orderBy("t_ns"))
    inner = resets.select(*by, "t_ns", n.alias("_k"))
    edges = resets.select(*by).distinct().join(durations.select(*by, "duration_ns"), by)
    first = edges.select(*by, F.lit(0).cast("long").alias("t_ns"), F.lit(0).alias("_k"))
    bounds = first.unionByName(inner).join(edges, by)
    laps = bounds.select(
        *by,
        (F.col("_k") + 1).cast("long").alias("number"),
        F.col("t_ns").alias("start_ns"),
        F.coalesce(F.lead("t_ns").over(w), F.col("duration_ns")).alias("end_ns"),
        ((F.col("_k") > 0) & (F.col("_k") + 1 < F.count(F.lit(1)).over(every))).alias("complete"),
    )
    return laps.where("end_ns >= start_ns").withColumn("duration_ns", F.col("end_ns") - F.col("start_ns")).select(*by, *_LAP)


def is_progress(name: Column) -> Column:
    return normalize(name).isin(*PROGRESS)


def _nearest(points: DataFrame, resets: DataFrame, by: list[str], reach: int) -> DataFrame:
    """``points`` (by, _id, t_ns) with ``snapped``: the nearest reset within reach, the earlier at a tie, else t_ns."""
    from paddock.operators.sampling import asof

    met = asof(points, resets.select(*by, "t_ns", F.col("t_ns").alias("at")), by, value="at")
    before, after = F.col("t_ns") - F.col("before_v"), F.col("after_v") - F.col("t_ns")
    near = F.when((before <= reach) & (after.isNull() | (before <= after)), F.col("before_v")).when(after <= reach, F.col("after_v"))
    return met.select(*by, "_id", F.coalesce(near, F.col("t_ns")).alias("snapped"))


def refine(laps: DataFrame, timer: DataFrame, by: list[str], reach: int = SNAP_NS) -> DataFrame:
    """Counter laps with their boundaries moved to the nearest timer reset; the recording's own edges stay."""
    resets = timer.where("complete or start_ns > 0").select(*by, F.col("start_ns").alias("t_ns")).distinct()
    w, back = Window.partitionBy(*by).orderBy("start_ns", "number"), Window.partitionBy(*by).orderBy(F.desc("start_ns"), F.desc("number"))
    held = laps.withColumns({"_id": F.row_number().over(w), "_tail": (F.row_number().over(back) == 1) & ~F.col("complete")}).withColumn("_head", (F.col("_id") == 1) & ~F.col("complete"))
    starts = _nearest(held.select(*by, "_id", F.col("start_ns").alias("t_ns")), resets, by, reach).withColumnRenamed("snapped", "_s")
    ends = _nearest(held.select(*by, "_id", F.col("end_ns").alias("t_ns")), resets, by, reach).withColumnRenamed("snapped", "_e")
    moved = held.join(starts, [*by, "_id"]).join(ends, [*by, "_id"]).withColumns(
        {"start_ns": F.when(F.col("_head"), F.col("start_ns")).otherwise(F.col("_s")), "end_ns": F.when(F.col("_tail"), F.col("end_ns")).otherwise(F.col("_e"))}
    )
    return moved.where("end_ns > start_ns").withColumn("duration_ns", F.col("end_ns") - F.col("start_ns")).select(*by, *_LAP)


def pick(authoritative: DataFrame, counter: DataFrame, refined: DataFrame, timer: DataFrame, by: list[str]) -> DataFrame:
    """Per recording the laps of the best origin: declared, counter with crossings (refined), timer, constant counter."""
    ranked = None
    for rank, (origin, laps) in enumerate((("authoritative", authoritative), ("counter", refined), ("timer", timer), ("constant", counter))):
        one = laps.select(*by, *_LAP).withColumns({"origin": F.lit(origin), "_rank": F.lit(rank)})
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.withColumn("_best", F.min("_rank").over(Window.partitionBy(*by))).where("_rank = _best").select(*by, *_LAP, "origin")


def reference_lap_ns(samples: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, reference_ns: the first positive value of a reference lap channel; above 1000 it counts milliseconds."""
    v = F.col("value")
    scale = F.when(F.max(F.when(finite(v), v)) > 1000, 1e6).otherwise(1e9)
    first = F.min_by(v, F.when(finite(v) & (v > 0), F.struct(*order)))
    return samples.groupBy(*by).agg(F.round(first * scale).cast("long").alias("reference_ns"))


def fastest_lap(laps: DataFrame, by: list[str], reference: DataFrame | None = None) -> DataFrame:
    """The shortest complete lap of ten seconds or more, within half to one and a half of the reference lap if there is one."""
    held = laps.where(F.col("complete") & (F.col("duration_ns") >= LEAST_LAP_NS))
    if reference is not None:
        r = F.col("reference_ns")
        held = held.join(reference, by, "left").where(r.isNull() | ((F.col("duration_ns") >= F.floor(r / 2)) & (F.col("duration_ns") <= F.floor(r * 3 / 2))))
    best = F.min_by(F.struct(*_LAP), F.struct("duration_ns", "start_ns")).alias("lap")
    return held.groupBy(*by).agg(best).select(*by, "lap.*")


def lap_statistics(samples: DataFrame, laps: DataFrame, by: list[str], channel: str = "channel_idx") -> DataFrame:
    """max_value, min_value, mean_value, n of finite samples per complete lap and channel; laps are half-open.

    Laps don't overlap, so each sample has at most one: the last that began, found by filling forward.
    """
    from paddock.operators.sampling import asof

    starts = laps.where("complete").select(*by, F.col("start_ns").alias("t_ns"), F.struct("number", "start_ns", "end_ns").alias("lap"))
    v = samples.where(finite(F.col("value"))).select(*by, channel, "t_ns", "value")
    met = asof(v, starts, by, value="lap").select(*by, channel, "t_ns", "value", F.col("before_v").alias("lap")).where(F.col("t_ns") < F.col("lap.end_ns"))
    return met.groupBy(*by, F.col("lap.number").alias("number"), F.col("lap.start_ns").alias("start_ns"), F.col("lap.end_ns").alias("end_ns"), channel).agg(
        F.max("value").alias("max_value"), F.min("value").alias("min_value"), F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n")
    )


def beacon_edges(samples: DataFrame, by: list[str], order: list[str], pulse: bool) -> DataFrame:
    """by, t_ns: rises from 0 or less to above 0 (pulse), or values above all before."""
    w = Window.partitionBy(*by).orderBy(*order)
    if pulse:
        v = samples.withColumn("_before", F.lag("value").over(w))
        hit = finite(F.col("value")) & finite(F.col("_before")) & (F.col("value") > 0) & (F.col("_before") <= 0)
    else:
        v = samples.withColumn("_v", whole(F.col("value"))).where("_v >= 0")
        v = v.withColumn("_before", F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        hit = F.col("_v") > F.col("_before")
    return v.where(hit & (F.col("t_ns") > 0)).select(*by, "t_ns")


def beacon_markers(edges: DataFrame, by: list[str], spacing_ns: int = 5_000_000_000) -> DataFrame:
    """Edges at least ``spacing_ns`` after the last kept one: a fold over the few edges of a recording."""
    kept = F.aggregate(
        F.array_sort(F.collect_list("t_ns")),
        F.array().cast("array<bigint>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.try_element_at(acc, F.lit(-1)) >= spacing_ns), F.concat(acc, F.array(t))).otherwise(acc),
    )
    return edges.groupBy(*by).agg(kept.alias("_kept")).select(*by, F.explode("_kept").alias("t_ns"))
