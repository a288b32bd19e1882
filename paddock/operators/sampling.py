"""Point-in-time sampling: sample clocks, backward as-of joins by step and by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand_chunks(chunks: DataFrame) -> DataFrame:
    """One row per sample of constant-rate runs: chunk columns, local_idx, global_idx, t_ns."""
    n = F.col("sample_count")
    return chunks.where(n > 0).withColumn("local_idx", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).select(
        *[c for c in chunks.columns if c != "sample_count"],
        "local_idx",
        (F.col("sample_base") + F.col("local_idx")).alias("global_idx"),
        (F.col("time_base_ns") + F.col("local_idx") * F.col("sample_period_ns")).alias("t_ns"),
    )


def asof(probes: DataFrame, samples: DataFrame, by: list[str], value: str = "value", t: str = "t_ns", order: tuple[str, ...] = ()) -> DataFrame:
    """``probes`` with before_t, before_v (last sample not after the probe) and after_t, after_v (the next one).

    Probes and samples are laid in one order and filled over it, so the work is one shuffle on ``by`` and
    one sort, linear in both sides. At equal times samples come first; ``order`` breaks their ties.
    """
    extra = [c for c in probes.columns if c not in (*by, t)]
    none = lambda c: F.lit(None).cast(samples.schema[c].dataType).alias(c)
    left = samples.select(*by, t, F.lit(0).alias("_side"), *[F.col(c) for c in order], F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("_s"), F.lit(None).cast(probes.select(F.struct(*extra or [t])).schema[0].dataType).alias("_p"))
    right = probes.select(*by, t, F.lit(1).alias("_side"), *[none(c) for c in order], F.lit(None).cast(left.schema["_s"].dataType).alias("_s"), F.struct(*extra or [t]).alias("_p"))
    w = Window.partitionBy(*by).orderBy(t, "_side", *order)
    met = left.unionByName(right).select(
        *by,
        t,
        "_p",
        "_side",
        F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_before"),
        F.first("_s", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    return met.where("_side = 1").select(
        *by, t, *[F.col(f"_p.{c}") for c in extra], F.col("_before.t").alias("before_t"), F.col("_before.v").alias("before_v"), F.col("_after.t").alias("after_t"), F.col("_after.v").alias("after_v")
    )


def interpolated(t: Column, linear: Column) -> Column:
    """The value at ``t`` of an ``asof`` row: on the line to the next sample, or held."""
    span = F.col("after_t") - F.col("before_t")
    on_line = F.col("before_v") + (F.col("after_v") - F.col("before_v")) * F.try_divide((t - F.col("before_t")).cast("double"), span.cast("double"))
    return F.when(linear & F.col("after_t").isNotNull() & (span > 0), on_line).otherwise(F.col("before_v"))


def sample_at(probes: DataFrame, samples: DataFrame, channels: DataFrame, linear: bool = True) -> DataFrame:
    """``value`` of a channel at each probe (recording_id, channel_idx, t_ns), for explicit clocks and grids without gaps.

    Null before the first sample and from the channel's duration on. ``channels`` has the flag ``steps``.
    """
    key = ["recording_id", "channel_idx"]
    met = asof(probes, samples, key, order=("chunk_idx", "local_idx")).join(channels.select(*key, "duration_ns", "steps"), key)
    got = F.when(F.col("t_ns") < F.col("duration_ns"), interpolated(F.col("t_ns"), F.lit(linear) & ~F.col("steps")))
    return met.withColumn("value", got).drop("before_t", "before_v", "after_t", "after_v", "duration_ns", "steps")


def sample_at_grid(probes: DataFrame, chunks: DataFrame, samples: DataFrame, channels: DataFrame, linear: bool = True) -> DataFrame:
    """The same for grids with gaps: in a gap the first sample of the next chunk counts.

    Each probe belongs to the first chunk that ends after it, found as an as-of join on chunk ends; the
    sample's place in it is arithmetic, and its value an equi-join.
    """
    key = ["recording_id", "channel_idx"]
    w = Window.partitionBy(*key).orderBy("chunk_idx")
    ends = chunks.select(
        *key,
        (F.col("time_base_ns") + F.col("sample_count") * F.col("sample_period_ns")).alias("t_ns"),
        F.struct("chunk_idx", "time_base_ns", "sample_count", "sample_period_ns", F.lead(F.struct("chunk_idx", "time_base_ns")).over(w).alias("next"), F.min("time_base_ns").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first_ns")).alias("c"),
    )
    #: The next end strictly after the probe: ends sort before probes at equal times.
    met = asof(probes, ends, key, value="c").select(*[c for c in probes.columns], F.col("after_v").alias("c"))
    period = F.when(F.col("c.sample_period_ns") > 0, F.col("c.sample_period_ns"))
    relative = F.greatest(F.lit(0), F.col("t_ns") - F.col("c.time_base_ns"))
    local = F.least(F.floor(relative / period), F.col("c.sample_count") - 1)
    inner = local + 1 < F.col("c.sample_count")
    at = F.col("c.time_base_ns") + local * period
    placed = met.select(
        *probes.columns,
        F.when(F.col("t_ns") >= F.col("c.first_ns"), F.col("c.chunk_idx")).alias("_chunk"),
        local.alias("_local"),
        at.alias("_at"),
        F.when(inner, F.col("c.chunk_idx")).otherwise(F.col("c.next.chunk_idx")).alias("_chunk2"),
        F.when(inner, local + 1).otherwise(0).alias("_local2"),
        F.when(inner, at + period).otherwise(F.col("c.next.time_base_ns")).alias("_at2"),
    )
    one = samples.select(*[F.col(k).alias(f"_{k}1") for k in key], F.col("chunk_idx").alias("_c1"), F.col("local_idx").alias("_l1"), F.col("value").alias("before_v"))
    two = samples.select(*[F.col(k).alias(f"_{k}2") for k in key], F.col("chunk_idx").alias("_c2"), F.col("local_idx").alias("_l2"), F.col("value").alias("after_v"))
    same = lambda n: (F.col("recording_id") == F.col(f"_recording_id{n}")) & (F.col("channel_idx") == F.col(f"_channel_idx{n}"))
    valued = (
        placed.join(one, same(1) & (F.col("_chunk") == F.col("_c1")) & (F.col("_local") == F.col("_l1")), "left")
        .join(two, same(2) & (F.col("_chunk2") == F.col("_c2")) & (F.col("_local2") == F.col("_l2")), "left")
        .withColumnsRenamed({"_at": "before_t", "_at2": "after_t"})
        .join(channels.select(*key, "duration_ns", "steps"), key)
    )
    after = F.col("after_v").isNotNull()
    at_least = F.greatest("t_ns", "before_t")
    got = F.when(F.col("t_ns") < F.col("duration_ns"), interpolated(at_least, F.lit(linear) & ~F.col("steps") & after))
    return valued.select(*probes.columns, got.alias("value"))
