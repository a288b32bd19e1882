"""Plausibility: values, chunks, footprint; diagnostics with stable codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.geo import finite
from paddock.functions.units import band

ABSURD, BUDGET, RETAINED = 1e15, 256, 1024
_FAULTS = ("layout.footprint_exceeds_file", "value.widespread_absurd_magnitude")


def check_values(samples: DataFrame, channels: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Per channel: seen, nonfinite, absurd, out_of_band, extreme, and when each was first seen.

    Every (sample_count div budget)-th sample of each chunk is looked at. Bands are in the channel's own unit.
    """
    key = ["recording_id", "channel_idx"]
    named = channels.select(*key, "sample_count", band(F.col("unit")).alias("band"))
    stride = F.greatest(F.lit(1), F.floor(F.col("sample_count") / budget))
    v = samples.join(named, key).where(F.col("local_idx") % stride == 0)
    ok = finite(F.col("value"))
    absurd = ok & (F.abs("value") > ABSURD)
    out = ok & ~absurd & ((F.col("value") < F.col("band.low")) | (F.col("value") > F.col("band.high")))
    order = F.struct("chunk_idx", "local_idx")
    first = lambda hit: F.min_by("t_ns", F.when(hit, order))
    size = F.when(ok, F.struct(F.abs("value"), -F.col("chunk_idx"), -F.col("local_idx")))
    return v.groupBy(*key).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(~ok).alias("nonfinite"),
        F.count_if(absurd).alias("absurd"),
        F.count_if(F.coalesce(out, F.lit(False))).alias("out_of_band"),
        F.coalesce(F.max_by("value", size), F.lit(0.0)).alias("extreme"),
        first(~ok).alias("first_nonfinite_ns"),
        first(absurd).alias("first_absurd_ns"),
        first(F.coalesce(out, F.lit(False))).alias("first_out_of_band_ns"),
    )


def widespread(checked: DataFrame) -> DataFrame:
    """recording_id, absurd_channels, active_channels, widespread: four absurd channels and a twentieth of the active ones."""
    n = F.count_if(F.col("absurd") > 0)
    return checked.groupBy("recording_id").agg(n.alias("absurd_channels"), F.count(F.lit(1)).alias("active_channels"), ((n >= 4) & (n * 20 >= F.count(F.lit(1)))).alias("widespread"))


def check_chunks(chunks: DataFrame) -> DataFrame:
    """recording_id, channel_idx, chunk_idx, code for chunks without a period or that start by the last sample before."""
    w = Window.partitionBy("recording_id", "channel_idx").orderBy("chunk_idx")
    last = F.col("time_base_ns") + F.greatest(F.lit(0), F.col("sample_count") - 1) * F.col("sample_period_ns")
    before = F.lag(last).over(w)
    codes = F.array(
        F.when(F.col("sample_period_ns") == 0, F.lit("layout.zero_sample_period")),
        F.when(F.col("time_base_ns") <= before, F.lit("layout.chunk_time_overlap")),
    )
    return chunks.withColumn("code", codes).select("recording_id", "channel_idx", "chunk_idx", F.explode(F.filter("code", lambda c: c.isNotNull())).alias("code"))


def check_footprint(channels: DataFrame, file_len: DataFrame) -> DataFrame:
    """recording_id, footprint, file_len, exceeds: whether the channels claim more bytes than the file has."""
    width = F.element_at(F.create_map(*[F.lit(x) for p in {"i8": 1, "u8": 1, "i16": 2, "u16": 2, "i32": 4, "u32": 4, "f32": 4, "f64": 8}.items() for x in p]), F.col("sample_type"))
    held = channels.groupBy("recording_id").agg(F.sum(F.col("sample_count") * width).alias("footprint"))
    return held.join(file_len, "recording_id").select("recording_id", "footprint", "file_len", ((F.col("file_len") > 0) & (F.col("footprint") > F.col("file_len"))).alias("exceeds"))


def decode_fault(diagnostics: DataFrame) -> DataFrame:
    """recording_id, fault: whether a diagnostic tells that the file was read with a wrong layout."""
    return diagnostics.groupBy("recording_id").agg(F.bool_or(F.col("code").isin(*_FAULTS) & F.col("severity").isin("warning", "error")).alias("fault"))


def severity_summary(diagnostics: DataFrame) -> DataFrame:
    """Per recording how many of each severity, and the greatest."""
    rank = F.array_position(F.array(F.lit("info"), F.lit("warning"), F.lit("error")), F.col("severity"))
    return diagnostics.groupBy("recording_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("info", "warning", "error")], F.max_by("severity", rank).alias("max_severity"))


def capped(diagnostics: DataFrame, order: list[str], cap: int = RETAINED) -> DataFrame:
    """The first ``cap`` diagnostics of a recording, each with how many more there were."""
    w = Window.partitionBy("recording_id")
    n = diagnostics.withColumns({"_n": F.row_number().over(w.orderBy(*order)), "suppressed": F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - cap)})
    return n.where(F.col("_n") <= cap).drop("_n")
