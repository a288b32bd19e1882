"""File summaries, schema hashes, clocks of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.clock import gps_ns
from paddock.functions.geo import finite
from paddock.functions.names import ROLES, find
from paddock.session import spread

# Codes of sample types; parameters of the 64-bit FNV-1a hash.
TYPE_CODES = {"i8": 0, "u8": 1, "i16": 2, "u16": 3, "i32": 4, "u32": 5, "f32": 6, "f64": 7}
_FNV_START, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_HALF = 0xFFFFFFFF


def fnv1a(data: Column) -> Column:
    """The 64-bit FNV-1a hash of ``data`` (binary) as 16 hex digits, folded over its bytes.

    The state is two halves of 32 bits. The prime is 2^40 and a small number, so the products of the halves
    fit in 64 bits and what passes bit 64 is cut off by hand.
    """
    small = _FNV_PRIME & _HALF
    high, low = "hi", "lo"
    pair = lambda h, l: F.struct(h.cast("long").alias(high), l.cast("long").alias(low))
    digits = F.hex(data)
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))

    def step(acc: Column, b: Column) -> Column:
        mixed = acc[low].bitwiseXOR(b)
        product = mixed * small
        return pair((acc[high] * small + F.shiftright(product, 32) + F.shiftleft(mixed, 8)).bitwiseAND(F.lit(_HALF)), product.bitwiseAND(F.lit(_HALF)))

    start = pair(F.lit(_FNV_START >> 32), F.lit(_FNV_START & _HALF))
    hexed = lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))
    return F.when(F.octet_length(data) > 0, F.aggregate(bytes_, start, step, lambda acc: F.concat(hexed(acc[high]), hexed(acc[low])))).otherwise(F.when(data.isNotNull(), f"{_FNV_START:016x}"))


def schema_hash(channels: DataFrame) -> DataFrame:
    """recording_id, schema_hash (16 hex digits) over the channels in order: name and unit in lower case, type."""
    code = F.element_at(F.create_map(*[F.lit(x) for p in TYPE_CODES.items() for x in p]), F.col("sample_type"))
    part = F.concat(F.lower("name"), F.lit("\x00"), F.lower("unit"), F.lit("\x00"), F.chr(code), F.lit("\x00"))
    # a fold over every byte: a few megabytes of channels are the work of all cores
    joined = spread(channels, "recording_id").groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("channel_idx", part.alias("p")))), lambda x: x["p"]), "").cast("binary").alias("_s"))
    return joined.select("recording_id", fnv1a(F.col("_s")).alias("schema_hash"))


def file_summary(channels: DataFrame) -> DataFrame:
    """channel counts, sample counts and duration per recording."""
    return channels.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("channels"), F.count_if(F.col("sample_count") > 0).alias("sampled_channels"), F.sum("sample_count").alias("samples"), F.coalesce(F.max("duration_ns"), F.lit(0)).alias("duration_ns")
    )


def gps_clock(channels: DataFrame, samples: DataFrame) -> DataFrame:
    """recording_id, week, absolute_start_ns, absolute_end_ns, clock_offset_ns from GPS week and time of week."""
    key = ["recording_id", "channel_idx"]
    order = F.struct("chunk_idx", "local_idx")
    ok = finite(F.col("value")) & (F.col("value") >= 0)
    week = samples.join(find(channels, ROLES["gps_week"]), key).groupBy("recording_id").agg(F.round(F.min_by("value", F.when(ok, order))).cast("long").alias("week"))
    itow = samples.join(find(channels, ROLES["gps_itow"]), key).groupBy("recording_id").agg(
        F.min_by(F.struct("t_ns", "value"), order).alias("a"), F.max_by(F.struct("t_ns", "value"), order).alias("b")
    )
    met = week.join(itow, "recording_id").where(finite(F.col("a.value")) & finite(F.col("b.value")) & F.col("week").isNotNull())
    start, end = gps_ns(F.col("week"), F.round("a.value").cast("long")), gps_ns(F.col("week"), F.round("b.value").cast("long"))
    return met.select("recording_id", "week", start.alias("absolute_start_ns"), end.alias("absolute_end_ns"), (start - F.col("a.t_ns")).alias("clock_offset_ns"))


def unix_clock(samples: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, absolute_start_ns, absolute_end_ns, clock_offset_ns of channels of Unix seconds that are credible.

    Two values or more, all within 2000 to 2100, never falling, and as fast as the samples within two
    seconds or two per cent.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    v = samples.where(finite(F.col("value"))).withColumn("_fell", F.col("value") < F.lag("value").over(w))
    at = F.struct(*order)
    held = v.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.coalesce(F.bool_or("_fell"), F.lit(False)).alias("fell"),
        F.min_by(F.struct("t_ns", "value"), at).alias("a"),
        F.max_by(F.struct("t_ns", "value"), at).alias("b"),
    )
    span = (F.col("b.t_ns") - F.col("a.t_ns")) / 1e9
    credible = (F.col("n") >= 2) & (F.col("lo") >= 946_684_800.0) & (F.col("hi") <= 4_102_444_800.0) & ~F.col("fell") & (F.abs(F.col("b.value") - F.col("a.value") - span) <= F.greatest(span * 0.02, F.lit(2.0)))
    start = F.round(F.col("a.value") * 1e9).cast("long")
    return held.where(credible).select(*by, start.alias("absolute_start_ns"), F.round(F.col("b.value") * 1e9).cast("long").alias("absolute_end_ns"), (start - F.col("a.t_ns")).alias("clock_offset_ns"))
