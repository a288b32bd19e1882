"""Comparing two openings of the same recordings, channel by channel and sample by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """One row per recording and channel of either side: how its samples agree.

    Both have channels (recording_id, channel_idx, name, unit, sample_type) and samples (recording_id,
    channel_idx, local_idx, t_ns, value). Channels meet by name, those of one name in order of channel_idx;
    samples by local_idx. Columns: recording_id, name, nth, verdict (equal, differs, left_only, right_only),
    unit_differs, type_differs, left_samples, right_samples, differing (samples at other times or values, or
    on one side only), first_difference (its local_idx), first_difference_ns, max_delta (of values on both sides). NaN
    equals NaN and null equals null.
    """
    by = ["recording_id", "name", "nth"]

    def side(tables: dict[str, DataFrame], mark: str) -> tuple[DataFrame, DataFrame]:
        order = F.array_sort(F.collect_list(F.struct("channel_idx", "unit", "sample_type")))
        held = tables["channels"].groupBy("recording_id", "name").agg(order.alias("c")).select("recording_id", "name", F.posexplode("c").alias("nth", "c"))
        named = held.select(*by, F.col("c.channel_idx").alias("channel_idx"), F.col("c.unit").alias(f"{mark}_unit"), F.col("c.sample_type").alias(f"{mark}_type"), F.lit(True).alias(f"{mark}_here"))
        rows = tables["samples"].join(named.select(*by, "channel_idx"), ["recording_id", "channel_idx"]).select(*by, "local_idx", F.col("t_ns").alias(f"{mark}_t"), F.col("value").alias(f"{mark}_v"), F.lit(1).alias(f"{mark}_n"))
        return named.drop("channel_idx"), rows

    (left_named, left_rows), (right_named, right_rows) = side(left, "left"), side(right, "right")
    met = left_rows.join(right_rows, [*by, "local_idx"], "full_outer")
    same = F.col("left_n").isNotNull() & F.col("right_n").isNotNull() & F.col("left_t").eqNullSafe(F.col("right_t")) & F.col("left_v").eqNullSafe(F.col("right_v"))
    at = F.struct("local_idx", F.coalesce("left_t", "right_t").alias("t"))
    delta = F.abs(F.col("left_v") - F.col("right_v"))
    counted = met.groupBy(*by).agg(
        F.count("left_n").alias("left_samples"), F.count("right_n").alias("right_samples"), F.count_if(~same).alias("differing"), F.min(F.when(~same, at)).alias("first"), F.max(F.when(~F.isnan(delta), delta)).alias("max_delta"),
    )
    named = left_named.join(right_named, by, "full_outer").join(counted, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    unit, kind = ~F.col("left_unit").eqNullSafe(F.col("right_unit")), ~F.col("left_type").eqNullSafe(F.col("right_type"))
    both = F.col("left_here").isNotNull() & F.col("right_here").isNotNull()
    verdict = F.when(F.col("right_here").isNull(), "left_only").when(F.col("left_here").isNull(), "right_only").when((F.coalesce("differing", F.lit(0)) > 0) | unit | kind, "differs").otherwise("equal")
    return named.select(
        *by, verdict.alias("verdict"), (both & unit).alias("unit_differs"), (both & kind).alias("type_differs"), zero("left_samples"), zero("right_samples"), zero("differing"),
        F.col("first.local_idx").alias("first_difference"), F.col("first.t").alias("first_difference_ns"), "max_delta",
    )
