"""Telemetry-shaped views over the driver's tables, in Spark and as DuckDB SQL.

Events are samples: a user is a recording, an event type a channel, the JSON counter ``k`` a counter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.session import prepare

#: Channel numbers of the event types, and the units that they are taken to have.
CHANNELS = {"click": (0, "km/h"), "error": (1, "bar"), "purchase": (2, "C"), "signup": (3, "rpm"), "view": (4, "m/s")}
#: What a recording lasts beyond its last sample.
TAIL_NS = 1_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, channel, channel_idx, chunk_idx, local_idx, t_ns, value, k, duration_ns."""
    w = Window.partitionBy("user_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    held = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", at.alias("at"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    number = F.create_map(*[F.lit(x) for n, (i, _) in CHANNELS.items() for x in (n, i)])
    order = Window.partitionBy("user_id", "event_type").orderBy("at", "event_id")
    return held.select(
        F.col("user_id").alias("recording_id"),
        F.col("event_type").alias("channel"),
        F.element_at(number, F.col("event_type")).alias("channel_idx"),
        F.lit(0).alias("chunk_idx"),
        (F.row_number().over(order) - 1).cast("long").alias("local_idx"),
        (F.col("at") - F.min("at").over(w)).alias("t_ns"),
        "value",
        "k",
        (F.max("at").over(w) - F.min("at").over(w) + TAIL_NS).alias("duration_ns"),
        "event_id",
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels of the recordings of ``samples``, with units."""
    unit = F.create_map(*[F.lit(x) for n, (_, u) in CHANNELS.items() for x in (n, u)])
    return samples(spark, sf_dir).groupBy("recording_id", "channel_idx", "channel").agg(F.count(F.lit(1)).alias("sample_count"), F.max("duration_ns").alias("duration_ns")).select(
        "recording_id", "channel_idx", F.col("channel_idx").alias("id"), F.col("channel").alias("name"), F.element_at(unit, F.col("channel")).alias("unit"), F.lit("declared").alias("unit_source"), F.lit("f64").alias("sample_type"), "sample_count", "duration_ns", F.lit(False).alias("steps")
    )


_CASE = " ".join(f"when '{n}' then {i}" for n, (i, _) in CHANNELS.items())
_UNIT = " ".join(f"when '{n}' then '{u}'" for n, (_, u) in CHANNELS.items())
#: The same views as common table expressions.
SAMPLES_SQL = f"""ev as (
  select user_id as recording_id, event_type as channel, event_id, value,
         cast(regexp_extract(props, '"k": *([0-9]+)', 1) as bigint) as k,
         (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) * 1000 as t_ns,
         (max(epoch_us(ts)) over (partition by user_id) - min(epoch_us(ts)) over (partition by user_id)) * 1000 + {TAIL_NS} as duration_ns
  from events),
samples as (
  select *, case channel {_CASE} end as channel_idx, case channel {_UNIT} end as unit,
         row_number() over (partition by recording_id, channel order by t_ns, event_id) - 1 as local_idx
  from ev)"""
