"""Runs of equal values, driver stints, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.geo import finite


def whole(v: Column) -> Column:
    """The nearest integer, halves away from zero; null unless finite and in range."""
    return F.when(finite(v), F.round(v)).try_cast("bigint")


def integer_runs(samples: DataFrame, by: list[str], order: list[str], duration: Column) -> DataFrame:
    """by, run, value, start_ns, end_ns: runs of consecutive equal rounded values; other values are passed over.

    ``duration`` is a column of ``samples``, constant within ``by``; the last run ends there, or at its start.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    v = samples.withColumn("_v", whole(F.col("value"))).where("_v is not null").withColumn("_d", duration)
    starts = v.withColumn("_before", F.lag("_v").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("_v")))
    return starts.select(
        *by,
        F.row_number().over(w).alias("run"),
        F.col("_v").alias("value"),
        F.col("t_ns").alias("start_ns"),
        F.coalesce(F.lead("t_ns").over(w), F.greatest("_d", "t_ns")).alias("end_ns"),
    )


def driver_stints(runs: DataFrame, by: list[str], least_ns: int = 1_000_000_000) -> DataFrame:
    """Runs of drivers: short runs go unless there is but one, negative ids go; neighbours aren't merged again."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    kept = runs.withColumn("_n", n).where((F.col("_n") == 1) | (F.col("end_ns") - F.col("start_ns") >= least_ns))
    return kept.where("value >= 0").select(*by, F.col("value").alias("driver_id"), "start_ns", "end_ns")


def histogram(samples: DataFrame, by: list[str]) -> DataFrame:
    """How often each rounded value occurs."""
    return samples.withColumn("driver_id", whole(F.col("value"))).where("driver_id is not null").groupBy(*by, "driver_id").agg(F.count(F.lit(1)).alias("n"))
