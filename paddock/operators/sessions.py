"""Sessions: files joined by key and clock gap, laps and stints merged across files, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group(files: DataFrame, max_gap_ns: int) -> DataFrame:
    """``files`` (file_id, session_key, absolute_start_ns, absolute_end_ns) with session_no within the key.

    A file joins the one before it (by start) if it starts by that one's end and the gap; not by the
    furthest end so far. Files without a key or a start stay alone.
    """
    w = Window.partitionBy("session_key").orderBy(F.col("absolute_start_ns").asc_nulls_first(), "file_id")
    joins = F.col("session_key").isNotNull() & (F.col("absolute_start_ns") <= F.lag("absolute_end_ns").over(w) + max_gap_ns)
    flagged = files.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    #: Files without a key are told apart by themselves, so that no task gets them all.
    lone = flagged.where("session_key is null").withColumn("session_no", F.lit(1).cast("long"))
    keyed = flagged.where("session_key is not null").withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return keyed.unionByName(lone).withColumn("session", F.when(F.col("session_key").isNull(), F.concat(F.lit("unkeyed:"), F.col("file_id").cast("string"))).otherwise(F.concat_ws(":", F.col("session_key").cast("string"), F.col("session_no")))).drop("_new")


def summary(grouped: DataFrame) -> DataFrame:
    """session, files, absolute_start_ns, absolute_end_ns, duration_ns."""
    return grouped.groupBy("session").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("absolute_start_ns", "file_id"))), lambda x: x["file_id"]).alias("files"),
        F.min("absolute_start_ns").alias("absolute_start_ns"),
        F.max("absolute_end_ns").alias("absolute_end_ns"),
        F.coalesce(F.max("absolute_end_ns") - F.min("absolute_start_ns"), F.lit(0)).alias("duration_ns"),
    )


def merge(parts: DataFrame, label: str, max_gap_ns: int) -> DataFrame:
    """Merge neighbouring ``parts`` (session, label, start_ns, end_ns) of one label within the gap.

    Neighbours are in order of start. An island's end is the furthest of its parts.
    """
    w = Window.partitionBy("session").orderBy("start_ns", "end_ns", label)
    #: The label's own run, then the furthest end within it, decide what joins.
    runs = parts.withColumn("_turn", F.when(F.lag(label).over(w) == F.col(label), 0).otherwise(1)).withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("session", "_run").orderBy("start_ns", "end_ns")
    furthest = F.max("end_ns").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("_gap", F.when(furthest.isNull() | (F.col("start_ns") > furthest + max_gap_ns), 1).otherwise(0)).withColumn("_island", F.sum("_gap").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("session", "_run", "_island", label).agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")).drop("_run", "_island")


def merge_laps(laps: DataFrame, max_gap_ns: int) -> DataFrame:
    """Laps of a session's files merged by number; all but the first and last are complete."""
    merged = merge(laps, "number", max_gap_ns)
    w, back = Window.partitionBy("session").orderBy("start_ns", "number"), Window.partitionBy("session").orderBy(F.desc("start_ns"), F.desc("number"))
    return merged.select("session", "number", "start_ns", "end_ns", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"), ((F.row_number().over(w) > 1) & (F.row_number().over(back) > 1)).alias("complete"))


def positions(probes: DataFrame, files: DataFrame) -> DataFrame:
    """file_id and file_time_ns at each probe (session, t_ns): the first file whose interval covers it.

    ``files`` has session, file_id, offset_ns (from the session's base), duration_ns. Files of a session
    are few; the join is on the session with the interval as residual.
    """
    covers = (F.col("t_ns") >= F.col("offset_ns")) & (F.col("t_ns") < F.col("offset_ns") + F.col("duration_ns"))
    f = files.withColumnRenamed("session", "_session")
    met = probes.join(f, (F.col("session") == F.col("_session")) & covers)
    first = F.min_by(F.struct("file_id", (F.col("t_ns") - F.col("offset_ns")).alias("file_time_ns")), F.struct("offset_ns", "file_id"))
    return met.groupBy("session", "t_ns").agg(first.alias("p")).select("session", "t_ns", "p.*")
