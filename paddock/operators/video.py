"""Video: frames and presentation times at recording times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.operators.sampling import asof


def presentation_ns(t: Column, offset: Column) -> Column:
    """Time in the video; null if it would lie before its start."""
    return F.when(t + offset >= 0, t + offset)


def frame_at(probes: DataFrame, frames: DataFrame, by: list[str]) -> DataFrame:
    """``probes`` (by, t_ns, offset_ns) with pts_ns and frame: the last frame shown by then, the first if none was.

    ``frames`` has by, frame, pts_ns. Null without frames or before the video's start.
    """
    p = probes.withColumnsRenamed({"t_ns": "_t"}).withColumn("t_ns", presentation_ns(F.col("_t"), F.col("offset_ns")))
    met = asof(p.where("t_ns is not null"), frames.select(*by, F.col("pts_ns").alias("t_ns"), "frame"), by, value="frame", order=("frame",))
    has = met.withColumn("frame", F.coalesce("before_v", F.when(F.col("after_v").isNotNull(), 0).cast(frames.schema["frame"].dataType)))
    rest = p.where("t_ns is null").withColumn("frame", F.lit(None).cast(frames.schema["frame"].dataType))
    cols = [*[c for c in probes.columns if c != "t_ns"], F.col("_t").alias("t_ns"), F.col("t_ns").alias("pts_ns"), "frame"]
    return has.select(*cols).unionByName(rest.select(*cols))


def linked_files(prefix: Column, extension: Column, indices: Column) -> Column:
    """Names of the linked files: prefix, four-digit index, extension; positive indices, 1 if there is only a prefix."""
    ext = F.lower(F.regexp_replace(F.coalesce(extension, F.lit("avi")), r"^\.+", ""))
    kept = F.array_sort(F.filter(F.array_distinct(indices), lambda i: i > 0))
    kept = F.when((F.size(indices) == 0) & (prefix != ""), F.array(F.lit(1).cast("long"))).otherwise(kept)
    return F.transform(kept, lambda i: F.format_string("%s%04d.%s", prefix, i, ext))
