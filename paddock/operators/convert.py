"""Converting recordings into a store: staged under a version of their own, then swapped in by one rename.

A store is a folder of tables; each job writes its rows under ``<table>/in_version=v-<job>``, which no reader looks at
yet. A manifest (recording_id, version) says which version of each recording counts; publishing writes the next
manifest aside and renames it into place. A job that stops between the two leaves the old rows in force, and
running it again under the same name writes the same version over and publishes it once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators import passes
from paddock.session import materialize, prepare

MANIFESTS, MODES = "_manifests", ("apply", "skip", "strip")


class Conflict(RuntimeError):
    """Another job published while this one was at it."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, jvm.org.apache.hadoop.fs.Path


def _at(store: str, table: str, job: str) -> str:
    return f"{store}/{table}/in_version=v-{job}"


def _latest(spark: SparkSession, store: str) -> int:
    """Number of the manifest in force, 0 without one."""
    fs, place, _ = _files(spark, f"{store}/{MANIFESTS}")
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return max((int(n) for n in names if n.isdecimal()), default=0)


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """recording_id, version of every recording in force."""
    n = _latest(prepare(spark), store)
    if not n:
        return spark.createDataFrame([], "recording_id string, version string")
    return spark.read.schema("recording_id string, version string").parquet(f"{store}/{MANIFESTS}/{n:08d}")


def stage(tables: dict[str, DataFrame], store: str, job: str) -> None:
    """Write the tables under the job's version; rows of an earlier run of it are replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(_at(store, name, job))


def publish(spark: SparkSession, store: str, job: str, recordings: DataFrame) -> bool:
    """Put the job's version of ``recordings`` (recording_id) in force; False if it is already.

    Raises ``Conflict`` if the next manifest was there first: then read, and publish again.
    """
    n, old = _latest(spark, store), manifest(spark, store)
    new = recordings.select("recording_id").distinct().withColumn("version", F.lit(job))
    if new.join(old, ["recording_id", "version"], "left_anti").isEmpty():
        return False
    aside = f"{store}/{MANIFESTS}/_{uuid.uuid4().hex}"
    old.join(new, "recording_id", "left_anti").unionByName(new).write.parquet(aside)
    fs, staged, path = _files(spark, aside)
    final = path(f"{store}/{MANIFESTS}/{n + 1:08d}")
    # a rename onto a folder would move into it, so the name must be free; renames of one name succeed once
    if fs.exists(final) or not fs.rename(staged, final):
        fs.delete(staged, True)
        raise Conflict(f"manifest {n + 1} was published by another job")
    return True


def current(spark: SparkSession, store: str, table: str) -> DataFrame:
    """The rows of a table that are in force."""
    held = manifest(spark, store)
    held = held.select("recording_id", F.concat(F.lit("v-"), "version").alias("in_version"))
    return spark.read.parquet(f"{store}/{table}").join(held, ["recording_id", "in_version"], "left_semi").drop("in_version")


def convert(opened: dict[str, DataFrame], store: str, job: str, mode: str = "apply", applied: DataFrame | None = None) -> DataFrame:
    """The reports of the passes, after the opened recordings are in the store.

    ``opened`` has channels and samples, and may have laps, spans and diagnostics. ``apply`` appends what the
    registry's passes derive, ``skip`` stores recordings as they are, ``strip`` leaves out what passes made
    before: ``applied`` (recording_id, name, version, outputs) tells those, as ``current(.., "passes")`` does.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    spark = opened["channels"].sparkSession
    fs, place, _ = _files(spark, _at(store, "channels", job))
    if fs.exists(place):
        # an earlier run of the job may be what is read: it is copied before it is written over
        opened = {k: materialize(v) for k, v in opened.items()}
        applied = applied if applied is None else materialize(applied)
    channels, samples = materialize(opened["channels"]), opened["samples"]
    before = applied if applied is not None else spark.createDataFrame([], "recording_id string, position int, name string, version int, params array<struct<name:string,value:string>>, outputs array<string>")
    none = spark.createDataFrame([], "recording_id string, name string, version int, outcome string, reason string")
    reports, held = none, before
    if mode == "apply":
        channels, samples, reports = passes.apply(channels, samples, before.select("recording_id", "name", "version"))
        held = before.unionByName(passes.provenance(reports), allowMissingColumns=True)
    elif mode == "strip":
        channels, samples = passes.strip(channels, samples, before.select("recording_id", F.explode("outputs").alias("name")))
        held = before.where("false")
    own = held.join(channels.select("recording_id").distinct(), "recording_id", "left_semi")
    tables = {k: v for k, v in opened.items() if k in ("laps", "spans", "diagnostics")} | {"channels": channels, "samples": samples, "passes": own, "reports": reports}
    stage(tables, store, job)
    publish(spark, store, job, channels.select("recording_id"))
    return reports
