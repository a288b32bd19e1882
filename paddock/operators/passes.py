"""Derivations: named, versioned, append-only passes over samples, with provenance.

A pass gets the tables ``channels`` and ``samples`` and returns rows to append. Which recordings it fits is
decided per recording by joins, never by a loop over recordings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.geo import equirectangular_m, finite, valid_fix
from paddock.functions.names import ROLES, find
from paddock.session import materialize, ship

#: Grading: least fix type and satellites, sentinel of no accuracy, metres of a unit of dilution, default.
MIN_FIX, MIN_SATELLITES, SENTINEL_M, UERE_M, DEFAULT_SIGMA_M = 2.0, 4.0, 4_000_000.0, 5.0, 15.0
#: Cleaning: fastest credible motion, rejected fixes in a row before the next is believed.
MAX_SPEED_MPS, REANCHOR_AFTER = 150.0, 8
#: Odometer: drift, longest certain gap, uncertainty of longer ones.
DRIFT_RATE, MAX_GAP_S, GAP_UNCERTAINTY = 0.005, 1.0, 0.5


def _float(v: Column) -> Column:
    return F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(-3.4028234663852886e38)), F.lit(3.4028234663852886e38))).cast("float")


def grade_fixes(fixes: DataFrame) -> DataFrame:
    """``fixes`` (lat, lon, fix_type, satellites, accuracy, dop; missing ones null) with valid and sigma_m (NaN if invalid)."""
    fix, sats, acc, dop = (F.col(c) for c in ("fix_type", "satellites", "accuracy", "dop"))
    solution = F.when(fix.isNotNull(), finite(fix) & (fix >= MIN_FIX)).when(sats.isNotNull(), finite(sats) & (sats >= MIN_SATELLITES)).otherwise(True)
    accurate = acc.isNull() | ~finite(acc) | (acc < SENTINEL_M)
    valid = F.coalesce(valid_fix(F.col("lat"), F.col("lon")) & solution & accurate, F.lit(False))
    sigma = F.when(finite(acc) & (acc > 0), acc).when(finite(dop) & (dop > 0) & (dop < 99), dop * UERE_M).otherwise(DEFAULT_SIGMA_M)
    return fixes.withColumns({"valid": valid, "sigma_m": F.when(valid, _float(sigma)).otherwise(F.lit(float("nan")).cast("float"))})


def clean_fixes(fixes: DataFrame, by: list[str]) -> DataFrame:
    """by, t_ns, local_idx, lat, lon, flag → clean_lat, clean_lon: NaN where invalid or a teleport.

    A fix is a teleport if reaching it from the last accepted one takes more than 150 m/s; after eight
    in a row the next is believed. The state is the last accepted fix, so a group with a jump is one linear pass
    in Python. Where no step between neighbouring sane fixes is that fast, every sane fix is accepted: such groups,
    nearly all, are told by a window and stay in expressions.
    """
    ship(fixes.sparkSession)
    schema = ", ".join([*[f"{c} {fixes.schema[c].dataType.simpleString()}" for c in by], "local_idx bigint", "t_ns bigint", "clean_lat double", "clean_lon double", "accepted boolean"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_ns", "local_idx"], kind="stable")
        t, lat, lon = pdf["t_ns"].to_numpy(), pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float)
        with np.errstate(invalid="ignore"):
            sane = np.isfinite(lat) & np.isfinite(lon) & (abs(lat) <= 90) & (abs(lon) <= 180) & ~((abs(lat) < 1e-7) & (abs(lon) < 1e-7)) & pdf["flag"].to_numpy(bool)
        kept, last, streak = np.zeros(len(t), bool), -1, 0
        for i in np.flatnonzero(sane):
            if last >= 0 and t[i] > t[last]:
                dx = np.radians(lon[i] - lon[last]) * np.cos(np.radians((lat[i] + lat[last]) * 0.5))
                dy = np.radians(lat[i] - lat[last])
                if 6_371_000.0 * np.hypot(dx, dy) / ((t[i] - t[last]) / 1e9) > MAX_SPEED_MPS:
                    streak += 1
                    if streak <= REANCHOR_AFTER:
                        continue
            kept[i], last, streak = True, i, 0
        out = pdf[[*by, "local_idx", "t_ns"]].copy()
        out["clean_lat"], out["clean_lon"], out["accepted"] = np.where(kept, lat, np.nan), np.where(kept, lon, np.nan), kept
        return out

    nan = F.lit(float("nan"))
    lat, lon = F.col("lat"), F.col("lon")
    inside = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((F.abs(lat) < 1e-7) & (F.abs(lon) < 1e-7))
    before = Window.partitionBy(*by).orderBy("t_ns", "local_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_sane"), F.struct("t_ns", "lat", "lon")), ignorenulls=True).over(before)
    speed = F.try_divide(equirectangular_m(F.col("_last.lat"), F.col("_last.lon"), lat, lon), (F.col("t_ns") - F.col("_last.t_ns")) / 1e9)
    held = fixes.select(*by, "t_ns", "local_idx", lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), "flag").withColumn("_sane", F.coalesce(inside & F.col("flag"), F.lit(False))).withColumn("_last", last)
    # a hair below the limit, so that rounding can't call a jump quiet
    jump = F.col("_sane") & (F.col("t_ns") > F.col("_last.t_ns")) & (speed > MAX_SPEED_MPS * 0.999999)
    marked = materialize(held.withColumn("_loud", F.max(F.coalesce(jump, F.lit(False)).cast("int")).over(Window.partitionBy(*by))).drop("_last"))
    loud = marked.where("_loud = 1").select(*by, "t_ns", "local_idx", "lat", "lon", "flag").groupBy(*by).applyInPandas(run, schema)
    ok = F.col("_sane")
    quiet = marked.where("_loud = 0").select(*by, "local_idx", "t_ns", F.when(ok, lat).alias("clean_lat"), F.when(ok, lon).alias("clean_lon"), ok.alias("accepted"))
    done = loud.unionByName(quiet)
    #: A NaN that pandas hands back is null.
    return done.withColumns({c: F.when(F.col("accepted"), F.col(c)).otherwise(nan) for c in ("clean_lat", "clean_lon")})


def odometer(samples: DataFrame, by: list[str], order: list[str], speed: Column) -> DataFrame:
    """by, t_ns, odometer_m, sigma_m: trapezoids over ``speed`` (m/s), holding the last valid speed over bad ones."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = samples.withColumn("_s", F.when(finite(speed) & (speed >= 0), speed)).withColumn("_s", F.coalesce(F.last("_s", True).over(upto), F.lit(0.0)))
    dt = (F.col("t_ns") - F.lag("t_ns").over(w)) / 1e9
    v = v.withColumn("_dt", dt).withColumn("_seg", F.coalesce(0.5 * (F.lag("_s").over(w) + F.col("_s")) * F.col("_dt"), F.lit(0.0)))
    distance = F.sum("_seg").over(upto)
    gaps = F.sum(F.when(F.col("_dt") > MAX_GAP_S, F.col("_seg")).otherwise(0.0)).over(upto)
    return v.select(*by, *[c for c in order if c not in by and c != "t_ns"], "t_ns", distance.alias("odometer_m"), (DRIFT_RATE * distance + GAP_UNCERTAINTY * gaps).cast("float").alias("sigma_m"))


def monotonic(samples: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, monotonic: whether times never fall in the order of the samples."""
    w = Window.partitionBy(*by).orderBy(*order)
    return samples.withColumn("_fell", F.col("t_ns") < F.lag("t_ns").over(w)).groupBy(*by).agg((~F.coalesce(F.bool_or("_fell"), F.lit(False))).alias("monotonic"))


def in_degrees(samples: DataFrame, counts: DataFrame, by: list[str], probes: int = 512) -> DataFrame:
    """by, median_abs, degrees: the upper median of the magnitude of every (n div 512)-th non-zero value is at most 90."""
    stride = F.greatest(F.lit(1), F.floor(F.col("sample_count") / probes))
    v = samples.join(counts.select(*by, "sample_count"), by).where((F.col("local_idx") % stride == 0) & finite(F.col("value")) & (F.col("value") != 0))
    held = F.array_sort(F.collect_list(F.abs("value")))
    median = v.groupBy(*by).agg(held.alias("_h")).select(*by, F.get("_h", F.floor(F.size("_h") / 2).cast("int")).alias("median_abs"))
    return median.withColumn("degrees", F.col("median_abs") <= 90)


@dataclass(frozen=True)
class Pass:
    """A derivation: ``check`` gives recording_id and reason (null if it fits), ``derive`` the derived channels' samples.

    ``derive`` returns recording_id, name, unit, sample_type, chunk_idx, local_idx, t_ns, value.
    """

    name: str
    version: int
    check: Callable[[DataFrame, DataFrame], DataFrame]
    derive: Callable[[DataFrame, DataFrame], DataFrame]
    outputs: tuple[str, ...]
    params: dict[str, str] = field(default_factory=dict)

    @property
    def label(self) -> str:
        return f"{self.name}@{self.version}"


def _channel(channels: DataFrame, samples: DataFrame, role: str) -> DataFrame:
    """The samples of each recording's channel for a role."""
    return samples.join(find(channels, ROLES[role]), ["recording_id", "channel_idx"])


def _gps_reason(channels: DataFrame, samples: DataFrame) -> DataFrame:
    """recording_id, reason for which GPS passes skip it."""
    every = channels.select("recording_id").distinct()
    lat = find(channels, ROLES["latitude"][1:], "_lat")
    lon = find(channels, ROLES["longitude"][1:], "_lon")
    of = channels.select("recording_id", F.col("channel_idx").alias("_lat"), "unit", F.col("sample_count").alias("n"))
    on = channels.select("recording_id", F.col("channel_idx").alias("_lon"), F.col("sample_count").alias("m"))
    held = every.join(lat, "recording_id", "left").join(lon, "recording_id", "left").join(of, ["recording_id", "_lat"], "left").join(on, ["recording_id", "_lon"], "left")
    degrees = in_degrees(samples.join(lat.withColumnRenamed("_lat", "channel_idx"), ["recording_id", "channel_idx"]), channels.join(lat.withColumnRenamed("_lat", "channel_idx"), ["recording_id", "channel_idx"]), ["recording_id"])
    unit = F.lower("unit")
    reason = (
        F.when(F.col("_lat").isNull() | F.col("_lon").isNull(), "no GPS coordinate channels present")
        .when((F.col("n") == 0) | (F.col("m") == 0), "GPS coordinate channels are empty")
        .when(unit.isin("min", "arcmin", "arcminute", "arcminutes"), F.concat(F.lit("GPS coordinates are stored in "), unit))
        .when(~F.col("degrees"), "GPS coordinate values are not decimal degrees")
    )
    return held.join(degrees, "recording_id", "left").select("recording_id", reason.alias("reason"))


#: Channels that are read beside the latitude, as of its samples' times.
_BESIDE = ("longitude", "fix_type", "satellites", "accuracy", "dop", "fix_valid")


def _gps_fixes(channels: DataFrame, samples: DataFrame, linear_lon: bool) -> DataFrame:
    """Samples of latitude with the other GPS channels as of the same time, and has_flag: whether there is a validity channel.

    A channel tells nothing before its first sample or from the end of its duration on. One as-of join
    serves all channels.
    """
    from paddock.operators.sampling import asof, interpolated

    key = ["recording_id", "channel_idx"]
    lat = samples.join(find(channels, ROLES["latitude"][1:]), key).select("recording_id", "chunk_idx", "local_idx", "t_ns", F.col("value").alias("lat"))
    roles = None
    for role in _BESIDE:
        own = find(channels, ROLES[role][1:] if role == "longitude" else ROLES[role]).withColumn("role", F.lit(role))
        roles = own if roles is None else roles.unionByName(own)
    roles = roles.join(channels.select(*key, "duration_ns"), key)
    asked = lat.join(roles, "recording_id")
    met = asof(asked, samples.join(roles.select(*key).distinct(), key, "left_semi"), key, order=("chunk_idx", "local_idx"))
    v = F.when(F.col("t_ns") < F.col("duration_ns"), interpolated(F.col("t_ns"), F.lit(linear_lon) & (F.col("role") == "longitude")))
    of = lambda role: F.max(F.when(F.col("role") == role, v)).alias("lon" if role == "longitude" else role)
    wide = met.groupBy("recording_id", "chunk_idx", "local_idx", "t_ns", "lat").agg(*[of(r) for r in _BESIDE], F.bool_or(F.col("role") == "fix_valid").alias("has_flag"))
    return wide.withColumn("lon", F.coalesce("lon", F.lit(float("nan"))))


def _long(df: DataFrame, outputs: list[tuple[str, str, str, str]]) -> DataFrame:
    """Wide derived columns as samples of channels (column, name, unit, sample_type)."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(u).alias("unit"), F.lit(t).alias("sample_type"), F.col(c).cast("double").alias("value")) for c, n, u, t in outputs])
    return df.select("recording_id", "chunk_idx", "local_idx", "t_ns", F.explode(each).alias("o")).select("recording_id", "o.name", "o.unit", "o.sample_type", "chunk_idx", "local_idx", "t_ns", "o.value")


def _clean_reason(channels: DataFrame, samples: DataFrame) -> DataFrame:
    """``_gps_reason``, and that latitude's times must not fall."""
    lat = samples.join(find(channels, ROLES["latitude"][1:]), ["recording_id", "channel_idx"])
    falls = monotonic(lat, ["recording_id"], ["chunk_idx", "local_idx"])
    reason = F.coalesce("reason", F.when(~F.col("monotonic"), "GPS coordinate channels have non-monotonic sample times"))
    return _gps_reason(channels, samples).join(falls, "recording_id", "left").select("recording_id", reason.alias("reason"))


def _derive_quality(channels: DataFrame, samples: DataFrame) -> DataFrame:
    graded = grade_fixes(_gps_fixes(channels, samples, False)).withColumn("valid", F.col("valid").cast("int"))
    return _long(graded, [("valid", "GPS Fix Valid", "", "u8"), ("sigma_m", "GPS Position Sigma", "m", "f32")])


def _derive_clean(channels: DataFrame, samples: DataFrame) -> DataFrame:
    fixes = _gps_fixes(channels, samples, True).withColumn("flag", F.coalesce(F.col("fix_valid") != 0, ~F.col("has_flag")))
    cleaned = clean_fixes(fixes, ["recording_id"])
    back = fixes.select("recording_id", "chunk_idx", "local_idx", "t_ns").join(cleaned, ["recording_id", "local_idx", "t_ns"])
    return _long(back, [("clean_lat", "GPS Latitude Clean", "deg", "f64"), ("clean_lon", "GPS Longitude Clean", "deg", "f64")])


def _speed_reason(channels: DataFrame, samples: DataFrame) -> DataFrame:
    from paddock.functions.units import conversion_error

    own = find(channels, ROLES["speed"]).join(channels, ["recording_id", "channel_idx"]).select("recording_id", "unit", "sample_count")
    reason = (
        F.when(F.col("sample_count").isNull(), "no speed channel present")
        .when(F.col("sample_count") == 0, "speed channel has no samples")
        .when(F.col("unit") == "", "speed channel has no declared unit")
        .when(conversion_error(F.col("unit"), F.lit("m/s")).isNotNull(), "speed channel unit is not convertible to m/s")
    )
    falls = monotonic(_channel(channels, samples, "speed"), ["recording_id"], ["chunk_idx", "local_idx"])
    met = channels.select("recording_id").distinct().join(own, "recording_id", "left").withColumn("reason", reason).join(falls, "recording_id", "left")
    return met.select("recording_id", F.coalesce("reason", F.when(~F.col("monotonic"), "speed channel has non-monotonic sample times")).alias("reason"))


def _derive_distance(channels: DataFrame, samples: DataFrame) -> DataFrame:
    from paddock.functions.units import convert

    speed = _channel(channels, samples, "speed").join(channels.select("recording_id", "channel_idx", "unit"), ["recording_id", "channel_idx"])
    walked = odometer(speed, ["recording_id"], ["t_ns", "chunk_idx", "local_idx"], convert(F.col("value"), F.col("unit"), F.lit("m/s")))
    return _long(walked, [("odometer_m", "Distance Odometer", "m", "f64"), ("sigma_m", "Distance Odometer Sigma", "m", "f32")])


def registry() -> list[Pass]:
    """The passes in order; later ones see what earlier ones appended."""
    return [
        Pass("gps.quality", 1, _gps_reason, _derive_quality, ("GPS Fix Valid", "GPS Position Sigma"), {"default_sigma_m": "15", "min_fix": "2", "min_satellites": "4", "sentinel_m": "4000000", "uere_m": "5"}),
        Pass("gps.clean", 1, _clean_reason, _derive_clean, ("GPS Latitude Clean", "GPS Longitude Clean"), {"max_speed_mps": "150", "reanchor_after": "8"}),
        Pass("speed.distance", 1, _speed_reason, _derive_distance, ("Distance Odometer", "Distance Odometer Sigma"), {"drift_rate": "0.005", "gap_uncertainty": "0.5", "max_gap_s": "1"}),
    ]


def apply(channels: DataFrame, samples: DataFrame, applied: DataFrame, passes: list[Pass] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(channels, samples, reports) after the passes, each appended for the recordings that it fits.

    ``applied`` has recording_id, name, version of what was applied before: the same version is skipped,
    another one is reported as a conflict, and nothing is appended over a channel of the same name.
    """
    from paddock.functions.names import normalize

    reports = None
    channels, samples = materialize(channels), materialize(samples)
    for p in passes or registry():
        before = applied.where(F.col("name") == p.name).groupBy("recording_id").agg(F.max("version").alias("_version"))
        clash = channels.where(normalize(F.col("name")).isin(*["".join(c for c in o.lower() if c.isalnum()) for o in p.outputs])).select("recording_id").distinct().withColumn("_clash", F.lit(True))
        met = p.check(channels, samples).join(before, "recording_id", "left").join(clash, "recording_id", "left")
        outcome = (
            F.when(F.col("_version") == p.version, "already applied")
            .when(F.col("_version").isNotNull(), "version conflict")
            .when(F.col("reason").isNotNull(), "skipped")
            .when(F.col("_clash"), "output exists")
            .otherwise("applied")
        )
        report = materialize(met.select("recording_id", F.lit(p.name).alias("name"), F.lit(p.version).alias("version"), outcome.alias("outcome"), "reason"))
        fits = report.where("outcome = 'applied'").select("recording_id")
        derived = materialize(p.derive(channels.join(fits, "recording_id", "left_semi"), samples.join(fits, "recording_id", "left_semi")))
        #: New channels are numbered after the recording's last, in the order of the pass's outputs.
        place = F.array_position(F.array(*[F.lit(o) for o in p.outputs]), F.col("name"))
        last = channels.groupBy("recording_id").agg(F.max("channel_idx").alias("_last"), F.max("id").alias("_last_id"), F.max("duration_ns").alias("duration_ns"))
        new = derived.groupBy("recording_id", "name", "unit", "sample_type").agg(F.count(F.lit(1)).alias("sample_count")).join(last, "recording_id")
        new = new.select("recording_id", (F.col("_last") + place).cast("int").alias("channel_idx"), (F.col("_last_id") + place).cast("int").alias("id"), "name", "unit", F.lit("declared").alias("unit_source"), "sample_type", "sample_count", "duration_ns")
        new = materialize(new)
        more = derived.join(new.select("recording_id", "name", "channel_idx"), ["recording_id", "name"])
        channels = channels.unionByName(new)
        samples = samples.unionByName(more.select(*samples.columns))
        reports = report if reports is None else reports.unionByName(report)
    return channels, samples, reports


def provenance(reports: DataFrame, passes: list[Pass] | None = None) -> DataFrame:
    """recording_id, position, name, version, params (name, value; sorted), outputs: what was applied to each recording, in order."""
    held = F.array(*[
        F.struct(
            F.lit(p.name).alias("name"), F.lit(p.version).alias("version"),
            F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in sorted(p.params.items())]).cast("array<struct<name:string,value:string>>").alias("params"),
            F.array(*[F.lit(o) for o in p.outputs]).alias("outputs"),
        )
        for p in passes or registry()
    ])
    applied = reports.where("outcome = 'applied'").groupBy("recording_id").agg(F.collect_set("name").alias("names"))
    kept = F.filter(held, lambda p: F.array_contains("names", p["name"]))
    return applied.select("recording_id", F.posexplode(kept).alias("position", "p")).select("recording_id", "position", "p.*")


def strip(channels: DataFrame, samples: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Channels and samples without what passes made; ``outputs`` has recording_id and name."""
    kept = channels.join(outputs.select("recording_id", "name"), ["recording_id", "name"], "left_anti").select(*channels.columns)
    return kept, samples.join(kept.select("recording_id", "channel_idx"), ["recording_id", "channel_idx"], "left_semi")


def jump_speed(fixes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``fixes`` with speed_mps from the fix before: what the teleport rule compares, for reports."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = equirectangular_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return fixes.withColumn("speed_mps", F.try_divide(d, (F.col("t_ns") - F.lag("t_ns").over(w)) / 1e9))
