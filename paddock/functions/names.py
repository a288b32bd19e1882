"""Channel names: comparison in normal form, roles by priority, the step rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.session import spread

# Normalised channel names of each role, in order of preference.
ROLES: dict[str, tuple[str, ...]] = {
    "latitude": ("gpslatitudeclean", "gpslatitude", "latitude", "gpslat", "lat"),
    "longitude": ("gpslongitudeclean", "gpslongitude", "longitude", "gpslon", "lon", "long"),
    "speed": ("groundspeed", "speedref", "corrspeed", "vehiclespeed", "wheelspeed", "speed", "gpsspeed"),
    "lap_number": ("lapnumber", "lapnum", "lapcount", "lapcounter", "currentlap", "lap", "beaconeventcount", "beaconcount", "lapbeaconcount"),
    "lap_timer": ("currentlaptime", "lapcurrentlaptime", "laptime", "laptimerunning", "lapprogression", "lapprogress", "lapprogresspct"),
    "driver": ("driverid", "driver", "driverindex"),
    "reference_lap": ("reflaptime", "referencelaptime"),
    "gps_week": ("gpsweek",),
    "gps_itow": ("gpsitow",),
    "unix_time": ("globaltime", "unixtime", "epochtime"),
    "satellites": ("gpssatellites", "satellites", "gpsnumsat", "numsats", "sats"),
    "fix_type": ("gpsfixtype", "fixtype", "gpsfix"),
    "accuracy": ("gpspositionaccuracy", "gpsposaccuracy", "positionaccuracy", "gpsaccuracy"),
    "dop": ("gpsdop", "gpshdop", "hdop"),
    "fix_valid": ("gpsfixvalid",),
}
# The same for the roles of the normalised sample.
SAMPLE_ROLES: dict[str, tuple[str, ...]] = {
    "speed": ("groundspeed", "speedref", "corrspeed", "vehiclespeed", "gpsspeed", "speed", "velocitykmh"),
    "throttle": ("throttlepos", "driverthrottlepos", "throttlepedal", "pedalpos", "throttle"),
    "brake": ("brakepedalpos", "brakepedal", "driverbrakepressure", "brakepressure", "pbrakefront", "brake"),
    "clutch": ("clutchpos", "clutchpedal", "clutchpedalpos", "clutch"),
    "steering": ("steeringangle", "steerangle", "steeringpos", "handwheelangle", "swangle", "steering"),
    "gear": ("gearpos", "selectedgear", "ngear", "gear"),
    "rpm": ("enginerpm", "engspeed", "rpm", "nmot"),
    "lap_distance": ("lapdistancecorrected", "lapdistance", "lapdist", "lapdistpct", "lapprogression", "lapprogress", "lapprogresspct", "linelapdistancel", "distance"),
    "lap_number": ("lapnumber", "lapnum", "lapcount", "lapcounter", "currentlap", "lap"),
    "lap_time": ("currentlaptime", "lapcurrentlaptime", "laptimerunning", "laptime"),
    "latitude": ("gpslatitudeclean", "gpslatitude", "latitude", "gpslat", "lat"),
    "longitude": ("gpslongitudeclean", "gpslongitude", "longitude", "gpslon", "lon", "long"),
}
# Counters of completed beacons, progress channels.
COMPLETED_COUNTERS = ("beaconeventcount", "beaconcount", "lapbeaconcount")
PROGRESS = ("lapprogression", "lapprogress", "lapprogresspct")
# A float channel whose normalised name holds one of these steps.
STEP_TOKENS = (
    "gear", "lapnumber", "lapbeacon", "laptrigger", "beaconeventcount", "beaconcount", "switch", "status", "state", "flag", "alarm", "satellites", "solutiontype",
)


def normalize(name: Column) -> Column:
    """ASCII letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def same(one: Column, two: Column) -> Column:
    return normalize(one) == normalize(two)


def contains(name: Column, needle: Column) -> Column:
    """Whether the normal form holds the needle's; an empty needle always matches."""
    return normalize(name).contains(normalize(needle))


def steps(name: Column, sample_type: Column) -> Column:
    """Whether a channel holds its value until the next sample: integers do, and floats of certain names."""
    hit = F.lit(False)
    for token in STEP_TOKENS:
        hit = hit | normalize(name).contains(token)
    return ~sample_type.isin("f32", "f64") | hit


def find(channels: DataFrame, names: tuple[str, ...], out: str = "channel_idx", by: str = "recording_id") -> DataFrame:
    """Per recording the channel that the first name in order of preference hits; ties go to the first channel."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), normalize(F.col("name")))
    return channels.where(rank > 0).groupBy(by).agg(F.min_by("channel_idx", F.struct(rank, "channel_idx")).alias(out))


def resolve_roles(channels: DataFrame, roles: dict[str, tuple[str, ...]] = ROLES) -> DataFrame:
    """recording_id, role, channel_idx: every role's channel in one pass over the channels.

    Hits are dealt over many tasks before they are grouped: few bytes of channel names are many rows of hits,
    and a task that scans them all would sort them all.
    """
    listed = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(k).alias("rank"), F.lit(n).alias("wanted")) for r, ns in roles.items() for k, n in enumerate(ns)])
    named = channels.withColumn("_n", normalize(F.col("name")))
    hits = named.select("recording_id", "channel_idx", F.explode(F.filter(listed, lambda x: x["wanted"] == F.col("_n"))).alias("h"))
    hits = spread(hits, "recording_id")
    return hits.groupBy("recording_id", "h.role").agg(F.min_by("channel_idx", F.struct("h.rank", "channel_idx")).alias("channel_idx"))
