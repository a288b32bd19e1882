"""Units: lookup by name or alias, dimension-safe conversion, plausible bands."""

from __future__ import annotations

import json
import zlib
import math
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TURN = 2 * math.pi
# Canonical name, factor and offset to the base unit, aliases; by dimension.
UNITS: dict[str, list[tuple[str, float, float, str]]] = {
    "length": [("m", 1, 0, "metre|meter|metres|meters"), ("mm", 0.001, 0, "millimetre|millimeter"), ("cm", 0.01, 0, ""), ("km", 1000, 0, ""),
               ("in", 0.0254, 0, "inch|inches"), ("ft", 0.3048, 0, "feet|foot"), ("mile", 1609.344, 0, "mi|miles")],
    "speed": [("m/s", 1, 0, "mps|ms-1|m.s^-1"), ("km/h", 1 / 3.6, 0, "kph|kmh|kmph|km/hr"), ("mph", 0.44704, 0, "mi/h|mp/h"), ("kn", 0.5144444444444444, 0, "knot|knots")],
    "acceleration": [("m/s^2", 1, 0, "m/s2|mps2|m/s²"), ("g", 9.80665, 0, "G|g-force")],
    "angle": [("rad", 1, 0, "radian|radians"), ("deg", 1 / (180 / math.pi), 0, "degree|degrees|°"), ("rev", _TURN, 0, "revolution")],
    "angular_velocity": [("rad/s", 1, 0, "rads|rad/sec"), ("rpm", _TURN / 60, 0, "RPM|rev/min|r/min"), ("deg/s", 1 / (180 / math.pi), 0, "dps|deg/sec")],
    "angular_acceleration": [("rad/s^2", 1, 0, "rad/s2"), ("deg/s^2", 1 / (180 / math.pi), 0, "deg/s2")],
    "pressure": [("Pa", 1, 0, "pascal|pa"), ("kPa", 1e3, 0, "kpa"), ("MPa", 1e6, 0, "mpa"), ("bar", 1e5, 0, "Bar"), ("mbar", 100, 0, "millibar|hPa"),
                 ("psi", 6894.757293168361, 0, "PSI|lbf/in^2"), ("atm", 101325, 0, ""), ("inHg", 3386.388640341, 0, "inhg")],
    "temperature": [("K", 1, 0, "kelvin"), ("C", 1, 273.15, "degC|°C|celsius|Celsius|deg C"), ("F", 5 / 9, 273.15 - 32 * 5 / 9, "degF|°F|fahrenheit|Fahrenheit|deg F")],
    "time": [("s", 1, 0, "sec|secs|second|seconds"), ("ms", 0.001, 0, "millisecond|msec"), ("timespan_ms", 0.001, 0, "laptime_ms|racetime_ms"),
             ("us", 1e-6, 0, "microsecond|usec|µs"), ("ns", 1e-9, 0, "nanosecond|nsec"), ("min", 60, 0, "minute|minutes"), ("h", 3600, 0, "hr|hour|hours")],
    "frequency": [("Hz", 1, 0, "hz|hertz"), ("kHz", 1e3, 0, "khz")],
    "force": [("N", 1, 0, "newton"), ("kN", 1e3, 0, "kilonewton"), ("lbf", 4.4482216152605, 0, "")],
    "torque": [("Nm", 1, 0, "N.m|N*m|newton-metre"), ("lbft", 1.3558179483314004, 0, "lb-ft|ft-lb|ftlb")],
    "energy": [("J", 1, 0, "joule"), ("kJ", 1e3, 0, "kilojoule"), ("MJ", 1e6, 0, "megajoule"), ("kWh", 3.6e6, 0, "kwh")],
    "power": [("W", 1, 0, "watt"), ("kW", 1e3, 0, "kw"), ("hp", 745.6998715822702, 0, "HP|bhp"), ("PS", 735.49875, 0, "ps")],
    "voltage": [("V", 1, 0, "volt|volts"), ("mV", 0.001, 0, "millivolt")],
    "current": [("A", 1, 0, "amp|amps|ampere"), ("mA", 0.001, 0, "milliamp")],
    "resistance": [("ohm", 1, 0, "Ohm|Ω")],
    "mass": [("kg", 1, 0, "kilogram|kilogramme"), ("g_mass", 0.001, 0, "gram|gramme"), ("lb", 0.45359237, 0, "lbs|pound")],
    "volume": [("m^3", 1, 0, "m3|cubic metre"), ("L", 0.001, 0, "l|litre|liter|litres|liters"), ("mL", 1e-6, 0, "ml|millilitre"), ("gal", 0.003785411784, 0, "gallon")],
    "volumetric_flow": [("m^3/s", 1, 0, "m3/s"), ("L/s", 0.001, 0, "l/s"), ("L/h", 0.001 / 3600, 0, "l/h|L/hr")],
    "mass_flow": [("kg/s", 1, 0, ""), ("kg/h", 1 / 3600, 0, "kg/hr")],
    "ratio": [("ratio", 1, 0, "fraction|Lambda|lambda"), ("%", 0.01, 0, "percent|pct"), ("%/s", 0.01, 0, "pct/s"), ("%/Period", 0.01, 0, "%/period|pct/period")],
    "count": [("count", 1, 0, "cnt|counts|num|number"), ("laps", 1, 0, "lap"), ("gear", 1, 0, ""), ("code", 1, 0, "error_code")],
    "marker": [("marker", 1, 0, ""), ("raw", 1, 0, "Raw|RAW"), ("flag", 1, 0, "Flag|flags|bool|boolean"), ("state", 1, 0, "status|State|Status|mode"), ("pp1", 1, 0, ""),
               ("Driver", 1, 0, "driver"), ("defined", 1, 0, "user defined|User Defined|user-defined"), ("text", 1, 0, "string|label")],
    "logarithmic": [("dBm", 1, 0, "dbm"), ("dB", 1, 0, "db")],
}
# What a raw value of the dimension may be.
BANDS: dict[str, tuple[float, float]] = {
    "speed": (-500, 500), "length": (-1e9, 1e9), "acceleration": (-1000, 1000), "angle": (-1e5, 1e5), "angular_velocity": (-30000, 30000),
    "angular_acceleration": (-1e6, 1e6), "pressure": (-1e6, 1e9), "temperature": (0, 5000), "time": (-1e12, 1e12), "frequency": (-1e9, 1e9),
    "force": (-1e7, 1e7), "torque": (-1e6, 1e6), "energy": (-1e12, 1e12), "power": (-1e9, 1e9), "voltage": (-1e5, 1e5), "current": (-1e5, 1e5),
    "resistance": (-1e9, 1e9), "mass": (-1e6, 1e6), "volume": (-1e4, 1e4), "volumetric_flow": (-1e4, 1e4), "mass_flow": (-1e4, 1e4),
    "ratio": (-1e6, 1e6), "logarithmic": (-1e4, 1e4),
}
#: Values of these dimensions convert only to their own unit.
FIXED = ("count", "marker")
_UNIT = "struct<canonical:string,dimension:string,factor:double,offset:double>"


def table(spark: SparkSession) -> DataFrame:
    """canonical, dimension, factor, offset, low, high, base: one row per unit."""
    rows = [(n, d, float(f), float(o), *map(float, BANDS[d]), us[0][0]) if d in BANDS else (n, d, float(f), float(o), None, None, us[0][0]) for d, us in UNITS.items() for n, f, o, _ in us]
    return spark.createDataFrame(rows, "canonical string, dimension string, factor double, offset double, low double, high double, base string")


def _spellings() -> tuple[dict[str, tuple], dict[str, tuple]]:
    """Units by exact spelling and by lower-cased spelling; the first in order of the list wins."""
    exact: dict[str, tuple] = {}
    folded: dict[str, tuple] = {}
    for dimension, units in UNITS.items():
        for name, factor, offset, aliases in units:
            for s in [name, *filter(None, aliases.split("|"))]:
                exact.setdefault(s, (name, dimension, float(factor), float(offset)))
                folded.setdefault(_fold(s), (name, dimension, float(factor), float(offset)))
    return exact, folded


def find(text: str) -> tuple[str, str, float, float] | None:
    """(canonical, dimension, factor, offset) of a spelling, for code inside tasks; ``lookup`` is its expression."""
    exact, folded = _held()
    return exact.get(text.strip()) or folded.get(_fold(text.strip()))


@cache
def _held() -> tuple[dict[str, tuple], dict[str, tuple]]:
    return _spellings()


def _fold(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


#: Maps that the spellings are dealt to by their checksum, so that a look-up scans a few entries only.
_DEALT = 256


def _found(entries: dict[str, tuple], key: Column) -> Column:
    """The entry of ``key``, from literal maps that hold the keys of one checksum each."""
    fields = ("canonical", "dimension", "factor", "offset")
    dealt: list[dict] = [{} for _ in range(_DEALT)]
    for k, v in entries.items():
        dealt[zlib.crc32(k.encode()) % _DEALT][k] = dict(zip(fields, v))
    held = F.from_json(F.lit(json.dumps(dealt)), f"array<map<string,{_UNIT}>>")
    return F.try_element_at(F.get(held, F.pmod(F.crc32(key.cast("binary")), F.lit(_DEALT)).cast("int")), key)


def lookup(unit: Column) -> Column:
    """The unit's struct (canonical, dimension, factor, offset): by exact spelling, else by ASCII case; null if unknown or blank."""
    exact, folded = _spellings()
    trimmed = F.trim(unit)
    ascii_lower = F.translate(trimmed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(trimmed != "", F.coalesce(_found(exact, trimmed), _found(folded, ascii_lower)))


def normalize(unit: Column) -> Column:
    return lookup(unit)["canonical"]


def _resolved(source: Column, target: Column, told: Callable[[Column, Column], Column]) -> Column:
    """``told`` of both units' structs, each looked up once a row however often they are named."""
    pair = F.array(F.struct(lookup(source).alias("a"), lookup(target).alias("b")))
    return F.get(F.transform(pair, lambda p: told(p["a"], p["b"])), F.lit(0))


def _error(a: Column, b: Column) -> Column:
    return (
        F.when(a.isNull() | b.isNull(), "unknown_unit")
        .when(a["canonical"] == b["canonical"], F.lit(None))
        .when(a["dimension"] != b["dimension"], "dimension_mismatch")
        .when(a["dimension"].isin(*FIXED), "not_convertible")
    )


def conversion_error(source: Column, target: Column) -> Column:
    """Why values don't convert: unknown_unit, dimension_mismatch, not_convertible; null if they do."""
    return _resolved(source, target, _error)


def convert(value: Column, source: Column, target: Column) -> Column:
    """The value in the target unit, null where ``conversion_error`` isn't."""

    def moved(a: Column, b: Column) -> Column:
        other = (value * a["factor"] + a["offset"] - b["offset"]) / b["factor"]
        return F.when(_error(a, b).isNull(), F.when(a["canonical"] == b["canonical"], value).otherwise(other))

    return _resolved(source, target, moved)


def band(unit: Column) -> Column:
    """(low, high) of plausible raw values in the unit; null where there is none."""
    bands = F.create_map(*[x for d, (lo, hi) in BANDS.items() for x in (F.lit(d), F.struct(F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high")))])
    return F.try_element_at(bands, lookup(unit)["dimension"])
