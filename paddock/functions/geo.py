"""Distances and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Metres of a degree of longitude at the equator and of latitude.
LON_M, LAT_M = 111_320.0, 110_540.0


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def haversine_m(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def equirectangular_m(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    dx = F.radians(lon1 - lon0) * F.cos(F.radians((lat0 + lat1) * 0.5)) * EARTH_M
    dy = F.radians(lat1 - lat0) * EARTH_M
    return F.sqrt(dx * dx + dy * dy)


def valid_fix(lat: Column, lon: Column) -> Column:
    """Finite, in range and not the origin."""
    return finite(lat) & finite(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((F.abs(lat) < 1e-7) & (F.abs(lon) < 1e-7))


def packed_coordinate(v: Column, most: float, reverse: bool = False) -> Column:
    """Degrees of a DDDMM.mmm value; null if degrees exceed ``most`` or minutes reach 60."""
    deg, rest = F.floor(F.abs(v) / 100), F.abs(v) % 100
    sign = F.signum(v) * (-1 if reverse else 1)
    return F.when(finite(v) & (deg <= most) & (rest < 60), sign * (deg + rest / 60))


def project(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """(distance in metres, fraction 0 to 1) of the point's foot on the segment a to b, on a local plane."""
    k = F.cos(F.radians(lat)) * LON_M
    ax, ay = (a_lon - lon) * k, (a_lat - lat) * LAT_M
    dx, dy = (b_lon - a_lon) * k, (b_lat - a_lat) * LAT_M
    square = dx * dx + dy * dy
    frac = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-(ax * dx + ay * dy), square)))).otherwise(F.lit(0.0))
    x, y = ax + dx * frac, ay + dy * frac
    return F.struct(F.sqrt(x * x + y * y).alias("distance_m"), frac.alias("frac"))
