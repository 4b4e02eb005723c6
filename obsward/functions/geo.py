"""Coordinates and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsward.functions.validity import Param, param
from obsward.types import CONVERSION_RADIUS, EARTH_RADIUS, CoordinateType, member


def deg2rad(deg: Param) -> Column:
    return F.radians(param(deg))


def rad2deg(rad: Param) -> Column:
    return F.degrees(param(rad))


def xyz(lat: Param, lon: Param, kind: CoordinateType | int | str = CoordinateType.Geodetic, radius: float = EARTH_RADIUS) -> tuple[Column, Column, Column]:
    """Places in space: on the sphere, or for Cartesian coordinates x = lon, y = lat in a plane."""
    la, lo = param(lat).cast("double"), param(lon).cast("double")
    if member(CoordinateType, kind) == CoordinateType.Cartesian:
        return lo, la, F.lit(0.0)
    a, o = F.radians(la), F.radians(lo)
    return radius * F.cos(a) * F.cos(o), radius * F.cos(a) * F.sin(o), radius * F.sin(a)


def convert_coordinates(lat: Param, lon: Param) -> tuple[Column, Column, Column]:
    """Stand-alone conversion, on its own sphere."""
    return xyz(lat, lon, CoordinateType.Geodetic, CONVERSION_RADIUS)


def calc_distance_xyz(x0: Param, y0: Param, z0: Param, x1: Param, y1: Param, z1: Param) -> Column:
    d = [param(a) - param(b) for a, b in ((x0, x1), (y0, y1), (z0, z1))]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def chord(a: str, b: str) -> Column:
    """Straight distance between rows aliased a and b with columns x, y, z."""
    return calc_distance_xyz(*(F.col(f"{s}.{c}") for s in (a, b) for c in "xyz"))


def calc_distance(lat0: Param, lon0: Param, lat1: Param, lon1: Param, kind: CoordinateType | int | str = CoordinateType.Geodetic) -> Column:
    """Great-circle distance in metres (Cartesian: Euclidean).  The cosine is held within 1, so equal places give 0."""
    a, b, c, d = (param(v).cast("double") for v in (lat0, lon0, lat1, lon1))
    if member(CoordinateType, kind) == CoordinateType.Cartesian:
        return F.sqrt((a - c) * (a - c) + (b - d) * (b - d))
    p, q, r = F.radians(a), F.radians(c), F.radians(b - d)
    cosine = F.cos(p) * F.cos(q) * F.cos(r) + F.sin(p) * F.sin(q)
    return F.when((a == c) & (b == d), 0.0).otherwise(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) * EARTH_RADIUS)


def calc_distance_fast(lat0: Param, lon0: Param, lat1: Param, lon1: Param, kind: CoordinateType | int | str = CoordinateType.Geodetic) -> Column:
    """Equirectangular approximation, for short distances."""
    if member(CoordinateType, kind) == CoordinateType.Cartesian:
        return calc_distance(lat0, lon0, lat1, lon1, kind)
    a, b, c, d = (F.radians(param(v).cast("double")) for v in (lat0, lon0, lat1, lon1))
    dx = (d - b) * F.cos((a + c) / 2)
    return F.sqrt(dx * dx + (c - a) * (c - a)) * EARTH_RADIUS
