"""Enumerations and column names."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

#: Radius in metres of the sphere that stations are placed on for neighbour searches and great circles.
EARTH_RADIUS = 6.378137e6
#: Radius of the stand-alone coordinate conversion.
CONVERSION_RADIUS = 6.37e6

GOOD, BAD, ISOLATED_INNER, ISOLATED_OUTER, NOT_INVERTIBLE, NOT_CHECKED = 0, 1, 11, 12, 100, -999


class CoordinateType(IntEnum):
    Geodetic = 0
    Cartesian = 1


class BackgroundType(IntEnum):
    VerticalProfile = 0
    VerticalProfileTheilSen = 1
    MeanOuterCircle = 2
    MedianOuterCircle = 3
    External = 4


class ConditionType(IntEnum):
    Eq = 0
    Gt = 1
    Geq = 2
    Lt = 3
    Leq = 4


def member(kind: type[IntEnum], value: IntEnum | int | str) -> IntEnum:
    """A member of the enumeration by itself, number or name."""
    return kind[value] if isinstance(value, str) else kind(value)


@dataclass(frozen=True)
class Columns:
    """Names of the station columns.  Those a check doesn't use may be missing."""

    id: str = "station_id"
    lat: str = "lat"
    lon: str = "lon"
    elev: str = "elev"
    laf: str = "laf"
    value: str = "value"
    flag: str = "flag"


DEFAULT = Columns()
