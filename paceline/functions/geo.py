"""Distances on the WGS84 ellipsoid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions.text import let

EQUATOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
KM_PER_DEGREE = 110.574  # shortest degree of latitude, so boxes are never too small


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points (Lambert's long-line formula)."""
    def reduced(lat):
        return F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(lat)))

    def square(x):
        return x * x

    def central(b):
        h = square(F.sin((b["two"] - b["one"]) / 2)) + F.cos(b["one"]) * F.cos(b["two"]) * square(F.sin(F.radians(lng2 - lng1) / 2))
        return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))

    def bent(b, angle):
        mid, gap = (b["one"] + b["two"]) / 2, (b["two"] - b["one"]) / 2
        x = (angle - F.sin(angle)) * square(F.sin(mid) * F.cos(gap)) / square(F.cos(angle / 2))
        y = (angle + F.sin(angle)) * square(F.cos(mid) * F.sin(gap)) / square(F.sin(angle / 2))
        return F.when(angle == 0, F.lit(0.0)).otherwise(EQUATOR_M * (angle - (FLATTENING / 2) * (x + y)))

    known = lat1.isNotNull() & lng1.isNotNull() & lat2.isNotNull() & lng2.isNotNull()
    ends = F.struct(reduced(lat1).alias("one"), reduced(lat2).alias("two"))
    return F.when(known, let(ends, lambda b: let(central(b), lambda angle: bent(b, angle))))


def box_degrees(lat: Column, radius_m: float) -> tuple[Column, Column]:
    """Half height and half width, in degrees, of a box that covers the circle; next to a pole it goes all around."""
    d_lat = radius_m / 1000 / KM_PER_DEGREE
    far_lat = F.abs(lat) + d_lat
    wide = F.lit(d_lat * 1.01) / F.cos(F.radians(F.least(far_lat, F.lit(89.0))))
    return F.lit(d_lat), F.when(far_lat >= 89, F.lit(180.0)).otherwise(wide)
