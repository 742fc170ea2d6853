"""Geometry as column expressions; coordinates are degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def round_half_up(x: Column, places: int = 0) -> Column:
    """floor(x + 0.5) at the given decimal place: -2.5 becomes -2, unlike Spark's round."""
    return F.floor(x * 10**places + 0.5) / F.lit(10.0**places)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the radius's unit, in the atan2 form."""
    s1, s2 = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    h = F.when(h > 1, 1.0).otherwise(h)  # null stays null
    return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bearing_rough(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Direction of a line in the degree plane, folded to [0, 180)."""
    return F.pmod(F.degrees(F.atan2(lat2 - lat1, lon2 - lon1)), F.lit(180.0))


def folded_difference(a: Column, b: Column) -> Column:
    """Difference of two folded directions, at most 90."""
    d = F.abs(a - b)
    return F.least(d, 180 - d)


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    dl, p1, p2 = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Signed change from bearing a to b, in [-180, 180]."""
    d = b - a
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def project_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Share of the way from a to b of the point nearest to p in the degree plane, clamped to [0, 1]."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    return F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / length)))


def cell(x: Column, size_e5: int) -> Column:
    """Grid column or row of a coordinate in 1e-5 degrees."""
    return F.floor(x / size_e5).cast("long")


def line_length(points: Column) -> Column:
    """Metres along an array of (lon, lat) structs."""
    legs = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.aggregate(legs, F.lit(0.0), lambda acc, d: acc + d)
