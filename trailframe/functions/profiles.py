"""Costs of a step by profile: weights of surfaces and road classes, detours from the goal, town centres."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.functions.geometry import haversine

# Weights by profile and surface, by profile and road class; km/h by surface.
SURFACE_WEIGHTS = {
    "direct": {"paved": 2.35, "gravel": 0.88, "access": 0.78, "track": 0.68, "unknown": 0.8},
    "balanced": {"paved": 1.72, "gravel": 0.94, "access": 0.9, "track": 0.86, "unknown": 0.98},
    "dirt": {"paved": 14.0, "gravel": 0.55, "access": 0.35, "track": 0.24, "unknown": 0.4},
    "cleanest": {"paved": 1.0, "gravel": 8.0, "access": 10.0, "track": 14.0, "unknown": 6.0},
}
CLASSES = ("freeway", "arterial", "collector", "ramp", "local", "service", "resource", "recreation", "track", "double_track", "unknown")
CLASS_WEIGHTS = {
    "direct": (2.7, 2.25, 1.06, 2.4, 0.92, 1.18, 0.88, 0.86, 0.82, 0.82, 1.0),
    "balanced": (2.6, 2.15, 1.02, 2.3, 0.9, 1.22, 0.88, 0.86, 0.84, 0.84, 1.0),
    "dirt": (3.4, 2.85, 1.05, 3.0, 0.88, 1.28, 0.8, 0.78, 0.72, 0.72, 1.0),
    "cleanest": (0.94, 0.95, 0.97, 0.96, 1.0, 1.08, 1.0, 1.0, 1.0, 1.0, 1.0),
}
SPEED_KMH = {"paved": 70, "gravel": 45, "access": 35, "track": 25, "unknown": 30}
# By profile, the factors of town centres, of unknown access, of provincial roads; price of a kilometre away from the goal, near it and far.
TOWN_FACTOR = {"dirt": 5.5, "balanced": 4.2, "direct": 3.6}
UNKNOWN_FACTOR = {"dirt": 0.5, "direct": 0.78, "balanced": 0.9}
PROVINCIAL_FACTOR = {"dirt": 0.68, "direct": 0.86, "balanced": 0.93}
AWAY_PRICE = {"cleanest": (6.5, 3.2), "direct": (9.0, 3.5), "balanced": (5.5, 3.2), "dirt": (1.4, 0.0)}
ACCESS_AWAY_PRICE = {"direct": 10.0, "balanced": 3.5, "dirt": 1.2}
PROVINCIAL_SOURCE, PROVINCIAL_ID = "(?i)nstdb|topographic|forest roads", "^(ns-|nb-fr)"
# Boxes of town centres (south, north, west, east) and how far north of one a point is moved.
TOWNS = (
    (44.55, 44.78, -63.75, -63.4, 0.4), (45.4, 45.72, -73.98, -73.4, 0.28), (43.55, 43.85, -79.55, -79.15, 0.35), (45.85, 46.2, -64.95, -64.55, 0.2),
    (45.88, 46.1, -64.45, -64.28, 0.15), (45.78, 45.9, -64.28, -64.12, 0.12), (45.952, 45.978, -66.665, -66.618, 0.18), (45.2, 45.35, -66.2, -65.95, 0.18),
    (47.3, 47.45, -68.45, -68.2, 0.2), (46.75, 46.9, -71.35, -71.1, 0.2), (45.42, 45.5, -75.78, -75.68, 0.18), (46.228, 46.248, -63.145, -63.11, 0.12),
    (46.385, 46.405, -63.81, -63.77, 0.1), (43.62, 43.68, -79.42, -79.35, 0.22), (45.41, 45.44, -75.72, -75.68, 0.16), (49.88, 49.91, -97.16, -97.12, 0.14),
    (50.44, 50.46, -104.63, -104.6, 0.12), (52.12, 52.14, -106.68, -106.65, 0.12), (51.03, 51.06, -114.09, -114.05, 0.16), (53.53, 53.55, -113.51, -113.48, 0.16),
    (49.27, 49.3, -123.14, -123.1, 0.14), (48.42, 48.44, -123.38, -123.35, 0.12),
)
ELLIPSE = {"cleanest": 1.25, "direct": 1.28, "balanced": 1.28, "dirt": 2.6}


def _listed(values: dict) -> Column:
    return F.create_map(*(x if isinstance(x, Column) else F.lit(x) for kv in values.items() for x in kv))


def by_name(name: Column, values: dict, otherwise: float = 1.0) -> Column:
    """The value listed for a name: one look-up in a constant. A chain of comparisons makes the code generated for a step so long
    (over 8000 bytes) that the JVM doesn't compile it."""
    return F.coalesce(F.try_element_at(_listed(values), name), F.lit(otherwise))


def surface_weight(surface: Column, profile: Column) -> Column:
    """Other profiles weigh surfaces as the balanced one does."""
    each = {p: _listed(w) for p, w in SURFACE_WEIGHTS.items()}
    own = F.coalesce(F.try_element_at(_listed(each), profile), each["balanced"])
    return F.coalesce(F.try_element_at(own, surface), F.try_element_at(own, F.lit("unknown")))


def class_weight(road_class: Column, profile: Column) -> Column:
    own = F.try_element_at(_listed({p: _listed(dict(zip(CLASSES, w))) for p, w in CLASS_WEIGHTS.items()}), profile)
    return F.coalesce(F.try_element_at(own, F.coalesce(road_class, F.lit("unknown"))), F.lit(1.0))


def greatest_weight(profile: str) -> float:
    """The most that surface and class can weigh together."""
    return max(SURFACE_WEIGHTS.get(profile, SURFACE_WEIGHTS["balanced"]).values()) * max(CLASS_WEIGHTS.get(profile, (1.0,)))


def in_town(lon: Column, lat: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (lat.between(s, n) & lon.between(w, e) for s, n, w, e, _ in TOWNS)), F.lit(False))


def nudged_off_towns(lon: Column, lat: Column) -> Column:
    """The latitude of a point moved north of each town centre that it lies in, one box after another."""
    boxes = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("south", "north", "west", "east", "step"), box))) for box in TOWNS))
    return F.aggregate(boxes, lat, lambda at, b: F.when((at >= b["south"]) & (at <= b["north"]) & (lon >= b["west"]) & (lon <= b["east"]), b["north"] + b["step"]).otherwise(at))


def moved_off_towns(lon: float, lat: float) -> float:
    """As nudged_off_towns, of a fixed place."""
    for south, north, west, east, step in TOWNS:
        lat = north + step if south <= lat <= north and west <= lon <= east else lat
    return lat


#: Columns of what a step's cost needs of places: metres from its ends and from the request's start to the goal, and whether it is in a town centre.
PLACES = ("_before", "_after", "_direct", "_town")


def places(at: tuple[Column, Column], to: tuple[Column, Column], start: tuple[Column, Column], end: tuple[Column, Column]) -> dict[str, Column]:
    """The columns PLACES of a step from `at` to `to` of a request from `start` to `end`. Costs use each of them often, so they go
    into a projection of their own. A town centre within 2.5 km of one of the request's ends doesn't count."""
    mid = ((at[0] + to[0]) / 2, (at[1] + to[1]) / 2)
    near = (haversine(*mid, *start) < 2500) | (haversine(*mid, *end) < 2500)
    return dict(zip(PLACES, (haversine(*at, *end), haversine(*to, *end), haversine(*start, *end), F.when(in_town(*mid), ~near).otherwise(False))))


def is_provincial(edge_id: Column, source: Column) -> Column:
    """Whether an edge is a provincial road, by its id or its source."""
    return F.coalesce(edge_id.rlike(PROVINCIAL_ID), F.lit(False)) | F.coalesce(source.rlike(PROVINCIAL_SOURCE), F.lit(False))


def step_cost(meters: Column, surface: Column, road_class: Column, access: Column, provincial: Column, profile: Column, unknown: Column,
              leg: Column | None = None, stitch: Column | None = None) -> Column:
    """The cost of a step, given its columns `places`.

    Kilometres are weighed by surface and class; where unknown access is allowed, all profiles but the clean one
    favour it and provincial roads, and the balanced one evens surfaces out. Town centres multiply, and metres away
    from the goal are added. A `leg` between a point and its road (or a stitch) has kilometres, town centres and
    metres away only."""
    before, after, direct, town = map(F.col, PLACES)
    km = meters / 1000
    favoured = unknown & (profile != "cleanest")
    cost = km * surface_weight(surface, profile) * class_weight(road_class, profile)
    cost = cost * F.when(favoured & (access == "motorized_unknown"), by_name(profile, UNKNOWN_FACTOR, UNKNOWN_FACTOR["balanced"])).otherwise(1.0)
    cost = cost * F.when(favoured & provincial, by_name(profile, PROVINCIAL_FACTOR, PROVINCIAL_FACTOR["balanced"])).otherwise(1.0)
    cost = cost * F.when(favoured & (profile == "balanced"), F.when(surface == "paved", 0.9).when(surface.isin("gravel", "access", "track"), 1.06).otherwise(1.0)).otherwise(1.0)
    towns = F.when((profile != "cleanest") & town, by_name(profile, TOWN_FACTOR, TOWN_FACTOR["direct"])).otherwise(1.0)
    away = after - before
    near = before < F.greatest(F.lit(2800.0), direct * 0.28)
    price = lambda k: by_name(profile, {p: v[k] for p, v in AWAY_PRICE.items()}, 0.0)
    cost = cost * towns + F.when(away > 50, away / 1000 * F.when(near, price(0)).otherwise(price(1))).otherwise(0.0)
    if leg is None:
        return cost
    detour = (profile != "cleanest") & (away > 60) & (before < F.greatest(F.lit(3500.0), direct * 0.3))
    on_leg = km * F.when(F.lit(False) if stitch is None else stitch, 12.0).otherwise(1.0) + F.when(detour, away / 1000 * by_name(profile, ACCESS_AWAY_PRICE, ACCESS_AWAY_PRICE["dirt"])).otherwise(0.0)
    return F.when(leg, on_leg * towns).otherwise(cost)
