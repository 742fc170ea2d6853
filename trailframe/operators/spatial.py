"""Spatial selections and nearest neighbours by grid cells: equi-joins on cells, no theta joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions.geometry import cell, haversine

METERS_PER_DEGREE = 111_320.0


def segment_distance(px: Column, py: Column, ax: float, ay: float, bx: float, by: float) -> Column:
    """Metres from a point to a segment, in the plane tangent at the segment's middle latitude."""
    scale = F.cos(F.radians(F.lit((ay + by) / 2)))
    x, y, dx, dy = (px - ax) * scale, py - ay, (bx - ax) * scale, F.lit(by - ay)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x * dx + y * dy) / (dx * dx + dy * dy)))
    return F.hypot(x - t * dx, y - t * dy) * METERS_PER_DEGREE


def in_corridor(nodes: DataFrame, line: list[tuple[float, float]], meters: float) -> DataFrame:
    """Nodes (node_id, lon_e5, lat_e5) within `meters` of a polyline; the line is part of the request and so a constant."""
    near = [segment_distance(F.col("lon_e5") / 1e5, F.col("lat_e5") / 1e5, *a, *b) <= meters for a, b in zip(line, line[1:])]
    return nodes.where(F.array_contains(F.array(*near), True))


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among `nodes`: one semi-join for each end, and each edge once."""
    ends = lambda end: nodes.select(F.col("node_id").alias(end))
    first = edges.join(ends("a"), "a", "left_semi").select(edges.columns)
    rest = edges.join(ends("a"), "a", "left_anti").join(ends("b"), "b", "left_semi").select(edges.columns)
    return first.unionByName(rest)


def in_ellipse(nodes: DataFrame, a: tuple[float, float], b: tuple[float, float], direct_m: float, factor: float) -> DataFrame:
    """Nodes by which a way from a to b is at most `factor` times the direct one."""
    lon, lat = F.col("lon_e5") / 1e5, F.col("lat_e5") / 1e5
    to = lambda p: haversine(F.lit(p[0]), F.lit(p[1]), lon, lat)
    return nodes.where(to(a) + to(b) <= factor * direct_m * (1 + 1e-7))


def nearest(points: DataFrame, nodes: DataFrame, limit_e5: int) -> DataFrame:
    """(point_id, node_id, d2): the nearest node within `limit_e5` (1e-5 degrees) of each point (point_id, x, y); ties to the smallest node_id.

    Each point asks the 3 x 3 cells around it; a partial aggregate keeps one candidate, so dense cells send one row for each point."""
    indexed = nodes.select("node_id", "lon_e5", "lat_e5", cell(F.col("lon_e5"), limit_e5).alias("cx"), cell(F.col("lat_e5"), limit_e5).alias("cy"))
    around = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    asked = points.select("point_id", "x", "y", F.explode(around).alias("d")).select("point_id", "x", "y", (cell(F.col("x"), limit_e5) + F.col("d.dx")).alias("cx"), (cell(F.col("y"), limit_e5) + F.col("d.dy")).alias("cy"))
    dx, dy = F.col("x") - F.col("lon_e5"), F.col("y") - F.col("lat_e5")
    found = asked.join(indexed, ["cx", "cy"]).select("point_id", "node_id", (dx * dx + dy * dy).alias("d2")).where(F.col("d2") <= limit_e5 * limit_e5)
    best = found.groupBy("point_id").agg(F.min(F.struct("d2", "node_id")).alias("best"))
    return best.select("point_id", "best.node_id", "best.d2")
