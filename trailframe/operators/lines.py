"""Operators on lines as arrays of points (lon, lat), and lines cut, joined, measured and written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.geometry import haversine
from trailframe.functions.network_rules import escaped_xml

# Metres from the goal within which a line is there, and metres that it goes on for before it is cut; points
# of a line that may be cut; degrees of the first tolerance, its growth, tries and points left; metres of a turn back.
CLOSE_M, WANDER_M, LEAST_POINTS = 100.0, 160.0, 5
TOLERANCE, GROWTH, TRIES, MOST_POINTS = 1e-5, 1.8, 14, 80


def _once(value: Column, body) -> Column:
    """`body` with a value that is computed once."""
    return F.aggregate(F.array(), value, lambda acc, _: acc, body)


def without_repeats(line: Column) -> Column:
    """The points that differ from the one before."""
    return _once(line, lambda points: F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1))))


def joined(parts: Column) -> Column:
    """One line of several, each of which but the first loses its first point."""
    return F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.slice(p, 2, 2**30))))


def up_to(line: Column, segment: Column, point: Column) -> Column:
    """The line as far as a point on the segment (from 0)."""
    return without_repeats(F.concat(F.slice(line, F.lit(1), segment + 1), F.array(point)))


def from_on(line: Column, segment: Column, point: Column) -> Column:
    """The line from a point on the segment on."""
    return without_repeats(F.concat(F.array(point), F.slice(line, segment + 2, F.lit(2**30))))


def between(line: Column, segment1: Column, point1: Column, along1: Column, segment2: Column, point2: Column, along2: Column) -> Column:
    """The line between two points on it, from the first to the second, backwards too."""
    part = lambda s, p, t, q: without_repeats(F.concat(F.array(p), F.slice(line, s + 2, t - s), F.array(q)))
    return F.when(along1 <= along2, part(segment1, point1, segment2, point2)).otherwise(F.reverse(part(segment2, point2, segment1, point1)))


def measured(points: DataFrame) -> DataFrame:
    """Points (route, i, lon, lat, goal_lon, goal_lat) with the metres `along` and `left`, and the distance `to_goal`."""
    w = Window.partitionBy("route").orderBy("i")
    leg = F.coalesce(haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    rows = points.withColumns({"leg": leg, "to_goal": haversine(F.col("lon"), F.col("lat"), F.col("goal_lon"), F.col("goal_lat"))})
    rows = rows.withColumns({"along": F.sum("leg").over(w), "total": F.sum("leg").over(Window.partitionBy("route"))})
    return rows.withColumn("left", F.col("total") - F.col("along")).drop("leg")


def trimmed(points: DataFrame) -> DataFrame:
    """Lines that came within 100 metres of their goal and went on for at least 160 end at their nearest point (the first of equal ones) and the goal.

    Lines of fewer than five points stay. Points (route, i, lon, lat, goal_lon, goal_lat), (route, i, lon, lat) out."""
    rows = measured(points)
    nearest = rows.groupBy("route").agg(F.min(F.struct("to_goal", "i")).alias("near"), F.count("*").alias("n"), F.first("goal_lon").alias("goal_lon"), F.first("goal_lat").alias("goal_lat"))
    cut = rows.select("route", F.col("i").alias("at"), "left", "lon", "lat").join(nearest, "route").where((F.col("near.i") == F.col("at")) & (F.col("near.to_goal") <= CLOSE_M) & (F.col("left") >= WANDER_M) & (F.col("n") >= LEAST_POINTS))
    kept = rows.join(cut.select("route", "at"), "route", "left").where("at IS NULL OR i <= at").select("route", "i", "lon", "lat")
    goal = cut.where("lon <> goal_lon OR lat <> goal_lat").select("route", (F.col("at") + 1).alias("i"), F.col("goal_lon").alias("lon"), F.col("goal_lat").alias("lat"))
    return kept.unionByName(goal)


def metrics(points: DataFrame) -> DataFrame:
    """By route: metres, the least distance to the goal, metres behind that place, and how far north of the goal it goes (degrees)."""
    rows = measured(points)
    best = rows.groupBy("route").agg(F.max("total").alias("meters"), F.min(F.struct("to_goal", "i")).alias("near"), F.min_by("left", F.struct("to_goal", "i")).alias("behind"), F.max(F.col("lat") - F.col("goal_lat")).alias("north"))
    return best.select("route", "meters", F.col("near.to_goal").alias("nearest"), "behind", "north")


def simplified(points: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """(route, segment, i, lon, lat): the points that Douglas-Peucker keeps of each segment, with the least tolerance of 1e-5 * 1.8 ** k degrees
    that leaves at most `most` points of a route, or the last of 14 tries. One route is one group."""
    import numpy as np
    import pandas as pd

    def kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
        keep = np.zeros(len(x), bool)
        keep[[0, -1]] = True
        stack = [(0, len(x) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            dx, dy, px, py = x[b] - x[a], y[b] - y[a], x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
            long = dx * dx + dy * dy
            t = np.clip((px * dx + py * dy) / long, 0, 1) if long else np.zeros(b - a - 1)
            off = np.hypot(px - t * dx, py - t * dy)
            k = int(off.argmax())
            if off[k] > tolerance:
                keep[a + 1 + k] = True
                stack += [(a, a + 1 + k), (a + 1 + k, b)]
        return keep

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["segment", "i"])
        parts = [g for _, g in rows.groupby("segment")]
        for k in range(TRIES):
            out = [g[kept(g["lon"].to_numpy(), g["lat"].to_numpy(), TOLERANCE * GROWTH**k)] for g in parts]
            if sum(map(len, out)) <= most:
                break
        return pd.concat(out)

    return points.select("route", "segment", "i", "lon", "lat").groupBy("route").applyInPandas(run, "route long, segment long, i long, lon double, lat double")


def as_geojson(points: DataFrame) -> DataFrame:
    """(route, feature): a LineString, or a MultiLineString of a route of several segments."""
    lines = points.groupBy("route", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"])).alias("line"))
    each = lines.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("segment", "line"))).alias("lines"))
    every = F.transform("lines", lambda x: x["line"])
    one = F.to_json(F.struct(F.lit("LineString").alias("type"), every[0].alias("coordinates")))
    geometry = F.when(F.size("lines") == 1, one).otherwise(F.to_json(F.struct(F.lit("MultiLineString").alias("type"), every.alias("coordinates"))))
    return each.select("route", F.concat(F.lit('{"type":"Feature","properties":{"route":'), F.col("route").cast("string"), F.lit('},"geometry":'), geometry, F.lit("}")).alias("feature"))


def as_gpx(points: DataFrame, name: Column) -> DataFrame:
    """(route, gpx): tracks with their segments; names are escaped."""
    place = F.concat(F.lit('<trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('"></trkpt>'))
    segments = points.groupBy("route", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", place.alias("p")))), lambda x: x["p"]), "").alias("body"))
    each = segments.groupBy("route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "body"))), lambda s: F.concat(F.lit("<trkseg>"), s["body"], F.lit("</trkseg>"))), "").alias("body"))
    return each.select("route", F.concat(F.lit('<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'), escaped_xml(name), F.lit("</name>"), "body", F.lit("</trk></gpx>")).alias("gpx"))


def split_at_shared(points: DataFrame) -> DataFrame:
    """(line, part, i, x, y): lines (line, i, x, y) cut at the vertices that are used twice or more, those belonging to both parts."""
    shared = points.groupBy("x", "y").agg(F.count("*").alias("uses")).where("uses > 1").select("x", "y", F.lit(True).alias("cut"))
    w = Window.partitionBy("line").orderBy("i")
    ends = points.withColumns({"first": F.row_number().over(w) == 1, "last": F.lead("i").over(w).isNull()})
    marked = ends.join(shared, ["x", "y"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)) & ~F.col("first") & ~F.col("last"))
    before = F.coalesce(F.sum(F.col("cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = marked.withColumn("part", before)
    both = F.when(F.col("cut"), F.array("part", F.col("part") + 1)).otherwise(F.array("part"))
    return rows.select("line", F.explode(both).alias("part"), "i", "x", "y")


def rejoined(detour: DataFrame, original: DataFrame) -> DataFrame:
    """(report, edge_id, detour_seq, original_seq): the first edge of each detour that the original, behind the report, has too."""
    both = detour.select("report", "edge_id", F.col("seq").alias("detour_seq")).join(original.where("seq > report_seq").select("report", "edge_id", F.col("seq").alias("original_seq")), ["report", "edge_id"])
    return both.groupBy("report").agg(F.min(F.struct("detour_seq", "original_seq", "edge_id")).alias("first")).select("report", "first.*")


def chained(hops: DataFrame) -> DataFrame:
    """A row for each chain of hops (chain, hop, ok, meters, moving, dirt_m, from, to): all hops' sums, or the first hop that failed."""
    failed = F.min(F.when(~F.col("ok"), F.struct("hop", "from", "to")))
    rows = hops.groupBy("chain").agg(F.count("*").alias("hops"), failed.alias("failed"), F.sum("meters").alias("meters"), F.sum("moving").alias("moving"), F.sum("dirt_m").alias("dirt_m"))
    fine = F.col("failed").isNull()
    share = F.when(F.col("meters") > 0, F.floor(F.col("dirt_m") / F.col("meters") * 100 + 0.5)).otherwise(0).cast("long")
    return rows.select("chain", "hops", F.when(fine, F.lit("ok")).otherwise("chain_hop_failed").alias("status"), F.col("failed.hop").alias("failed_hop"), *(F.when(fine, F.col(c)).alias(c) for c in ("meters", "moving")), F.when(fine, share).alias("dirt_percent"))
