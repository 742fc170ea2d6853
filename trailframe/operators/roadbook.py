"""Roadbook of routes: evenly dense points, smoothed bearings, curves, turns and the cues made of them.

A route is (route, i, lon, lat). Bearings and rates are windows over a route's points; what depends on the choice made
before (where a curve ends, which of two near cues stays) is folded over the points or cues of one route."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.cues import curve_number, severity
from trailframe.functions.geometry import angle_between, bearing, haversine
from trailframe.functions.labels import curve_words

# Metres between dense points, points on each side of the mean; rates (degrees a point) at which a curve
# starts and goes on, and that of its core; quiet points inside; least turn, length; metres apart of cues, of cues at a turn.
STEP_M, AROUND, START_RATE, GOES_ON, CORE_RATE, QUIET, LEAST_TURN, LEAST_M, APART_M, TURN_M = 15.0, 3, 1.0, 0.18, 0.4, 2, 15.0, 18.0, 40.0, 70.0
CORE = (0.08, 0.92)
# Least turn of a bend and metres between bends; least turn of its numbers.
BEND_DEG, BEND_APART_M, BEND_NUMBERS = 35.0, 90.0, ((135, 6), (100, 5), (70, 4), (50, 3))


def densified(points: DataFrame, step: float = STEP_M) -> DataFrame:
    """The points of each route and others between, at most `step` metres apart; numbered anew from 0."""
    w = Window.partitionBy("route").orderBy("i")
    legs = points.select("route", "i", "lon", "lat", F.lag("lon").over(w).alias("x"), F.lag("lat").over(w).alias("y"))
    steps = F.greatest(F.lit(1), F.ceil(haversine(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")) / step).cast("int"))
    parts = F.when(F.col("x").isNull(), F.array(F.lit(1.0))).otherwise(F.transform(F.sequence(F.lit(1), steps), lambda s: s / steps))
    rows = legs.select("route", "i", F.coalesce("x", "lon").alias("x0"), F.coalesce("y", "lat").alias("y0"), "lon", "lat", F.explode(parts).alias("t"))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("t")
    return rows.select("route", (F.row_number().over(Window.partitionBy("route").orderBy("i", "t")) - 1).alias("i"), at("x0", "lon").alias("to_lon"), at("y0", "lat").alias("to_lat")).toDF("route", "i", "lon", "lat")


def rates(points: DataFrame) -> DataFrame:
    """Points with `along` (metres), `raw` and smoothed `bearing`, and `rate`, the turn since the point before (0 at the first)."""
    w = Window.partitionBy("route").orderBy("i")
    last = lambda c: F.lag(c).over(w)
    leg = F.coalesce(haversine(last("lon"), last("lat"), F.col("lon"), F.col("lat")), F.lit(0.0))
    out = bearing(F.col("lon"), F.col("lat"), F.lead("lon").over(w), F.lead("lat").over(w))
    rows = points.select("*", leg.alias("leg"), out.alias("out"))
    rows = rows.select("*", F.sum("leg").over(w).alias("along"), F.coalesce("out", last("out")).alias("raw"))
    near = w.rowsBetween(-AROUND, AROUND)
    mean = lambda f: F.avg(f(F.radians("raw"))).over(near)
    rows = rows.select("*", F.pmod(F.degrees(F.atan2(mean(F.sin), mean(F.cos))), F.lit(360.0)).alias("bearing"))
    return rows.select("route", "i", "lon", "lat", "along", "raw", "bearing", F.coalesce(angle_between(last("bearing"), F.col("bearing")), F.lit(0.0)).alias("rate"))


def curve_spans(rate: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(first, last, core's first, core's last, signed degrees) of the curves in a route's rates.

    A curve starts at a rate of START_RATE and takes the following points of its direction, as long as no more than
    QUIET others lie between two of them; the search goes on behind those. Its core is where the turn goes from 8 to
    92 per cent of the whole."""
    found, size, strong = [], np.abs(rate), np.flatnonzero(np.abs(rate) >= CORE_RATE)
    members = {s: np.flatnonzero((np.sign(rate) == s) & (size >= GOES_ON)) for s in (-1.0, 1.0)}
    starts, at = np.flatnonzero(size >= START_RATE), 1
    while (k := np.searchsorted(starts, at)) < len(starts):
        first = int(starts[k])
        sign = float(np.sign(rate[first]))
        own = members[sign][np.searchsorted(members[sign], first) :]
        broken = np.flatnonzero(np.diff(own) > QUIET + 1)
        own = own[: broken[0] + 1] if len(broken) else own
        last, total = int(own[-1]), float(size[own].sum())
        inside = strong[np.searchsorted(strong, first) : np.searchsorted(strong, last, side="right")]
        sums = np.cumsum(size[inside])
        inside, before = inside[: np.searchsorted(sums, CORE[1] * total) + 1], (sums - size[inside])[: np.searchsorted(sums, CORE[1] * total) + 1]
        low = np.flatnonzero(before < CORE[0] * total)
        found.append((first, last, int(inside[low[-1]]) if len(low) else first, int(inside[-1]) if len(inside) else last, sign * total))
        at = last + QUIET + 1
    return found


def curves(points: DataFrame) -> DataFrame:
    """(route, along_m, apex_m, end_m, side, number, severity, degrees, length_m, text, spoken) of the curves of routes of at least six dense points."""

    def spans(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("i").to_numpy())
        rate, along = (group.column(c).to_numpy()[order] for c in ("rate", "along"))
        rows = curve_spans(rate) if len(rate) >= 6 else []
        apex = [min(len(rate) - 1, int(np.floor((a + b) / 2 + 0.5))) for _, _, a, b, _ in rows]
        return pa.table({
            "route": pa.array([group.column("route")[0].as_py()] * len(rows), pa.int64()), "along_m": pa.array([along[a] for a, *_ in rows], pa.float64()), "apex_m": pa.array(along[apex] if rows else [], pa.float64()),
            "end_m": pa.array([along[b] for _, b, *_ in rows], pa.float64()), "core_m": pa.array([along[d] - along[c] for _, _, c, d, _ in rows], pa.float64()), "turn": pa.array([t for *_, t in rows], pa.float64())})

    found = rates(densified(points)).select("route", "i", "along", "rate").groupBy("route").applyInArrow(spans, "route long, along_m double, apex_m double, end_m double, core_m double, turn double")
    rows = found.withColumns({"degrees": F.abs("turn"), "length_m": F.greatest(F.lit(LEAST_M / 2), "core_m"), "side": F.when(F.col("turn") > 0, "right").otherwise("left")})
    rows = rows.withColumn("number", curve_number(F.col("degrees"), F.col("length_m"))).where((F.col("end_m") - F.col("along_m") >= LEAST_M) & (F.col("degrees") >= LEAST_TURN) & F.col("number").isNotNull())
    words = curve_words(F.col("side"), F.col("number"))
    kept = pruned(rows.select("route", "along_m", "apex_m", "end_m", "side", F.col("number").cast("int").alias("number"), "degrees", "length_m"))
    return kept.select("*", severity(F.col("number")).alias("severity"), words["text"].alias("text"), words["spoken"].alias("spoken"))


def _folded(rows: DataFrame, fields: list[str], stays) -> DataFrame:
    """A fold over each route's rows in the order of `fields`: `stays(last, row)` says whether a row joins ('add'), takes the
    last one's place ('swap') or goes."""
    each = rows.groupBy("route").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    none = F.slice(F.col("rows"), 1, 0)

    def step(acc: Column, row: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        what = F.when(F.size(acc) == 0, "add").otherwise(stays(last, row))
        return F.when(what == "add", F.concat(acc, F.array(row))).when(what == "swap", F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(row))).otherwise(acc)

    return each.select("route", F.explode(F.aggregate("rows", none, step)).alias("r")).select("route", "r.*")


def pruned(found: DataFrame, apart: float = APART_M) -> DataFrame:
    """Curves of which none starts less than `apart` metres behind the one before; of two such the tighter stays."""
    fields = ["along_m", *(c for c in found.columns if c not in ("route", "along_m"))]
    return _folded(found, fields, lambda last, row: F.when(row["along_m"] - last["along_m"] >= apart, "add").when(row["number"] < last["number"], "swap").otherwise("drop"))


def merged_cues(found: DataFrame, turns: DataFrame) -> DataFrame:
    """(route, along_m, kind, side, number, degrees) of curves and turns (route, along_m, side, degrees) together.

    Within 70 metres a turn goes before a curve, the sharper of two turns and the tighter of two curves stay."""
    kind = lambda df, name, number: df.select("route", "along_m", F.lit(name).alias("kind"), "side", number.alias("number"), F.col("degrees").cast("double").alias("degrees"))
    rows = kind(found, "curve", F.col("number").cast("int")).unionByName(kind(turns, "junction", F.lit(None).cast("int")))

    def stays(last: Column, row: Column) -> Column:
        near = F.abs(row["along_m"] - last["along_m"]) < TURN_M
        turn, was = row["kind"] == "junction", last["kind"] == "junction"
        better = F.when(turn & ~was, True).when(~turn & was, False).when(turn, F.coalesce(row["degrees"], F.lit(0.0)) > F.coalesce(last["degrees"], F.lit(0.0))).otherwise(row["number"] < last["number"])
        return F.when(~near, "add").when(better, "swap").otherwise("drop")

    return _folded(rows, ["along_m", "kind", "side", "number", "degrees"], stays)


def turn_angles(points: DataFrame) -> DataFrame:
    """(route, i, along_m, delta) of the inner points of each route: the turn there, in the plane of degrees."""
    w = Window.partitionBy("route").orderBy("i")
    last, after = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    way = lambda x0, y0, x1, y1: F.degrees(F.atan2(x1 - x0, y1 - y0))
    into, out = way(last("lon"), last("lat"), F.col("lon"), F.col("lat")), way(F.col("lon"), F.col("lat"), after("lon"), after("lat"))
    leg = F.coalesce(haversine(last("lon"), last("lat"), F.col("lon"), F.col("lat")), F.lit(0.0))
    rows = points.select("route", "i", leg.alias("leg"), angle_between(into, out).alias("delta"))
    return rows.select("route", "i", F.sum("leg").over(w).alias("along_m"), "delta")


def maneuvers(points: DataFrame) -> DataFrame:
    """(route, along_m, kind, side, number, degrees): bends of at least 35 degrees, at least 90 metres behind the bend before, and the arrival."""
    angles = turn_angles(points)
    number = F.lit(2)
    for least, n in reversed(BEND_NUMBERS):
        number = F.when(F.abs("delta") >= least, n).otherwise(number)
    bends = angles.where(F.abs("delta") >= BEND_DEG).select("route", "along_m", F.lit("bend").alias("kind"), F.when(F.col("delta") > 0, "right").otherwise("left").alias("side"), number.alias("number"), F.floor(F.abs("delta") + 0.5).cast("long").alias("degrees"))
    kept = _folded(bends, ["along_m", "kind", "side", "number", "degrees"], lambda last, row: F.when(row["along_m"] - last["along_m"] >= BEND_APART_M, "add").otherwise("drop"))
    arrival = angles.groupBy("route").agg(F.max("along_m").alias("along_m")).select("route", "along_m", F.lit("arrive").alias("kind"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("long").alias("degrees"))
    return kept.unionByName(arrival).withColumn("along_m", F.floor(F.col("along_m") + 0.5).cast("long"))


def metres_to_cue(rider_km: Column, cue_km: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((cue_km - rider_km) * 1000 + 0.5)).cast("long")
