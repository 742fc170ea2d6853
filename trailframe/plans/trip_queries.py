"""Queries of trips and roadbooks, with the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.operators import roadbook, trips

#: Dealt to lineitems by line number and return flag: surfaces (null: not known) and access classes.
KINDS = ["paved", "gravel", "access", "resource", "track", "double_track", "single", "unknown", None]
PERCENTS = {"paved": 40.0, "gravel": 25.0, "access": 10.0, "track": 15.0, "unknown_surface": 10.0, "verified_access": 20.0, "permissive_access": 50.0, "unknown_access": 30.0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stages of their customers' trips; lineitems are the segments of a route."""
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    kind = F.get(F.array(*(F.lit(k).cast("string") for k in KINDS)), F.col("l_linenumber") % len(KINDS))
    access = F.when(F.col("l_returnflag") == "A", "motorized_verified").when(F.col("l_returnflag") == "N", "motorized_permissive")
    parts = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_quantity") * 100).alias("meters"), kind.alias("surface"), access.alias("access"))).alias("segments"))
    warning = lambda code, n: F.when(key % n == 0, F.struct(F.lit(code).alias("code"), F.concat(F.lit("in stage "), text).alias("message")))
    end = F.when(key % 23 != 0, F.lit(-66.0) + (key % 3) / 100.0)
    distance = (200 + F.floor("o_totalprice") % 2000).cast("double")
    rows = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("trip"), key.alias("stage"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(key)).alias("position"), (F.lit(-66.0) + (key % 4) / 100.0).alias("start_lng"), F.lit(44.0).alias("start_lat"),
        end.alias("end_lng"), F.when(end.isNotNull(), 44.0).alias("end_lat"), (F.col("o_orderstatus").isin("F", "P") & end.isNotNull()).alias("complete"), distance.alias("distance"), (distance * 20).alias("moving"), F.when(key % 2 == 0, distance * 25).alias("elapsed"),
        F.map_from_arrays(F.array(*map(F.lit, PERCENTS)), F.array(*map(F.lit, PERCENTS.values()))).alias("percents"), F.array_compact(F.array(warning("unknown_access_used", 5), warning("avoided_edges", 3))).alias("warnings"))
    return rows.join(parts, F.col("stage") == F.col("l_orderkey"), "left").drop("l_orderkey")


def a13_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trips.breakdown(stages(spark, sf_dir))
    return rows.select("stage", *(F.round(c, 3).alias(c) for c in ("elapsed", "dirt_m", *(f"{n}_m" for n in (*trips.SURFACES, *trips.ACCESSES)))))


def a14_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.aggregate(stages(spark, sf_dir))


def a15_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.warnings(stages(spark, sf_dir))


def w11_stage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.gaps(stages(spark, sf_dir))


def x05_saved_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that come back from saved trips; every fifth document is of another version, every eleventh broken."""
    saved = trips.saved(stages(spark, sf_dir))
    other = F.when(F.col("trip") % 5 == 0, F.replace("document", F.lit('"schemaVersion":1'), F.lit('"schemaVersion":9'))).when(F.col("trip") % 11 == 0, F.lit("{")).otherwise(F.col("document"))
    return trips.restored(saved.select(other.alias("document"))).groupBy("error", "trip").agg(F.count("stage").alias("stages"), F.count_if("complete").alias("complete"), F.round(F.sum("distance"), 3).alias("distance"))


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A winding line of forty points for each supplier."""
    k, i = F.col("s_suppkey"), F.col("i")
    wave = F.lit(0.0015) * F.sin(i * (k % 7 + 1) / 6.0)
    rows = _table(spark, sf_dir, "supplier").select(k, F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
    return rows.select(k.alias("route"), "i", (F.lit(-66.0) + i * 0.0006 + F.when(k % 2 == 0, wave).otherwise(0.0)).alias("lon"), (F.lit(44.0) + i * 0.0004 + F.when(k % 2 == 1, wave).otherwise(0.0)).alias("lat"))


def w02_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearings, their means and the turn at each dense point of a route (G16, G17, W1 to W3)."""
    near = lambda c, n: F.round(c, n).alias(c)
    return roadbook.rates(roadbook.densified(route_points(spark, sf_dir))).select("route", "i", near("along", 2), near("bearing", 4), near("rate", 4))


def w04_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roadbook.curves(route_points(spark, sf_dir))


def w07_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves and the turns of at least 15 degrees at every fifth point, merged."""
    points = route_points(spark, sf_dir)
    turns = roadbook.turn_angles(points).where((F.col("i") % 5 == 2) & (F.abs("delta") >= 15)).select("route", "along_m", F.when(F.col("delta") > 0, "right").otherwise("left").alias("side"), F.abs("delta").alias("degrees"))
    return roadbook.merged_cues(roadbook.curves(points), turns)


def w08_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roadbook.turn_angles(route_points(spark, sf_dir)).select("route", "i", F.round("along_m", 2).alias("along_m"), F.round("delta", 4).alias("delta"))


def w09_maneuvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roadbook.maneuvers(route_points(spark, sf_dir))


def w10_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(key, roadbook.metres_to_cue((key % 50) / 10.0, (key * 7 % 60) / 8.0).alias("metres"))


QUERIES = {
    "A13_breakdowns": a13_breakdowns, "A14_trips": a14_trips, "A15_warnings": a15_warnings, "W11_stage_gaps": w11_stage_gaps, "X05_saved_trips": x05_saved_trips, "W02_rates": w02_rates, "W04_curves": w04_curves,
    "W07_cues": w07_cues, "W08_turns": w08_turns, "W09_maneuvers": w09_maneuvers, "W10_distances": w10_distances,
}

_KIND = "[" + ", ".join("NULL" if k is None else f"'{k}'" for k in KINDS) + f"][l_linenumber % {len(KINDS)} + 1]"
_OF = {"paved": 40, "gravel": 25, "access": 10, "track": 15, "unknown": 10}
_STAGES = f"""WITH o AS (SELECT *, o_custkey AS trip, o_orderkey AS stage, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderkey % 4 AS sx, CASE WHEN o_orderkey % 23 <> 0 THEN o_orderkey % 3 END AS ex,
  o_orderstatus IN ('F', 'P') AND o_orderkey % 23 <> 0 AS complete, (200 + CAST(floor(o_totalprice) AS BIGINT) % 2000)::DOUBLE AS distance FROM orders),
g AS (SELECT l_orderkey, """ + ", ".join(f"coalesce(sum(l_quantity * 100) FILTER (coalesce({_KIND}, 'unknown') = '{n}'), 0) AS {n}" for n in trips.SURFACES) + """,
  coalesce(sum(l_quantity * 100) FILTER (l_returnflag = 'A'), 0) AS v, coalesce(sum(l_quantity * 100) FILTER (l_returnflag = 'N'), 0) AS p, coalesce(sum(l_quantity * 100) FILTER (l_returnflag NOT IN ('A', 'N')), 0) AS u FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o.*, """ + ", ".join(f"CASE WHEN l_orderkey IS NULL THEN distance * {_OF.get(n, 0) / 100}::DOUBLE ELSE {n} END AS {n}_m" for n in trips.SURFACES) + """,
  CASE WHEN l_orderkey IS NULL THEN distance * 0.2::DOUBLE ELSE v END AS motorized_verified_m, CASE WHEN l_orderkey IS NULL THEN distance * 0.5::DOUBLE ELSE p END AS motorized_permissive_m, CASE WHEN l_orderkey IS NULL THEN distance * 0.3::DOUBLE ELSE u END AS motorized_unknown_m,
  distance * 20 AS moving, CASE WHEN stage % 2 = 0 THEN distance * 25 ELSE distance * 20 * 1.15::DOUBLE END AS elapsed FROM o LEFT JOIN g ON l_orderkey = stage),
d AS (SELECT *, """ + " + ".join(f"{n}_m" for n in trips.ADVENTURE) + """ AS dirt_m FROM b),
n AS (SELECT *, lead(complete) OVER w AS nc, lead(sx) OVER w AS nx, lead(stage) OVER w AS ns FROM o WINDOW w AS (PARTITION BY trip ORDER BY position)),
a AS (SELECT trip, stage AS from_stage, ns AS to_stage, CAST(position AS INT) AS position FROM n WHERE complete AND nc AND ex <> nx)"""
_SHARE = "CAST(CASE WHEN coalesce(distance, 0) > 0 THEN floor({0} / distance * 100 + 0.5) ELSE 0 END AS BIGINT) AS {1}"
_POINTS = "WITH q AS (SELECT s_suppkey AS route, unnest(range(40)) AS i FROM supplier), z AS (SELECT *, 0.0015::DOUBLE * sin(i * (route % 7 + 1) / 6.0::DOUBLE) AS wave FROM q), p AS (SELECT route, i, -66.0::DOUBLE + i * 0.0006::DOUBLE + CASE WHEN route % 2 = 0 THEN wave ELSE 0 END AS lon, 44.0::DOUBLE + i * 0.0004::DOUBLE + CASE WHEN route % 2 = 1 THEN wave ELSE 0 END AS lat FROM z)"


def _hav(x1, y1, x2, y2) -> str:
    h = f"(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


_BEARING = "(degrees(atan2(sin(radians(nx - lon)) * cos(radians(ny)), cos(radians(lat)) * sin(radians(ny)) - sin(radians(lat)) * cos(radians(ny)) * cos(radians(nx - lon)))) + 360) % 360"
ORACLE_SQL = {
    "A13_breakdowns": _STAGES + " SELECT stage, " + ", ".join(f"round({c}, 3) AS {c}" for c in ("elapsed", "dirt_m", *(f"{n}_m" for n in (*trips.SURFACES, *trips.ACCESSES)))) + " FROM d",
    "A14_trips": _STAGES + ", c AS (SELECT trip, count(*) AS stages, count(*) FILTER (complete) AS completed, count(*) FILTER (ex IS NOT NULL) AS required, bool_and(complete) AS all_complete FROM o GROUP BY trip), s AS (SELECT trip, " + ", ".join(f"sum({c}) AS {c}" for c in ("distance", "moving", "elapsed", "dirt_m", *(f"{n}_m" for n in (*trips.SURFACES, *trips.ACCESSES)))) + " FROM d WHERE complete GROUP BY trip), k AS (SELECT trip, count(*) AS gaps FROM a GROUP BY trip) SELECT trip, stages, completed, required, all_complete, coalesce(gaps, 0) AS gaps, "
    + ", ".join(f"CAST(floor(coalesce({c}, 0) + 0.5) AS BIGINT) AS {c}" for c in ("distance", "moving", "elapsed", "dirt_m")) + ", " + ", ".join(_SHARE.format(f"s.{c}", f"{name}_percent").replace("distance", "s.distance") for c, name in (("dirt_m", "dirt"), *((f"{n}_m", name) for n, name in trips.SHARED.items()))) + " FROM c LEFT JOIN s USING (trip) LEFT JOIN k USING (trip)",
    "A15_warnings": _STAGES + ", w AS (SELECT trip, 0 AS late, position, 0 AS i, 'unknown_access_used' AS code, 'in stage ' || stage AS message FROM o WHERE complete AND stage % 5 = 0 UNION ALL SELECT trip, 0, position, 1, 'avoided_edges', 'in stage ' || stage FROM o WHERE complete AND stage % 3 = 0 UNION ALL SELECT trip, 1, position, 0, 'stage_gap', 'Stage ' || position || ' does not end where stage ' || (position + 1) || ' starts.' FROM a) SELECT trip, code, message FROM w QUALIFY row_number() OVER (PARTITION BY trip, code ORDER BY late, position, i) = 1",
    "W11_stage_gaps": _STAGES + " SELECT * FROM a",
    "X05_saved_trips": _STAGES + " SELECT CASE WHEN trip % 5 = 0 THEN 'unsupported_version' WHEN trip % 11 = 0 THEN 'invalid' END AS error, CASE WHEN trip % 5 = 0 OR trip % 11 <> 0 THEN trip END AS trip, CASE WHEN trip % 5 <> 0 AND trip % 11 <> 0 THEN count(*) ELSE 0 END AS stages, CASE WHEN trip % 5 <> 0 AND trip % 11 <> 0 THEN count(*) FILTER (complete) ELSE 0 END AS complete, CASE WHEN trip % 5 <> 0 AND trip % 11 <> 0 THEN round(sum(distance), 3) END AS distance FROM o WHERE trip % 11 <> 0 OR trip % 5 = 0 GROUP BY trip UNION ALL SELECT 'invalid', NULL, 0, 0, NULL FROM (SELECT DISTINCT 1 FROM o WHERE trip % 11 = 0 AND trip % 5 <> 0)",
    "W02_rates": _POINTS + f", l AS (SELECT *, lag(lon) OVER w AS x, lag(lat) OVER w AS y FROM p WINDOW w AS (PARTITION BY route ORDER BY i)), t AS (SELECT *, CASE WHEN x IS NULL THEN 1 ELSE greatest(1, ceil({_hav('x', 'y', 'lon', 'lat')} / 15)) END AS n FROM l), d AS (SELECT route, i AS old, s, CASE WHEN x IS NULL THEN lon ELSE x + (lon - x) * (s / n) END AS lon, CASE WHEN x IS NULL THEN lat ELSE y + (lat - y) * (s / n) END AS lat FROM (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS s FROM t)), "
    f"e AS (SELECT route, row_number() OVER w - 1 AS i, lon, lat, lag(lon) OVER w AS px, lag(lat) OVER w AS py, lead(lon) OVER w AS nx, lead(lat) OVER w AS ny FROM d WINDOW w AS (PARTITION BY route ORDER BY old, s)), b AS (SELECT *, coalesce({_hav('px', 'py', 'lon', 'lat')}, 0) AS leg, {_BEARING} AS o FROM e), r AS (SELECT *, radians(coalesce(o, lag(o) OVER (PARTITION BY route ORDER BY i))) AS raw FROM b), "
    "m AS (SELECT route, i, sum(leg) OVER (PARTITION BY route ORDER BY i) AS along, (degrees(atan2(avg(sin(raw)) OVER w, avg(cos(raw)) OVER w)) + 360) % 360 AS bearing FROM r WINDOW w AS (PARTITION BY route ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), v AS (SELECT *, bearing - lag(bearing) OVER (PARTITION BY route ORDER BY i) AS dd FROM m) SELECT route, CAST(i AS INT) AS i, round(along, 2) AS along, round(bearing, 4) AS bearing, round(coalesce(CASE WHEN dd > 180 THEN dd - 360 WHEN dd < -180 THEN dd + 360 ELSE dd END, 0), 4) AS rate FROM v",
    "W08_turns": _POINTS + f", l AS (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py, lead(lon) OVER w AS nx, lead(lat) OVER w AS ny FROM p WINDOW w AS (PARTITION BY route ORDER BY i)), d AS (SELECT route, i, coalesce({_hav('px', 'py', 'lon', 'lat')}, 0) AS leg, degrees(atan2(nx - lon, ny - lat)) - degrees(atan2(lon - px, lat - py)) AS d FROM l) SELECT route, CAST(i AS INT) AS i, round(sum(leg) OVER (PARTITION BY route ORDER BY i), 2) AS along_m, round(CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END, 4) AS delta FROM d",
    "W10_distances": "SELECT c_custkey, greatest(0, CAST(floor(((c_custkey * 7 % 60) / 8.0::DOUBLE - (c_custkey % 50) / 10.0::DOUBLE) * 1000 + 0.5) AS BIGINT)) AS metres FROM customer",
}
