"""Queries of way points, chains of places and ends brought together, with the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import network_rules as rules
from trailframe.functions import profiles
from trailframe.operators import routing, waypoints
from trailframe.plans.graph_queries import requests, roads
from trailframe.plans.rule_text_queries import _dealt, _dealt_sql, _hav
from trailframe.plans.rules_queries import _regions_sql

PROFILES = ["balanced", "cleanest", "dirt", "direct"]


def _long_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A way across the country for each customer."""
    k = F.col("c_custkey")
    place = lambda a, b, c, d: F.struct((F.lit(-124.0) + (k * a + b) % 640 / 10).alias("lon"), (F.lit(43.2) + (k * c + d) % 90 / 10).alias("lat"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("query"), _dealt(k, PROFILES).alias("profile"), F.array(place(37, 0, 13, 0), place(91, 55, 29, 17)).alias("places"))


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select("query", F.posexplode("points").alias("place", "p")).select("query", "place", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


def rwpt_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Way points over the seams of provinces, or the highway towns of a clean way."""
    return _listed(waypoints.way_points(_long_ways(spark, sf_dir), "chain"))


def w13_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that a corridor is cut out around: samples of the way and places that keep roads together."""
    return _listed(waypoints.way_points(_long_ways(spark, sf_dir), "clip"))


def chain_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of three or four places for each nation; some lead over a place in the sea."""
    k, at = F.col("query"), lambda lon, lat: F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    middle = F.struct((F.lit(-65.9) + k % 6 * 0.02).alias("lon"), (F.lit(44.012) + k % 4 * 0.005 + F.when(k % 13 == 12, -0.4).otherwise(0.0)).alias("lat"))
    more = F.struct((F.lit(-65.82) - k % 3 * 0.01).alias("lon"), F.lit(44.022).alias("lat"))
    places = F.when(k % 2 == 0, F.array(at("start_lon", "start_lat"), middle, at("end_lon", "end_lat"))).otherwise(F.array(at("start_lon", "start_lat"), middle, more, at("end_lon", "end_lat")))
    return requests(spark, sf_dir).select("query", "profile", "permissive", "unknown", places.alias("places"))


def rchn_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of chains over several places, hop after hop."""
    r, n = roads(spark, sf_dir)
    return routing.chains(chain_requests(spark, sf_dir), r, n).select("query", "hop", "place", "edge_id", F.round("meters", 2).alias("meters"), "surface", "access", "leg", F.round("cost", 6).alias("cost"), "error")


def rchn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains rolled up from their hops' routes (A16)."""
    r, n = roads(spark, sf_dir)
    return routing.chain_stats(routing.chains(chain_requests(spark, sf_dir), r, n)).select("chain", "hops", "status", "failed_hop", F.round("meters", 2).alias("meters"), F.round("moving", 1).alias("moving"), "dirt_percent")


QUERIES = {"RWPT_chain": rwpt_chain, "W13_corridor": w13_corridor, "RCHN_chains": rchn_chains, "RCHN_stats": rchn_stats}


def _points_sql(rows: tuple, *names: str) -> str:
    listed = lambda row: ", ".join(f"'{n}': '{v}'" if isinstance(v, str) else f"'{n}': ({v})::DOUBLE" for n, v in zip(names, row))
    return "[" + ", ".join("{" + listed(row) + "}" for row in rows) + "]"


_TOWNS = _points_sql(profiles.TOWNS, "s", "n", "w", "e", "d")
_NEIGHBOURS = ", ".join(f"('{a}', '{b}', {k})" for a, bs in rules.REGION_NEIGHBOURS.items() for k, b in enumerate(bs))


def _off_towns_sql(lon: str, lat: str) -> str:
    first = f"{{'s': 0::DOUBLE, 'n': 0::DOUBLE, 'w': 0::DOUBLE, 'e': 0::DOUBLE, 'd': {lat}}}"
    moved = f"CASE WHEN acc.d BETWEEN b.s AND b.n AND {lon} BETWEEN b.w AND b.e THEN b.n + b.d ELSE acc.d END"
    return f"(list_reduce(list_prepend({first}, {_TOWNS}), lambda acc, b: {{'s': acc.s, 'n': acc.n, 'w': acc.w, 'e': acc.e, 'd': {moved}}})).d"


_WAYS = f"""WITH RECURSIVE w AS (SELECT c_custkey AS query, {_dealt_sql('c_custkey', PROFILES)} AS profile, -124.0::DOUBLE + (c_custkey * 37 % 640) / 10.0::DOUBLE AS x1, 43.2::DOUBLE + (c_custkey * 13 % 90) / 10.0::DOUBLE AS y1, -124.0::DOUBLE + ((c_custkey * 91 + 55) % 640) / 10.0::DOUBLE AS x2, 43.2::DOUBLE + ((c_custkey * 29 + 17) % 90) / 10.0::DOUBLE AS y2 FROM customer),
g AS ({_regions_sql('SELECT query * 2 AS c_custkey, x1 AS lon, y1 AS lat FROM w UNION ALL SELECT query * 2 + 1, x2, y2 FROM w')}),
nb(a, b, k) AS (VALUES {_NEIGHBOURS}), walk(start, spot, path, ranks) AS (SELECT DISTINCT a, a, [a], []::INT[] FROM nb UNION ALL SELECT start, b, path || [b], ranks || [k] FROM walk JOIN nb ON a = spot WHERE NOT list_contains(path, b)),
paths AS (SELECT start, spot AS goal, arg_min(path, (len(path), ranks)) AS path FROM walk GROUP BY 1, 2),
q AS (SELECT w.*, f.region AS r1, t.region AS r2, {{'lon': x1, 'lat': y1}} AS s, {{'lon': x2, 'lat': y2}} AS e, CASE WHEN x1 < x2 THEN 1 ELSE -1 END AS sign, {_hav('x1', 'y1', 'x2', 'y2')} / 1000 AS km FROM w JOIN g f ON f.c_custkey = query * 2 JOIN g t ON t.c_custkey = query * 2 + 1),
k AS (SELECT q.*, path, coalesce(r1, r2) = 'qc' AND coalesce(r2, r1) = 'qc' OR abs(x1 - x2) < 3 AND km < 200 AS given FROM q LEFT JOIN paths ON start = r1 AND goal = r2 AND r1 <> r2),
"""
_APART = "(abs(p.lon - x1) >= 0.08 OR abs(p.lat - y1) >= 0.08) AND (abs(p.lon - x2) >= 0.08 OR abs(p.lat - y2) >= 0.08)"


def _in_order(points: str) -> str:
    """Points by longitude in the way's direction, in their own order where it is equal."""
    return f"list_transform(list_sort(list_transform({points}, lambda p, i: {{'key': p.lon * sign, 'i': i, 'lon': p.lon, 'lat': p.lat}})), lambda p: {{'lon': p.lon, 'lat': p.lat}})"


def _way_sql(given: str, led: str) -> str:
    """Rows of the points of each way: given ways, clean ones, and others in order with a running removal of near neighbours."""
    towns = _in_order(f"list_filter({_points_sql(waypoints.ANCHORS, 'lon', 'lat')}, lambda p: {_APART} AND p.lon > least(x1, x2) AND p.lon < greatest(x1, x2))")
    near = lambda a, b, d: f"abs({a}.lon - {b}.lon) < {d} AND abs({a}.lat - {b}.lat) < {d}"
    return f"""l AS (SELECT *, {led} AS pts FROM k), o AS (SELECT *, list_reduce(list_transform({_in_order('pts')}, lambda p: [p]), lambda acc, p: CASE WHEN {near('acc[-1]', 'p[1]', 0.15)} THEN acc ELSE acc || p END) AS kept FROM l),
u AS (SELECT query, CASE WHEN given THEN [s, e] WHEN profile = 'cleanest' THEN [s] || {towns} || [e] WHEN {given} THEN [s, e]
  ELSE CASE WHEN {near('kept[1]', 's', 0.02)} THEN [] ELSE [s] END || kept || CASE WHEN {near('kept[-1]', 'e', 0.02)} THEN [] ELSE [e] END END AS points FROM o)
SELECT query, CAST(unnest(range(len(points))) AS INT) AS place, round(unnest(points).lon, 6) AS lon, round(unnest(points).lat, 6) AS lat FROM u"""


_SEAMS = f"list_transform(list_filter({_points_sql(waypoints.SEAMS, 'lon', 'lat', 'a', 'b')}, lambda p: list_contains(path, p.a) AND list_contains(path, p.b) AND p.lon BETWEEN least(x1, x2) - 0.35 AND greatest(x1, x2) + 0.35 AND {_APART}), lambda p: {{'lon': p.lon, 'lat': p.lat}})"
_KEPT = f"list_transform(list_filter({_points_sql(waypoints.KEEPERS, 'lon', 'lat')}, lambda p: p.lon BETWEEN least(x1, x2) - 0.4 AND greatest(x1, x2) + 0.4), lambda p: {{'lon': p.lon, 'lat': {_off_towns_sql('p.lon', 'p.lat')}}})"
_HOPS = "greatest(1, floor(km / 320 + 0.5))::BIGINT"
_SAMPLES = f"CASE WHEN km >= 368 THEN list_transform(range(1, {_HOPS}), lambda i: {{'lon': x1 + (x2 - x1) * (i / ({_HOPS})::DOUBLE), 'lat': {_off_towns_sql(f'(x1 + (x2 - x1) * (i / ({_HOPS})::DOUBLE))', f'(y1 + (y2 - y1) * (i / ({_HOPS})::DOUBLE))')}}}) ELSE [] END"
ORACLE_SQL = {
    "RWPT_chain": _WAYS + _way_sql("path IS NULL", f"[s, e] || coalesce({_SEAMS}, [])"),
    "W13_corridor": _WAYS + _way_sql("false", f"[s, e] || {_SAMPLES} || {_KEPT}"),
}
