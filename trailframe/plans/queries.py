"""Queries over the road network, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import classify
from trailframe.functions.geometry import haversine
from trailframe.operators import conflation, graph
from trailframe.operators.components import connected_components
from trailframe.sources.network import EDGES_SQL, NODES_SQL, edges, nodes
from trailframe.streaming import presence

_NET = f"WITH RECURSIVE n AS ({NODES_SQL}), e AS ({EDGES_SQL})"


def a01_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.groupingSets([["s"], ["ac"], ["rt"]], "s", "ac", "rt").agg(F.count("*").alias("edges"), F.sum("m").alias("meters"))


def a05_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topology_metrics(edges(spark, sf_dir))


def rcc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(edges(spark, sf_dir))


def a06_component_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_stats(edges(spark, sf_dir))


def rlcc_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest_component(edges(spark, sf_dir)).select("edge_id", "a", "b", "m")


#: Per cent by code of the surface and by road class.
SURFACE_PERCENT, CLASS_PERCENT = (100, 110, 130, 160, 140), {"arterial": 90, "collector": 100, "local": 110, "resource": 125, "track": 150}


def edge_cost():
    return F.col("m") * F.element_at(F.array(*map(F.lit, SURFACE_PERCENT)), F.col("s") + 1) * F.element_at(F.create_map(*(F.lit(x) for kv in CLASS_PERCENT.items() for x in kv)), F.col("rt"))


_COST_SQL = "m * [100, 110, 130, 160, 140][s + 1] * CASE rt WHEN 'arterial' THEN 90 WHEN 'collector' THEN 100 WHEN 'local' THEN 110 WHEN 'resource' THEN 125 ELSE 150 END"


def rsp1_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest paths of two requests to all nodes, over roads open under the default policy."""
    e = edges(spark, sf_dir)
    allowed = e.where(classify.access_allowed(classify.code_name(F.col("ac"), classify.ACCESSES)))
    starts = spark.createDataFrame([("first", 0), ("second", 75)], "query string, node long")
    return graph.shortest_paths(allowed, starts, edge_cost())


def rcost_edge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("edge_id", edge_cost().cast("long").alias("cost"))


def p21_edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x).cast("string") for x in ("a", "b", "seq")]
    return edges(spark, sf_dir).select("edge_id", classify.edge_id("net-", *c).alias("stable_id"), classify.code_name(F.col("s"), classify.SURFACES).alias("surface"), classify.code_name(F.col("ac"), classify.ACCESSES).alias("access"), classify.access_allowed(classify.code_name(F.col("ac"), classify.ACCESSES)).alias("allowed"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    ends = lambda end, k: n.select(F.col("node_id").alias(end), F.col("lon_e5").alias(f"x{k}"), F.col("lat_e5").alias(f"y{k}"))
    return edges(spark, sf_dir).select(F.col("seq").alias("key"), "a", "b").join(ends("a", 1), "a").join(ends("b", 2), "b")


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every line is of the backbone (even keys) or of the shifted supplement (odd keys)."""
    lines = _lines(spark, sf_dir)
    shift = 15 * (F.col("key") % 4)
    return lines.where("key % 2 = 0"), lines.where("key % 2 <> 0").withColumns({"y1": F.col("y1") + shift, "y2": F.col("y2") + shift})


def j01_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflation.duplicate_pairs(*_sources(spark, sf_dir)).select("base_key", "sup_key", F.round("meters", 3).alias("meters"))


def j02_conflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflation.conflate(*_sources(spark, sf_dir))


_LINES_SQL = _NET + """, l AS (SELECT e.seq AS key, p.lon_e5 AS x1, p.lat_e5 AS y1, q.lon_e5 AS x2, q.lat_e5 AS y2 FROM e JOIN n p ON p.node_id = e.a JOIN n q ON q.node_id = e.b),
base AS (SELECT * FROM l WHERE key % 2 = 0), sup AS (SELECT key, x1, y1 + 15 * (key % 4) AS y1, x2, y2 + 15 * (key % 4) AS y2 FROM l WHERE key % 2 <> 0),
pairs AS (SELECT base_key, sup_key, meters FROM (SELECT b.key AS base_key, s.key AS sup_key,
  2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) AS meters, abs(((degrees(atan2((b.y2 - b.y1) / 1e5, (b.x2 - b.x1) / 1e5)) + 180) % 180) - ((degrees(atan2((s.y2 - s.y1) / 1e5, (s.x2 - s.x1) / 1e5)) + 180) % 180)) AS d
  FROM base b JOIN sup s ON abs(b.x2 - s.x2) <= 400 AND abs(b.y2 - s.y2) <= 400,
  LATERAL (SELECT pow(sin(radians((b.y2 - s.y2) / 1e5) / 2), 2) + cos(radians(s.y2 / 1e5)) * cos(radians(b.y2 / 1e5)) * pow(sin(radians((b.x2 - s.x2) / 1e5) / 2), 2) AS h))
  WHERE meters <= 28 AND least(d, 180 - d) <= 28)"""


def k04_grid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by 0.4-degree chunk of their first vertex, with the chunk's box; most edges first in `place`."""
    lines = _lines(spark, sf_dir).withColumns({"cx": F.floor(F.col("x1") / 40_000), "cy": F.floor(F.col("y1") / 40_000)})
    chunks = lines.groupBy("cx", "cy").agg(F.count("*").alias("edges"), F.min(F.least("x1", "x2")).alias("x_min"), F.max(F.greatest("x1", "x2")).alias("x_max"), F.min(F.least("y1", "y2")).alias("y_min"), F.max(F.greatest("y1", "y2")).alias("y_max"))
    return chunks


def g01_line_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c) / 1e5
    return _lines(spark, sf_dir).select("key", F.round(haversine(d("x1"), d("y1"), d("x2"), d("y2")), 3).alias("meters"))


def a10_route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages are customers' orders, trips are nations: metres by kind, and shares weighted by metres."""
    e = edges(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("trip")), "a")
    dirt = F.sum(F.when(F.col("s").isin(1, 2, 3, 4), F.col("m")).otherwise(0))
    return e.groupBy("trip").agg(F.sum("m").alias("meters"), dirt.alias("dirt_m"), F.count_if(F.col("ac") == 2).alias("unknown_access")).withColumn("dirt_percent", F.floor(100 * F.col("dirt_m") / F.col("meters") + 0.5).cast("long"))


def tpres_last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.last_known(presence.presence_rows(spark.read.parquet(f"{sf_dir}/events.parquet"))).select("user_id", "status", "lng_e5")


def tcad_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.rates(spark.read.parquet(f"{sf_dir}/events.parquet")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def p15_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of interest from `part`: a tag each for fuel, shops and lodging by size, counted by kind."""
    size = F.col("p_size")
    tags = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.when(size % 5 == 0, "fuel").alias("amenity"), F.when(size % 3 == 0, "alcohol").when(size % 3 == 1, "wine").alias("shop"), F.when(size % 7 == 0, "motel").when(size % 7 == 1, "camp_site").alias("tourism"))
    return tags.select(classify.category(F.col("amenity"), F.col("shop"), F.col("tourism")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def w11_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages are a customer's edges by seq; a gap is where one doesn't start where the one before ended."""
    from pyspark.sql import Window

    w = Window.partitionBy("a").orderBy("seq")
    return edges(spark, sf_dir).select("a", "seq", F.lag("b").over(w).alias("before")).where("before IS NOT NULL AND before <> a").groupBy("a").agg(F.count("*").alias("gaps"))


QUERIES = {
    "A01_histograms": a01_histograms, "A05_topology": a05_topology, "A06_component_ranks": a06_component_ranks, "A10_route_stats": a10_route_stats, "G01_line_meters": g01_line_meters,
    "J01_near_duplicates": j01_near_duplicates, "J02_conflate": j02_conflate, "K04_grid_chunks": k04_grid_chunks, "P15_categories": p15_categories, "P21_edge_ids": p21_edge_ids,
    "RCC_components": rcc_components, "RCOST_edge_costs": rcost_edge_costs, "RLCC_largest": rlcc_largest, "RSP1_shortest_paths": rsp1_shortest_paths,
    "TCAD_rates": tcad_rates, "TPRES_last_known": tpres_last_known, "W11_gaps": w11_gaps,
}

_CC = """, x AS (SELECT * FROM e), y AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), cc(node, component) USING KEY (node) AS (SELECT a, a FROM y GROUP BY a UNION (
  SELECT y.b, min(cc.component) FROM cc JOIN y ON y.a = cc.node JOIN recurring.cc AS known ON known.node = y.b WHERE cc.component < known.component GROUP BY y.b))"""
ORACLE_SQL = {
    "A01_histograms": _NET + " SELECT s, ac, rt, count(*) AS edges, CAST(sum(m) AS BIGINT) AS meters FROM e GROUP BY GROUPING SETS ((s), (ac), (rt))",
    "A05_topology": _NET + ", d AS (SELECT v, count(*) AS degree FROM (SELECT a AS v FROM e UNION ALL SELECT b FROM e) GROUP BY v) SELECT count(*) AS nodes, count(*) FILTER (degree >= 3) AS junctions, count(*) FILTER (degree = 2) AS pass_through, count(*) FILTER (degree = 1) AS dead_ends, CAST(sum(degree) AS BIGINT) AS arcs FROM d",
    "A06_component_ranks": _NET + _CC + ", k AS (SELECT component, count(*) AS nodes FROM cc GROUP BY component), l AS (SELECT component, count(*) AS edges, CAST(sum(m) AS BIGINT) AS meters FROM x JOIN cc ON cc.node = x.a GROUP BY component), o AS (SELECT k.component, nodes, edges, meters, row_number() OVER (ORDER BY meters DESC, k.component) AS i FROM k JOIN l USING (component)) SELECT component, nodes, edges, meters, CASE WHEN i <= 15 THEN i END AS by_meters FROM o",
    "A10_route_stats": _NET + ", t AS (SELECT c_nationkey AS trip, CAST(sum(m) AS BIGINT) AS meters, CAST(sum(CASE WHEN s IN (1, 2, 3, 4) THEN m ELSE 0 END) AS BIGINT) AS dirt_m, count(*) FILTER (ac = 2) AS unknown_access FROM e JOIN customer ON c_custkey = a GROUP BY c_nationkey) SELECT *, CAST(floor(100 * dirt_m / meters + 0.5) AS BIGINT) AS dirt_percent FROM t",
    "G01_line_meters": _LINES_SQL + " SELECT key, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 3) AS meters FROM l, LATERAL (SELECT pow(sin(radians((y2 - y1) / 1e5) / 2), 2) + cos(radians(y1 / 1e5)) * cos(radians(y2 / 1e5)) * pow(sin(radians((x2 - x1) / 1e5) / 2), 2) AS h)",
    "J01_near_duplicates": _LINES_SQL + " SELECT base_key, sup_key, round(meters, 3) AS meters FROM pairs",
    "J02_conflate": _LINES_SQL + " SELECT key, 'backbone' AS role FROM base UNION ALL SELECT key, 'supplement' FROM sup WHERE key NOT IN (SELECT sup_key FROM pairs)",
    "K04_grid_chunks": _LINES_SQL + " SELECT CAST(floor(x1 / 40000) AS BIGINT) AS cx, CAST(floor(y1 / 40000) AS BIGINT) AS cy, count(*) AS edges, min(least(x1, x2)) AS x_min, max(greatest(x1, x2)) AS x_max, min(least(y1, y2)) AS y_min, max(greatest(y1, y2)) AS y_max FROM l GROUP BY 1, 2",
    "P15_categories": "SELECT CASE WHEN p_size % 5 = 0 THEN 'fuel' WHEN p_size % 3 = 0 THEN 'liquor' WHEN p_size % 7 = 0 THEN 'lodging' WHEN p_size % 7 = 1 THEN 'campground' END AS kind, count(*) AS n FROM part GROUP BY 1",
    "P21_edge_ids": _NET + " SELECT edge_id, 'net-' || substr(sha1(concat_ws('|', CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(seq AS VARCHAR))), 1, 12) AS stable_id, ['paved', 'gravel', 'access', 'track', 'unknown'][s + 1] AS surface, ['motorized_verified', 'motorized_permissive', 'motorized_unknown', 'motorized_restricted', 'motorized_excluded'][ac + 1] AS access, ac IN (0, 1) AS allowed FROM e",
    "RCC_components": _NET + _CC + " SELECT node, component FROM cc",
    "RCOST_edge_costs": _NET + f" SELECT edge_id, CAST({_COST_SQL} AS BIGINT) AS cost FROM e",
    "RLCC_largest": _NET + _CC + ", g AS (SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT edge_id, a, b, m FROM x WHERE a IN (SELECT node FROM cc WHERE component = (SELECT component FROM g))",
    "TCAD_rates": "SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events GROUP BY 1, 2",
    "TPRES_last_known": "WITH r AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'breakdown' WHEN 'signup' THEN 'stuck' ELSE 'available' END AS status, CASE WHEN event_id % 7 <> 0 THEN -6600000 + CAST(floor(value) AS BIGINT) % 1000 END AS lng_e5 FROM events) SELECT user_id, last(status ORDER BY ts, event_id) AS status, last(lng_e5 ORDER BY ts, event_id) FILTER (lng_e5 IS NOT NULL) AS lng_e5 FROM r GROUP BY user_id",
    "W11_gaps": _NET + ", o AS (SELECT a, lag(b) OVER (PARTITION BY a ORDER BY seq) AS before FROM e) SELECT a, count(*) AS gaps FROM o WHERE before IS NOT NULL AND before <> a GROUP BY a",
}
