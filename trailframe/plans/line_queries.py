"""Queries of lines, chains and requests, with the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.functions import classify, labels
from trailframe.functions import network_rules as rules
from trailframe.functions.geometry import haversine
from trailframe.operators import lines, requests
from trailframe.plans.queries import _lines
from trailframe.plans.rule_text_queries import _dealt, _dealt_sql, _hav
from trailframe.plans.trip_queries import _POINTS, route_points
from trailframe.sources.network import EDGES_SQL, NODES_SQL, edges

_NET = f"WITH n AS ({NODES_SQL}), e AS ({EDGES_SQL})"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _small(k, i):
    return F.struct((k * 7 % 5 + F.floor(i / 2)).cast("long").alias("lon"), (k + F.floor(i / 2)).cast("long").alias("lat"))


def w12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of nine points, each there twice, without what repeats."""
    k = F.col("p_partkey")
    line = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: _small(k, i))
    kept = lines.without_repeats(line)
    return _table(spark, sf_dir, "part").select(k, F.size(kept).alias("points"), F.array_join(F.transform(kept, lambda p: F.concat_ws(":", p["lon"].cast("string"), p["lat"].cast("string"))), ",").alias("line"))


def u04_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops of k % 4 + 1 points, joined."""
    k = F.col("p_partkey")
    hop = lambda n: F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: (k + n * 10 + i).cast("string"))
    return _table(spark, sf_dir, "part").select(k, F.array_join(lines.joined(F.array(hop(0), hop(1), hop(2))), ",").alias("line"))


def g21_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a line of six points before and behind a point on it, and between two."""
    k = F.col("p_partkey")
    at = lambda x: F.struct(x.cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    line = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: at(i * 10))
    s1, s2 = (k % 5).cast("int"), (k * 3 % 5).cast("int")
    x1, x2 = s1 * 10 + (k % 3) * 5, s2 * 10 + (k % 2) * 5
    text = lambda c: F.array_join(F.transform(c, lambda p: p["lon"].cast("int").cast("string")), ",")
    return _table(spark, sf_dir, "part").select(k, text(lines.up_to(line, s1, at(x1))).alias("before"), text(lines.from_on(line, s1, at(x1))).alias("behind"), text(lines.between(line, s1, at(x1), x1, s2, at(x2), x2)).alias("between"))


def _to_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes whose goals are at one of their own points, so that some go on behind them."""
    k = F.col("route")
    goal = F.col("i") == k % 5 * 8 + 7
    points = route_points(spark, sf_dir)
    goals = points.where(goal).select("route", (F.col("lon") + 0.0001).alias("goal_lon"), F.col("lat").alias("goal_lat"))
    return points.join(goals, "route")


def g20_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.trimmed(_to_goals(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("points"), F.max("i").alias("last"), F.round(F.max_by("lon", "i"), 6).alias("lon"), F.round(F.max_by("lat", "i"), 6).alias("lat"))


def w17_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.metrics(_to_goals(spark, sf_dir)).select("route", *(F.round(c, n).alias(c) for c, n in (("meters", 2), ("nearest", 2), ("behind", 2), ("north", 6))))


def g18_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points kept of routes cut into two segments, at most thirty of each route."""
    points = route_points(spark, sf_dir).select("route", F.floor(F.col("i") / 20).alias("segment"), F.col("i").cast("long").alias("i"), "lon", "lat")
    return lines.simplified(points, 30).select("route", "segment", "i")


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("s_suppkey"), F.col("i")
    return _table(spark, sf_dir, "supplier").select(k.alias("route"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("route", F.when(F.col("route") % 2 == 0, 0).otherwise(F.floor(i / 3)).alias("segment"), "i", (F.col("route") + i / 4).alias("lon"), (i / 2).alias("lat"))


def k10_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.as_geojson(_short(spark, sf_dir))


def k10_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.as_gpx(_short(spark, sf_dir), F.concat(F.lit("A & <"), F.col("route").cast("string"), F.lit(">")))


def j21_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines over the lattice of three customers each, cut where others use a vertex too (W16)."""
    k = F.col("p_partkey")
    walk = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")
    points = _table(spark, sf_dir, "part").select(k.alias("line"), walk).select("line", "i", ((F.col("line") * 7 + F.col("i") * (F.col("line") % 3 + 1)) % 97).alias("x"), ((F.col("line") * 5 + F.col("i")) % 89).alias("y"))
    return lines.split_at_shared(points).select("line", F.col("part").cast("long").alias("part"), F.col("i").cast("long").alias("i"))


def j20_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detours of each supplier that come back to the original's edges."""
    k, i = F.col("s_suppkey"), F.col("seq")
    walk = lambda n: _table(spark, sf_dir, "supplier").select(k.alias("report"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("seq"))
    original = walk(19).select("report", (F.col("report") * 100 + i).alias("edge_id"), "seq", (F.col("report") % 12).alias("report_seq"))
    detour = walk(9).select("report", F.when(i % 3 == 2, F.col("report") * 100 + (i * 5 + F.col("report")) % 25).otherwise(-i - 1).alias("edge_id"), "seq")
    return lines.rejoined(detour, original)


def a16_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as hops of their orders' chains; few of them fail."""
    hop = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chain"), hop.alias("hop"), (F.col("l_partkey") % 19 > 0).alias("ok"), (F.col("l_quantity") * 100).alias("meters"), (F.col("l_quantity") * 9).alias("moving"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity") * 100).otherwise(0.0).alias("dirt_m"), F.col("l_partkey").alias("from"), F.col("l_suppkey").alias("to"))
    return lines.chained(rows)


PLACES = ["n", "x", "on", None]


def x08_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the first thing that is wrong, the policy in effect and the answer's status (X7 to X9)."""
    k = F.col("p_partkey")
    place = lambda n: F.struct(F.when((k + n) % 7 > 0, (k % 90).cast("double")).alias("lon"), F.lit(44.0).alias("lat"))
    rows = _table(spark, sf_dir, "part").select(k, _dealt(k, ["balanced", "dirt", "scenic", "cleanest", None, "direct"]).alias("profile"), F.slice(F.array(place(0), place(1), place(2)), F.lit(1), (k % 4).cast("int")).alias("locations"), F.when(k % 3 > 0, (k % 900).cast("double")).alias("match_m"), F.when(k % 5 == 0, False).alias("permissive"), (k % 2 == 0).alias("unknown"))
    out = requests.checked(rows)
    return out.select(k, "error", "match_m", "policy.permissive", "policy.unknown", requests.http_status(F.col("error")).alias("status"), requests.http_status(F.when(k % 2 == 0, "no_route").otherwise("odd")).alias("other"))


def x10_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    codes = requests.route_warnings(k % 2 == 0, _dealt(k, ["dirt", "direct"]), (k % 3).cast("double"), F.when(k % 7 > 0, k % 4), k % 5 - 2, F.lit(0))
    return _table(spark, sf_dir, "part").select(k, F.array_join(codes, ",").alias("codes"))


def rcor_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions between those of each nation's first customers."""
    k = F.col("n_nationkey")
    names = list(rules.REGION_BOXES)
    asked = _table(spark, sf_dir, "nation").select(k.cast("long").alias("query"), F.explode(F.array(_dealt(k, names), _dealt(k * 5 + 2, names), _dealt(k * 11 + 7, names))).alias("region"))
    return requests.corridor(asked).select("query", F.array_join("regions", ",").alias("regions"))


def rcor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(rules.REGION_BOXES)
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "start string, goal string")
    return requests.region_paths(pairs).select("start", "goal", F.size("path").alias("regions"))


def g02_track_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of edges with the radius of tracks, the haversine clamped to 1."""
    d = lambda c: F.col(c) / 1e5
    return _lines(spark, sf_dir).select("key", F.round(haversine(d("x1"), d("y1"), d("x2"), d("y2"), 6_371_008.8), 3).alias("meters"), F.round(haversine(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0), 1.0), 6).alias("half"))


def p17_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(k, classify.first_known(_dealt(k, ["", "None", " Route 7 ", None]), _dealt(k, ["unknown", "Main", "  "])).alias("name"))


def x06_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a marker on the map leads: its own place, or that it names; points only."""
    k = F.col("p_partkey")
    lng = F.coalesce(labels.number_or_null(_dealt(k, ["-63.5", "", "x", None])), (k % 90).cast("double"))
    name, status = F.coalesce(F.nullif(_dealt(k, ["Ann", None, ""]), F.lit("")), F.lit("Rider")), _dealt(k, ["stuck", None])
    rows = _table(spark, sf_dir, "part").where(k % 5 != 3)  # other geometries lead nowhere
    return rows.select(k, lng.alias("lng"), name.alias("name"), F.coalesce(status, F.lit("available")).alias("status"), labels.status_label(status).alias("text"))


def p11_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest roads of a source without attributes, all classified alike."""
    return edges(spark, sf_dir).where("rt = 'resource'").select("edge_id", F.lit("resource").alias("surface"), F.lit("motorized_unknown").alias("access"), F.lit("medium").alias("confidence"))


QUERIES = {
    "W12_repeats": w12_repeats, "U04_joined": u04_joined, "G21_partial": g21_partial, "G20_trimmed": g20_trimmed, "W17_metrics": w17_metrics, "G18_simplified": g18_simplified, "K10_geojson": k10_geojson, "K10_gpx": k10_gpx, "J21_splits": j21_splits,
    "J20_rejoined": j20_rejoined, "A16_chains": a16_chains, "X08_requests": x08_requests, "X10_warnings": x10_warnings, "RCOR_corridors": rcor_corridors, "RCOR_paths": rcor_paths, "G02_track_metres": g02_track_metres, "P17_known": p17_known,
    "X06_targets": x06_targets, "P11_constant": p11_constant,
}

_GOALS = _POINTS + f", t AS (SELECT p.*, g.lon + 0.0001::DOUBLE AS gx, g.lat AS gy FROM p JOIN p g ON g.route = p.route AND g.i = p.route % 5 * 8 + 7), l AS (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py FROM t WINDOW w AS (PARTITION BY route ORDER BY i)), m AS (SELECT *, coalesce({_hav('px', 'py', 'lon', 'lat')}, 0) AS leg, {_hav('lon', 'lat', 'gx', 'gy')} AS d FROM l), a AS (SELECT *, sum(leg) OVER (PARTITION BY route ORDER BY i) AS along, sum(leg) OVER (PARTITION BY route) AS total FROM m), b AS (SELECT route, min((d, i)) AS near, max(total) AS total FROM a GROUP BY route), c AS (SELECT a.route, a.i AS spot, a.total - a.along AS behind, a.d, a.gx, a.gy, a.total FROM a JOIN b ON a.route = b.route AND a.i = near[2])"
_HOP = lambda n: f"list_transform(range(p_partkey % 4 + 1), lambda i: CAST(p_partkey + {n * 10} + i AS VARCHAR))"
_NEIGHBOURS = ", ".join(f"('{a}', '{b}')" for a, bs in rules.REGION_NEIGHBOURS.items() for b in bs)
_X = "lambda x: CAST(x AS VARCHAR)"
ORACLE_SQL = {
    "W12_repeats": "SELECT p_partkey, CAST(5 AS INT) AS points, array_to_string(list_transform(range(5), lambda j: CAST(p_partkey * 7 % 5 + j AS VARCHAR) || ':' || CAST(p_partkey + j AS VARCHAR)), ',') AS line FROM part",
    "U04_joined": f"SELECT p_partkey, array_to_string({_HOP(0)} || ({_HOP(1)})[2:] || ({_HOP(2)})[2:], ',') AS line FROM part",
    "G21_partial": f"WITH p AS (SELECT p_partkey, p_partkey % 5 AS s, p_partkey * 3 % 5 AS t, p_partkey % 5 * 10 + p_partkey % 3 * 5 AS x, p_partkey * 3 % 5 * 10 + p_partkey % 2 * 5 AS y FROM part), q AS (SELECT *, list_filter([0, 10, 20, 30, 40, 50], lambda v: v <= s * 10) AS a, list_filter([0, 10, 20, 30, 40, 50], lambda v: v > s * 10) AS b, list_filter([0, 10, 20, 30, 40, 50], lambda v: CASE WHEN x <= y THEN v > s * 10 AND v <= t * 10 ELSE v > t * 10 AND v <= s * 10 END) AS c, least(x, y) AS lo, greatest(x, y) AS hi FROM p), r AS (SELECT *, CASE WHEN len(c) > 0 AND c[1] = lo THEN c ELSE [lo] || c END AS f FROM q), u AS (SELECT *, CASE WHEN f[-1] = hi THEN f ELSE f || [hi] END AS w FROM r) "
    f"SELECT p_partkey, array_to_string(list_transform(CASE WHEN a[-1] = x THEN a ELSE a || [x] END, {_X}), ',') AS before, array_to_string(list_transform(CASE WHEN b[1] = x THEN b ELSE [x] || b END, {_X}), ',') AS behind, array_to_string(list_transform(CASE WHEN x <= y THEN w ELSE list_reverse(w) END, {_X}), ',') AS between FROM u",
    "G20_trimmed": _GOALS + " SELECT c.route, CASE WHEN behind >= 160 AND c.d <= 100 THEN spot + 2 ELSE 40 END AS points, CAST(CASE WHEN behind >= 160 AND c.d <= 100 THEN spot + 1 ELSE 39 END AS INT) AS last, round(CASE WHEN behind >= 160 AND c.d <= 100 THEN gx ELSE lon END, 6) AS lon, round(CASE WHEN behind >= 160 AND c.d <= 100 THEN gy ELSE lat END, 6) AS lat FROM c JOIN p ON p.route = c.route AND p.i = 39",
    "W17_metrics": _GOALS + " SELECT c.route, round(c.total, 2) AS meters, round(c.d, 2) AS nearest, round(behind, 2) AS behind, round(max(lat - c.gy), 6) AS north FROM c JOIN t ON t.route = c.route GROUP BY ALL",
    "K10_geojson": "WITH p AS (SELECT s_suppkey AS route, i, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE i // 3 END AS segment, '[' || CAST((s_suppkey + i / 4.0)::DOUBLE AS VARCHAR) || ',' || CAST((i / 2.0)::DOUBLE AS VARCHAR) || ']' AS c FROM supplier, range(6) r(i)), s AS (SELECT route, segment, '[' || string_agg(c, ',' ORDER BY i) || ']' AS l FROM p GROUP BY 1, 2), g AS (SELECT route, count(*) AS n, string_agg(l, ',' ORDER BY segment) AS c FROM s GROUP BY 1) SELECT route, '{\"type\":\"Feature\",\"properties\":{\"route\":' || route || '},\"geometry\":{\"type\":\"' || CASE n WHEN 1 THEN 'LineString' ELSE 'MultiLineString' END || '\",\"coordinates\":' || CASE n WHEN 1 THEN c ELSE '[' || c || ']' END || '}}' AS feature FROM g",
    "K10_gpx": "WITH p AS (SELECT s_suppkey AS route, i, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE i // 3 END AS segment, '<trkpt lat=\"' || CAST((i / 2.0)::DOUBLE AS VARCHAR) || '\" lon=\"' || CAST((s_suppkey + i / 4.0)::DOUBLE AS VARCHAR) || '\"></trkpt>' AS c FROM supplier, range(6) r(i)), s AS (SELECT route, segment, '<trkseg>' || string_agg(c, '' ORDER BY i) || '</trkseg>' AS l FROM p GROUP BY 1, 2) SELECT route, '<gpx version=\"1.1\" xmlns=\"http://www.topografix.com/GPX/1/1\"><trk><name>A &amp; &lt;' || route || '&gt;</name>' || string_agg(l, '' ORDER BY segment) || '</trk></gpx>' AS gpx FROM s GROUP BY route",
    "J21_splits": "WITH p AS (SELECT p_partkey AS line, i, (p_partkey * 7 + i * (p_partkey % 3 + 1)) % 97 AS x, (p_partkey * 5 + i) % 89 AS y FROM part, range(5) r(i)), u AS (SELECT *, count(*) OVER (PARTITION BY x, y) > 1 AND i BETWEEN 1 AND 3 AS cut FROM p), c AS (SELECT *, CAST(coalesce(sum(cut::INT) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS part FROM u) SELECT line, part, i FROM c UNION ALL SELECT line, part + 1, i FROM c WHERE cut",
    "J20_rejoined": "WITH o AS (SELECT s_suppkey AS report, s_suppkey * 100 + i AS edge_id, i AS seq FROM supplier, range(20) r(i) WHERE i > s_suppkey % 12), d AS (SELECT s_suppkey AS report, CASE WHEN i % 3 = 2 THEN s_suppkey * 100 + (i * 5 + s_suppkey) % 25 ELSE -i - 1 END AS edge_id, i AS seq FROM supplier, range(10) r(i)) SELECT report, edge_id, CAST(d.seq AS INT) AS detour_seq, CAST(o.seq AS INT) AS original_seq FROM d JOIN o USING (report, edge_id) QUALIFY row_number() OVER (PARTITION BY report ORDER BY d.seq, o.seq, edge_id) = 1",
    "A16_chains": "WITH h AS (SELECT l_orderkey AS chain, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS hop, l_partkey % 19 > 0 AS ok, l_quantity AS q, l_linenumber % 3 > 0 AS dirt FROM lineitem), c AS (SELECT chain, count(*) AS hops, CAST(min(hop) FILTER (NOT ok) AS INT) AS failed_hop, sum(q) AS q, coalesce(sum(q) FILTER (dirt), 0) AS d FROM h GROUP BY 1) SELECT chain, hops, CASE WHEN failed_hop IS NULL THEN 'ok' ELSE 'chain_hop_failed' END AS status, failed_hop, CASE WHEN failed_hop IS NULL THEN q * 100 END AS meters, CASE WHEN failed_hop IS NULL THEN q * 9 END AS moving, CASE WHEN failed_hop IS NULL THEN CAST(floor(d / q * 100 + 0.5) AS BIGINT) END AS dirt_percent FROM c",
    "X08_requests": f"WITH p AS (SELECT *, p_partkey AS k, {_dealt_sql('p_partkey', ['balanced', 'dirt', 'scenic', 'cleanest', None, 'direct'])} AS profile, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 900 END AS m FROM part), e AS (SELECT *, CASE WHEN profile IS NULL OR profile = 'scenic' THEN 'invalid_profile' WHEN k % 4 < 2 OR k % 7 = 0 OR (k + 1) % 7 = 0 OR k % 4 = 3 AND (k + 2) % 7 = 0 THEN 'invalid_locations' WHEN m > 750 THEN 'match_limit_too_large' END AS error FROM p) SELECT p_partkey, error, coalesce(m, 250)::DOUBLE AS match_m, k % 5 <> 0 AS permissive, k % 2 = 0 AND coalesce(profile, '') <> 'cleanest' AS unknown, CAST(CASE WHEN error IS NULL THEN 200 ELSE 400 END AS INT) AS status, CAST(CASE WHEN k % 2 = 0 THEN 422 ELSE 500 END AS INT) AS other FROM e",
    "X10_warnings": "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'unknown_access_enabled' END, CASE WHEN p_partkey % 3 > 0 THEN 'unknown_access_used' END, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 7 > 0 AND p_partkey % 4 > 0 THEN 'unavoidable_pavement' END, CASE WHEN p_partkey % 5 > 2 THEN 'access_legs' END) AS codes FROM part",
    "RCOR_paths": f"WITH RECURSIVE n(a, b) AS (VALUES {_NEIGHBOURS}), r(start, spot, hops) AS (SELECT DISTINCT a, a, 1 FROM n UNION SELECT start, b, hops + 1 FROM r JOIN n ON a = spot WHERE hops < 13), b AS (SELECT start, spot AS goal, min(hops) AS regions FROM r GROUP BY 1, 2) SELECT x.a AS start, y.a AS goal, CAST(coalesce(regions, -1) AS INT) AS regions FROM (SELECT DISTINCT a FROM n) x, (SELECT DISTINCT a FROM n) y LEFT JOIN b ON start = x.a AND goal = y.a",
    "G02_track_metres": _NET + f" SELECT seq AS key, round({_hav('(p.lon_e5 / 1e5)', '(p.lat_e5 / 1e5)', '(q.lon_e5 / 1e5)', '(q.lat_e5 / 1e5)')} / 6371000.0 * 6371008.8, 3) AS meters, round(pi(), 6) AS half FROM e JOIN n p ON p.node_id = a JOIN n q ON q.node_id = b",
    "P17_known": f"WITH p AS (SELECT p_partkey, trim({_dealt_sql('p_partkey', ['', 'None', ' Route 7 ', None])}) AS a, trim({_dealt_sql('p_partkey', ['unknown', 'Main', '  '])}) AS b FROM part) SELECT p_partkey, CASE WHEN a = 'Route 7' THEN a WHEN b = 'Main' THEN b ELSE '' END AS name FROM p",
    "X06_targets": "WITH p AS (SELECT *, p_partkey AS k FROM part WHERE p_partkey % 5 <> 3) SELECT p_partkey, CASE WHEN k % 4 = 0 THEN -63.5 ELSE k % 90 END::DOUBLE AS lng, CASE WHEN k % 3 = 0 THEN 'Ann' ELSE 'Rider' END AS name, CASE WHEN k % 2 = 0 THEN 'stuck' ELSE 'available' END AS status, CASE WHEN k % 2 = 0 THEN 'Stuck' ELSE 'Available' END AS text FROM p",
    "P11_constant": _NET + " SELECT edge_id, 'resource' AS surface, 'motorized_unknown' AS access, 'medium' AS confidence FROM e WHERE rt = 'resource'",
}
