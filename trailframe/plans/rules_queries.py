"""Queries of rules, spatial selections, ordered operators, presence and groups, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.functions import classify
from trailframe.functions import network_rules as rules
from trailframe.operators import graph, spatial
from trailframe.sources.network import EDGES_SQL, NODES_SQL, edges, nodes
from trailframe.streaming.presence import presence_rows

_NET = f"WITH RECURSIVE n AS ({NODES_SQL}), e AS ({EDGES_SQL})"
_BUCKET = "['motorized_permissive', 'motorized_permissive', 'motorized_unknown', 'motorized_restricted', 'motorized_excluded'][ac + 1]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p19_access_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).select(rules.access_for_policy(classify.code_name(F.col("ac"), classify.ACCESSES)).alias("bucket"), classify.surface_for_costing(F.when(F.col("rt") == "resource", "resource").otherwise(classify.code_name(F.col("s"), classify.SURFACES))).alias("surface"), "m")
    return e.groupBy("bucket", "surface").agg(F.count("*").alias("edges"), F.sum("m").alias("meters"))


def p22_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges open under each of the four policies, in one pass; every seventh is of the open street map."""
    access, source = classify.code_name(F.col("ac"), classify.ACCESSES), F.when(F.col("seq") % 7 == 0, "OpenStreetMap roads").otherwise("Topographic")
    return edges(spark, sf_dir).agg(*(F.count_if(classify.access_allowed(access, p, u, source)).alias(f"permissive_{int(p)}_unknown_{int(u)}") for p in (False, True) for u in (False, True)))


def p23_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    asked = lambda k: F.when(k % 3 == 1, True).when(k % 3 == 2, False)
    policy = rules.normalized_policy(asked(key), asked(key + 1), F.when(key % 4 == 0, "cleanest").otherwise("balanced"))
    return _table(spark, sf_dir, "customer").select(key, policy.alias("p")).select("c_custkey", "p.permissive", "p.unknown")


def p25_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where(rules.is_spine(F.col("rt"), F.col("s"), F.col("m"), F.col("a") % 30 == 0)).select("edge_id", "m")


def p29_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = edges(spark, sf_dir).select("edge_id", rules.packed(F.col("s"), F.col("ac"), F.col("seq") % 2 == 0).alias("bits"))
    return bits.withColumn("u", rules.unpacked(F.col("bits"))).select("edge_id", "bits", "u.surface", "u.access", "u.seasonal")


def p31_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    lon, lat = F.lit(-141.0) + (key * 37 % 900) / 10.0, F.lit(41.0) + (key * 53 % 420) / 10.0
    return _table(spark, sf_dir, "customer").select(key, rules.smallest_region(lon, lat).alias("smallest"), rules.primary_region(lon, lat).alias("region"))


def p33_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.floor(rules.heading(F.floor("value") * 7 - 900)).alias("heading"))


def p40_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<name a=\"1\">"), "p_name", F.lit(" & 'co'</name>"))
    return _table(spark, sf_dir, "part").select("p_partkey", rules.escaped_xml(text).alias("escaped"))


def a04_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir))


def a08_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead ends within 2 per cent of the box's sides, of each nation's roads between its own nodes."""
    n = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("region"))
    end = lambda c: n.select(F.col("node_id").alias(c), F.col("region").alias(f"_{c}"))
    own = edges(spark, sf_dir).join(end("a"), "a").join(end("b"), "b").where("_a = _b").select("a", "b", F.col("_a").alias("region"))
    return boundary(own, nodes(spark, sf_dir))


def boundary(e: DataFrame, n: DataFrame) -> DataFrame:
    """(region, node_id) of the dead ends of each region's edges (a, b, region) that lie near the sides of the box of its nodes."""
    at = graph.arcs(e, "region").groupBy("region", F.col("src").alias("node_id")).agg(F.count("*").alias("degree")).join(n, "node_id")
    box = at.groupBy("region").agg(*(f(c).alias(f"{name}_{c}") for c in ("lon_e5", "lat_e5") for name, f in (("lo", F.min), ("hi", F.max))))
    near = lambda c: (F.col(c) - F.col(f"lo_{c}")) * 50 <= F.col(f"hi_{c}") - F.col(f"lo_{c}")
    far = lambda c: (F.col(f"hi_{c}") - F.col(c)) * 50 <= F.col(f"hi_{c}") - F.col(f"lo_{c}")
    return at.where("degree = 1").join(box, "region").where(near("lon_e5") | far("lon_e5") | near("lat_e5") | far("lat_e5")).select("region", "node_id")


def a12_moving_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds by road class, exact up to the last rounding: integer weights of the speeds' common multiple 3150."""
    weight = F.get(F.array(*(F.lit(3150 // v) for v in rules.SPEEDS_KMH)), F.col("s"))
    total = F.sum(F.col("m") * weight)
    return edges(spark, sf_dir).groupBy("rt").agg(F.floor((total * 36 * 2 + 31_500) / 63_000).alias("seconds"))


#: A corridor as a request gives it (lon, lat), with its buffer in metres.
CORRIDOR, BUFFER_M = [(-66.0, 44.0), (-65.9, 44.02), (-65.75, 44.01)], 1500.0


def j10_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.touching(edges(spark, sf_dir), spatial.in_corridor(nodes(spark, sf_dir), CORRIDOR, BUFFER_M)).select("edge_id", "m")


def j12_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = nodes(spark, sf_dir).where("lon_e5 BETWEEN -6595000 AND -6580000 AND lat_e5 BETWEEN 4400000 AND 4403000")
    return spatial.touching(edges(spark, sf_dir), inside).select("edge_id", "m")


def j16_avoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges less those that a report names (orders of lineitems that were returned)."""
    named = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("seq")).distinct()
    return edges(spark, sf_dir).join(named, "seq", "left_anti").select("edge_id", "m")


def j07_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    points = _table(spark, sf_dir, "supplier").select(key.alias("point_id"), (F.lit(-6_600_000) + key * 137 % 30_000).alias("x"), (F.lit(4_400_000) + key * 211 % 50_000).alias("y"))
    return spatial.nearest(points, nodes(spark, sf_dir), 900)


def rell_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_ellipse(nodes(spark, sf_dir), (-66.0, 44.0), (-65.8, 44.03), 17_000.0, 1.28).select("node_id")


def rbfs_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops between all regions: all searches run in the same rounds."""
    pairs = spark.createDataFrame([(a, b) for a, bs in rules.REGION_NEIGHBOURS.items() for b in bs], "a string, b string")
    starts = pairs.select(F.col("a").alias("query"), F.col("a").alias("node")).distinct()
    return graph.shortest_paths(pairs, starts, F.lit(1)).select("query", "node", F.col("cost").alias("hops"))


def w01_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("a").orderBy("seq")
    return edges(spark, sf_dir).select("a", "seq", F.sum("m").over(w).alias("along"), F.lead("m").over(w).alias("next_m"))


def w16_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running number of the part that an edge belongs to: a new one after each junction (an end of degree 8 or more)."""
    e = edges(spark, sf_dir)
    junction = graph.degrees(e).where("degree >= 8").select(F.col("node_id").alias("b"), F.lit(1).alias("j"))
    w = Window.partitionBy("a").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return e.join(junction, "b", "left").select("edge_id", F.coalesce(F.sum(F.coalesce("j", F.lit(0))).over(w), F.lit(0)).alias("part"))


def talrt_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest distress alert of each user and status that has a position."""
    rows = presence_rows(_table(spark, sf_dir, "events")).where("status IN ('breakdown', 'stuck') AND lng_e5 IS NOT NULL")
    return rows.groupBy("user_id", "status").agg(F.max("event_id").alias("alert_id"), F.max_by("lng_e5", "event_id").alias("lng_e5"))


def texp_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports (error events) still open and those over 72 hours older than the newest event."""
    e = _table(spark, sf_dir, "events")
    rows = e.where("event_type = 'error'").select("ts", e.agg(F.max("ts")).scalar().alias("now"))
    return rows.groupBy((F.col("ts") + F.expr("INTERVAL 72 HOURS") < F.col("now")).alias("expired")).agg(F.count("*").alias("n"))


def j17_live_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by group, and those seen in the two hours before the newest event."""
    e = _table(spark, sf_dir, "events")
    seen = e.groupBy("user_id").agg(F.max("ts").alias("last_seen")).select("user_id", "last_seen", e.agg(F.max("ts")).scalar().alias("now"))
    live = F.col("last_seen") > F.col("now") - F.expr("INTERVAL 2 HOURS")
    return seen.groupBy((F.col("user_id") % 10).alias("group_id")).agg(F.count("*").alias("members"), F.count_if(live).alias("live"))


def j19_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users each user may see: itself and those of its groups (by 10 and by 7 of the key)."""
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    groups = users.select("user_id", F.explode(F.array(F.concat(F.lit("t"), F.col("user_id") % 10), F.concat(F.lit("s"), F.col("user_id") % 7))).alias("g"))
    sizes = groups.groupBy("g").agg(F.count("*").alias("n"))
    # |A or B| = |A| + |B| - |A and B|, counted by pairs of groups: no pair of users is made.
    own = users.select("user_id", F.concat(F.lit("t"), F.col("user_id") % 10).alias("t"), F.concat(F.lit("s"), F.col("user_id") % 7).alias("s"))
    both = own.groupBy("t", "s").agg(F.count("*").alias("both"))
    n = lambda c: sizes.select(F.col("g").alias(c), F.col("n").alias(f"n_{c}"))
    return own.join(n("t"), "t").join(n("s"), "s").join(both, ["t", "s"]).select("user_id", (F.col("n_t") + F.col("n_s") - F.col("both")).alias("visible"))


def q05_join_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members joining by code: codes are trimmed and lower-cased, must have six letters or digits, name a group that isn't deleted, and members join once."""
    s = _table(spark, sf_dir, "supplier")
    groups = s.where("s_suppkey % 5 <> 0").select(F.substring(F.sha1("s_name"), 1, 6).alias("code"), F.col("s_suppkey").alias("group_id"))
    c = _table(spark, sf_dir, "customer")
    asked = c.select(F.col("c_custkey").alias("user_id"), F.lower(F.trim(F.concat(F.lit(" "), F.upper(F.substring(F.sha1(F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 120).cast("string"), 9, "0"))), 1, 6))))).alias("code")).where(F.col("code").rlike("^[a-z0-9]{6}$"))
    members = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    return asked.join(groups, "code").join(members, "user_id", "left_anti").select("user_id", "group_id")


def ttok_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the answer with the newest token of a stage counts."""
    return _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("token"), F.max_by(F.floor("value"), "event_id").alias("answer"))


QUERIES = {
    "A04_degrees": a04_degrees, "A08_boundary": a08_boundary, "A12_moving_time": a12_moving_time, "J07_nearest": j07_nearest, "J10_corridor": j10_corridor, "J12_box": j12_box,
    "J16_avoid": j16_avoid, "J17_live_members": j17_live_members, "J19_visible": j19_visible, "P19_access_buckets": p19_access_buckets, "P22_policies": p22_policies,
    "P23_policy": p23_policy, "P25_spine": p25_spine, "P29_bits": p29_bits, "P31_regions": p31_regions, "P33_headings": p33_headings, "P40_escape": p40_escape,
    "Q05_join_codes": q05_join_codes, "RBFS_regions": rbfs_regions, "RELL_prune": rell_prune, "TALRT_alerts": talrt_alerts, "TEXP_reports": texp_reports, "TTOK_newest": ttok_newest,
    "W01_along": w01_along, "W16_splits": w16_splits,
}

_TOUCHING = "SELECT edge_id, m FROM e WHERE a IN (SELECT node_id FROM k) OR b IN (SELECT node_id FROM k)"
_HAV = "2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - ({h})))"


def _hav_sql(lon: float, lat: float) -> str:
    h = f"(pow(sin(radians(lat_e5 / 1e5 - ({lat})) / 2), 2) + cos(radians({lat})) * cos(radians(lat_e5 / 1e5)) * pow(sin(radians(lon_e5 / 1e5 - ({lon})) / 2), 2))"
    return _HAV.format(h=h)


def _segment_sql(a: tuple, b: tuple) -> str:
    scale, x, y = f"cos(radians({(a[1] + b[1]) / 2}))", f"(lon_e5 / 1e5 - ({a[0]}))", f"(lat_e5 / 1e5 - ({a[1]}))"
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = f"least(1.0, greatest(0.0, ({x} * {scale} * ({dx}) * {scale} + {y} * ({dy})) / (pow(({dx}) * {scale}, 2) + pow({dy}, 2))))"
    return f"111320.0 * sqrt(pow({x} * {scale} - {t} * ({dx}) * {scale}, 2) + pow({y} - {t} * ({dy}), 2)) <= {BUFFER_M}"


_PRESENCE = "r AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'breakdown' WHEN 'signup' THEN 'stuck' ELSE 'available' END AS status, CASE WHEN event_id % 7 <> 0 THEN -6600000 + CAST(floor(value) AS BIGINT) % 1000 END AS lng_e5 FROM events)"


_CUSTOMER_PLACES = "SELECT c_custkey, -141.0::DOUBLE + (c_custkey * 37 % 900) / 10.0::DOUBLE AS lon, 41.0::DOUBLE + (c_custkey * 53 % 420) / 10.0::DOUBLE AS lat FROM customer"


def _regions_sql(points: str = _CUSTOMER_PLACES) -> str:
    """Regions of points (c_custkey, lon, lat): boxes as a table of hits for each point; rules over the set of hits, written out."""
    boxes = ", ".join(f"('{n}', {w}::DOUBLE, {s}::DOUBLE, {e}::DOUBLE, {u}::DOUBLE, {k})" for k, (n, (w, s, e, u)) in enumerate(rules.regions_by_area()))
    has = lambda *names: " AND ".join(f"list_contains(ids, '{n}')" for n in names)
    return f"""WITH p AS ({points}),
b(name, w, s, e, n, k) AS (VALUES {boxes}), h AS (SELECT c_custkey, lon, lat, coalesce(list(name ORDER BY k) FILTER (name IS NOT NULL), []) AS ids FROM p LEFT JOIN b ON lon BETWEEN w AND e AND lat BETWEEN s AND n GROUP BY ALL)
SELECT c_custkey, ids[1] AS smallest, coalesce(CASE
  WHEN {has('ab', 'bc')} THEN CASE WHEN lat >= 54 AND lon < -120 OR lat < 54 AND lon < -116.4 THEN 'bc' ELSE 'ab' END
  WHEN {has('on', 'mb')} THEN CASE WHEN lon < -95.15 THEN 'mb' ELSE 'on' END
  WHEN {has('mb', 'sk')} THEN CASE WHEN lon < -101.36 THEN 'sk' ELSE 'mb' END
  WHEN {has('sk', 'ab')} THEN CASE WHEN lon < -110 THEN 'ab' ELSE 'sk' END
  WHEN {has('on', 'qc')} THEN CASE WHEN lon >= -74.5 OR lat >= 45.9 AND lon >= -76 OR lon BETWEEN -76.5 AND -74.5 AND lat >= CASE WHEN lon >= -75.55 THEN 45.475 WHEN lon >= -75.75 THEN 45.44 WHEN lon >= -75.95 THEN 45.4 ELSE 45.38 END THEN 'qc' ELSE 'on' END
  WHEN {has('ns', 'nb', 'pe')} THEN CASE WHEN lat < 46 AND lon >= -64.27 THEN 'ns' WHEN lat >= 46 AND lon >= -63.75 THEN 'pe' ELSE 'nb' END
  WHEN {has('ns', 'pe')} THEN 'pe'
  WHEN {has('ns', 'nb')} THEN CASE WHEN lon >= -64.27 THEN 'ns' ELSE 'nb' END
  WHEN {has('nb', 'pe')} THEN CASE WHEN lat >= 46 AND lon >= -63.75 THEN 'pe' ELSE 'nb' END
  WHEN {has('nb', 'qc')} AND (lon <= -68.45 OR lat >= 47.7 AND lon <= -68.2) THEN 'qc'
  WHEN {has('nb', 'qc')} AND lon <= -67.2 AND lat >= 47 THEN 'nb' END, ids[1]) AS region FROM h"""


_NEIGHBOURS = ", ".join(f"('{a}', '{b}')" for a, bs in rules.REGION_NEIGHBOURS.items() for b in bs)
ORACLE_SQL = {
    "A04_degrees": _NET + " SELECT v AS node_id, count(*) AS degree FROM (SELECT a AS v FROM e WHERE a <> b UNION ALL SELECT b FROM e WHERE a <> b) GROUP BY v",
    "A08_boundary": _NET + ", x AS (SELECT e.a, e.b, p.c_nationkey AS region FROM e JOIN customer p ON p.c_custkey = e.a JOIN customer q ON q.c_custkey = e.b WHERE p.c_nationkey = q.c_nationkey), d AS (SELECT region, v AS node_id, count(*) AS degree FROM (SELECT region, a AS v FROM x UNION ALL SELECT region, b FROM x) GROUP BY 1, 2), t AS (SELECT * FROM d JOIN n USING (node_id)), k AS (SELECT region, min(lon_e5) AS w, max(lon_e5) AS o, min(lat_e5) AS s, max(lat_e5) AS u FROM t GROUP BY region) SELECT t.region, node_id FROM t JOIN k ON k.region = t.region WHERE degree = 1 AND ((lon_e5 - w) * 50 <= o - w OR (o - lon_e5) * 50 <= o - w OR (lat_e5 - s) * 50 <= u - s OR (u - lat_e5) * 50 <= u - s)",
    "A12_moving_time": _NET + " SELECT rt, CAST(floor((sum(m * [45, 70, 90, 126, 105][s + 1]) * 72 + 31500) / 63000.0) AS BIGINT) AS seconds FROM e GROUP BY rt",
    "J07_nearest": f"WITH n AS ({NODES_SQL}), p AS (SELECT s_suppkey AS point_id, -6600000 + s_suppkey * 137 % 30000 AS x, 4400000 + s_suppkey * 211 % 50000 AS y FROM supplier), c AS (SELECT point_id, node_id, (x - lon_e5) * (x - lon_e5) + (y - lat_e5) * (y - lat_e5) AS d2 FROM p, n) SELECT point_id, node_id, CAST(d2 AS BIGINT) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, node_id) AS k FROM c WHERE d2 <= 810000) WHERE k = 1",
    "J10_corridor": _NET + ", k AS (SELECT node_id FROM n WHERE " + " OR ".join(f"({_segment_sql(a, b)})" for a, b in zip(CORRIDOR, CORRIDOR[1:])) + ") " + _TOUCHING,
    "J12_box": _NET + ", k AS (SELECT node_id FROM n WHERE lon_e5 BETWEEN -6595000 AND -6580000 AND lat_e5 BETWEEN 4400000 AND 4403000) " + _TOUCHING,
    "J16_avoid": _NET + " SELECT edge_id, m FROM e WHERE seq NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "J17_live_members": "WITH s AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1) SELECT user_id % 10 AS group_id, count(*) AS members, count(*) FILTER (last_seen > (SELECT max(ts) FROM events) - INTERVAL 2 HOURS) AS live FROM s GROUP BY 1",
    "J19_visible": "WITH u AS (SELECT DISTINCT user_id FROM events) SELECT a.user_id, count(*) AS visible FROM u a JOIN u b ON a.user_id % 10 = b.user_id % 10 OR a.user_id % 7 = b.user_id % 7 GROUP BY 1",
    "P19_access_buckets": _NET + f" SELECT {_BUCKET} AS bucket, CASE WHEN rt = 'resource' THEN 'access' ELSE ['paved', 'gravel', 'access', 'track', 'unknown'][s + 1] END AS surface, count(*) AS edges, CAST(sum(m) AS BIGINT) AS meters FROM e GROUP BY 1, 2",
    "P22_policies": _NET + " SELECT count(*) FILTER (seq % 7 <> 0 AND ac = 0) AS permissive_0_unknown_0, count(*) FILTER (seq % 7 <> 0 AND ac IN (0, 2)) AS permissive_0_unknown_1, count(*) FILTER (seq % 7 = 0 OR ac IN (0, 1)) AS permissive_1_unknown_0, count(*) FILTER (seq % 7 = 0 OR ac IN (0, 1, 2)) AS permissive_1_unknown_1 FROM e",
    "P23_policy": "SELECT c_custkey, c_custkey % 3 <> 2 AS permissive, (c_custkey + 1) % 3 = 1 AND c_custkey % 4 <> 0 AS unknown FROM customer",
    "P25_spine": _NET + " SELECT edge_id, m FROM e WHERE rt IN ('freeway', 'arterial', 'collector') OR a % 30 = 0 AND (s <= 2 OR m >= 200) OR s <= 1 AND m >= 800",
    "P29_bits": _NET + " SELECT edge_id, CAST(s + 16 * ac + CASE WHEN seq % 2 = 0 THEN 256 ELSE 0 END AS INT) AS bits, CAST(s AS INT) AS surface, CAST(ac AS INT) AS access, seq % 2 = 0 AS seasonal FROM e",
    "P31_regions": _regions_sql(),
    "P33_headings": "SELECT event_id, CAST(((CAST(floor(value) AS BIGINT) * 7 - 900) % 360 + 360) % 360 AS BIGINT) AS heading FROM events",
    "P40_escape": """SELECT p_partkey, '&lt;name a=&quot;1&quot;&gt;' || replace(replace(replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || ' &amp; &apos;co&apos;&lt;/name&gt;' AS escaped FROM part""",
    "Q05_join_codes": "WITH g AS (SELECT substr(sha1(s_name), 1, 6) AS code, s_suppkey AS group_id FROM supplier WHERE s_suppkey % 5 <> 0), q AS (SELECT c_custkey AS user_id, substr(sha1('Supplier#' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0')), 1, 6) AS code FROM customer WHERE c_custkey % 3 <> 0) SELECT user_id, group_id FROM q JOIN g USING (code)",
    "RBFS_regions": f"WITH RECURSIVE p(a, b) AS (VALUES {_NEIGHBOURS}), b(x, y) AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(query, node, hops) AS (SELECT DISTINCT x, x, 0 FROM b UNION SELECT r.query, b.y, r.hops + 1 FROM r JOIN b ON b.x = r.node WHERE r.hops < 12) SELECT query, node, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY 1, 2",
    "RELL_prune": _NET + f" SELECT node_id FROM n WHERE {_hav_sql(-66.0, 44.0)} + {_hav_sql(-65.8, 44.03)} <= 1.28 * 17000.0 * (1 + 1e-7)",
    "TALRT_alerts": f"WITH {_PRESENCE} SELECT user_id, status, max(event_id) AS alert_id, arg_max(lng_e5, event_id) AS lng_e5 FROM r WHERE status <> 'available' AND lng_e5 IS NOT NULL GROUP BY 1, 2",
    "TEXP_reports": "SELECT ts + INTERVAL 72 HOURS < (SELECT max(ts) FROM events) AS expired, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "TTOK_newest": "SELECT user_id, event_type, max(event_id) AS token, CAST(floor(arg_max(value, event_id)) AS BIGINT) AS answer FROM events GROUP BY 1, 2",
    "W01_along": _NET + " SELECT a, seq, CAST(sum(m) OVER w AS BIGINT) AS along, lead(m) OVER w AS next_m FROM e WINDOW w AS (PARTITION BY a ORDER BY seq)",
    "W16_splits": _NET + ", d AS (SELECT v, count(*) AS degree FROM (SELECT a AS v FROM e UNION ALL SELECT b FROM e) GROUP BY v) SELECT edge_id, CAST(coalesce(sum(CASE WHEN degree >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY a ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS part FROM e JOIN d ON v = b",
}
