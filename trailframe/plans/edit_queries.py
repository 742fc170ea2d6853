"""Queries of stage edits, planned graphs, road fabric and lines with bends, with the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import classify
from trailframe.functions.source_rules import packed_feature
from trailframe.operators import conflation, extracts, groups, requests, routing, trip_edits
from trailframe.operators.components import checkpointed
from trailframe.plans.chain_queries import _WAYS, _long_ways
from trailframe.plans.queries import _lines
from trailframe.plans.rule_text_queries import _dealt, _dealt_sql, _hav
from trailframe.sources.network import EDGES_SQL, NODES_SQL, edges, nodes

_NET = f"WITH n AS ({NODES_SQL}), e AS ({EDGES_SQL})"
KINDS = ["add", "set-end", "set-start", "add", "route-success", "remove-waypoint", "set-end", "move", "remove", "set-end", "route-success", "invalidate"]


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as edits of their users' trips."""
    k = F.col("event_id")
    value = F.floor("value").cast("long")
    point = F.struct((value % 50).cast("double").alias("lng"), (value % 7).cast("double").alias("lat"))
    name = F.when(k % 11 == 0, trip_edits.FIRST).otherwise(F.concat(F.lit("s"), ((k + value) % 6).cast("string")))
    kind = _dealt(k * 5 + value, KINDS)
    none = F.lit(None)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("trip"), k.alias("seq"), kind.alias("kind"), name.alias("stage"), F.when(k % 4 == 0, "dirt").alias("profile"), F.when((kind == "set-start") | (k % 9 == 0), point).alias("start"), F.when((kind == "set-end") | (k % 5 == 0), point).otherwise(none).alias("end"),
        F.when(k % 3 > 0, F.concat(F.lit("r"), k.cast("string"))).alias("route"), (k % 4).alias("from"), (value % 5 - 1).alias("to"))


def x03_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of every trip after all its edits."""
    out = trip_edits.replayed(edit_log(spark, sf_dir))
    return out.select("trip", "place", "stage", "profile", F.col("start.lng").alias("start_lng"), F.col("start.lat").alias("start_lat"), F.col("end.lng").alias("end_lng"), F.col("end.lat").alias("end_lat"), "route", "status")


#: The packs that the query takes to be at hand.
FULL, LONG = ("ns", "nb", "qc", "on", "mb", "ab"), ("ns", "nb", "qc", "on", "sk", "ab", "bc", "canada")


def x11_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which graphs each customer's way loads."""
    k, on = F.col("query"), lambda n, r: F.col("query") % n == r
    packs = spark.createDataFrame([(r, False) for r in FULL] + [(r, True) for r in LONG], "region string, longhaul boolean")
    near = F.transform("places", lambda p, i: F.struct(F.when(on(5, 0), F.get("places", F.lit(0))["lon"] + i * 0.01).when(on(7, 3), F.lit(10.0)).otherwise(p["lon"]).alias("lon"), p["lat"].alias("lat")))
    rows = _long_ways(spark, sf_dir).select("query", F.when(on(13, 0), F.upper(_dealt(k, ["ns", "qc", "bc"]))).alias("region"), near.alias("places"), on(3, 0).alias("prefer_longhaul"), on(4, 1).alias("no_chain"), on(11, 2).alias("no_longhaul"), on(6, 5).alias("server"), on(2, 0).alias("legacy"))
    out = requests.planned(rows, packs)
    return out.select("query", "mode", F.array_join("regions", ",").alias("regions"), F.array_join("missing", ",").alias("missing"), "error")


MODES = ("osm", "osm-provincial", "maritime", "hub", "corridor", "dense", "osm-only")
HUBS = [(-65.9, 44.02), (-65.8, 44.2)]
FABRIC_SOURCES, SERVICE = ["OpenStreetMap roads", "National Road Network", "NSTDB"], "service"


def _fabric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir).withColumns({"src": _dealt(F.col("seq"), FABRIC_SOURCES), "rt": F.when(F.col("seq") % 8 == 5, SERVICE).otherwise(F.col("rt"))})
    return extracts.with_ends(rows, nodes(spark, sf_dir))


def rext_fabric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads of each mode's fabric: the map modes without service roads, "osm-only" with those near hubs, the others with hubs of 3 kilometres."""
    rows = _fabric_edges(spark, sf_dir)
    kept = [extracts.fabric(rows, m, HUBS, 3_000.0, no_service=m in ("osm", "osm-provincial"), service_near_hubs=m == "osm-only").select(F.lit(m).alias("mode"), "edge_id", F.col("ac").cast("int").alias("ac")) for m in MODES]
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def _bent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All roads as lines, every third with a bend, every fifth with two; odd ones, moved a little, are the supplement."""
    d = lambda c: F.col(c) / 1e5
    key, up = F.col("key"), F.when(F.col("key") % 2 == 0, 0.0).otherwise(F.col("key") % 4 * 0.00012)
    p = lambda x, y: F.struct(x.alias("lon"), (y + up).alias("lat"))
    a, b = p(d("x1"), d("y1")), p(d("x2"), d("y2"))
    at = lambda t, off: p(d("x1") + (d("x2") - d("x1")) * t + off, d("y1") + (d("y2") - d("y1")) * t)
    points = F.when(key % 5 == 0, F.array(a, at(0.25, 0.001), at(0.5, 0.002), b)).when(key % 3 == 0, F.array(a, at(0.5, 0.002), b)).otherwise(F.array(a, b))
    rows = _lines(spark, sf_dir).select("key", points.alias("points"))
    return conflation.by_middles(rows.where("key % 2 = 0")), conflation.by_middles(rows.where("key % 2 <> 0"))


def j01_bent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with bends that repeat others, by middle vertex and direction."""
    return conflation.duplicate_pairs(*_bent(spark, sf_dir)).select("base_key", "sup_key", F.round("meters", 3).alias("meters"))


def c09_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four overlapping quarters of the network with the open street map's roads of each, and the components that these make there."""
    rows = extracts.fabric(_fabric_edges(spark, sf_dir), "osm")
    box = nodes(spark, sf_dir).agg(F.struct(*(f(c).alias(n) for n, f, c in (("w", F.min, "lon_e5"), ("e", F.max, "lon_e5"), ("s", F.min, "lat_e5"), ("n", F.max, "lat_e5")))).alias("box")).scalar()
    part = lambda low, high, k: box[low] + F.floor((box[high] - box[low]) * k / 10).cast("long")
    quarter = lambda name, x, y: F.struct(F.lit(name).alias("name"), part("w", "e", x).alias("west"), part("s", "n", y).alias("south"), part("w", "e", x + 6).alias("east"), part("s", "n", y + 6).alias("north"))
    dealt = checkpointed(extracts.dealt_to_boxes(rows, F.array(quarter("sw", 0, 0), quarter("se", 4, 0), quarter("nw", 0, 4), quarter("ne", 4, 4))).select("pack", "edge_id", "a", "b", F.col("ac").cast("int").alias("ac")))
    labels = extracts.pack_components(dealt).withColumnRenamed("node", "a")
    return dealt.join(labels, ["pack", "a"]).select("pack", "edge_id", "ac", "component")


PACKED = {"surfaceClass": ["paved", "access", None, "track", "gravel", ""], "accessClass": ["motorized_permissive", None, "motorized_excluded", "motorized_unknown", "motorized_permissive"], "feat_desc": ["ROAD Paved", "Resource Access ROAD Dry Weather", None, "TRACK Indefinite", "Unpaved ROAD", "ROAD Abandoned Paved", ""],
          "edgeId": ["ns-gov-1", None, "x-7", "ns-3"], "sourceRecordId": [None, "r5", "r9"], "structureType": [None, "bridge"], "confidence": ["high", None, "low"], "seasonal": ["true", "false", None]}


def p04_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a government pack as edges; every eleventh has no line."""
    k = F.col("p_partkey")
    props = lambda name: _dealt(k, PACKED[name]) if name in PACKED else F.lit(None).cast("string")
    end = lambda n: F.when(k % 11 != 0, F.concat((k % 90).cast("string"), F.lit(f",{n}")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k, packed_feature(props, end(1), end(2)).alias("f")).select(k, "f.reason", *(F.when(F.col("f.reason").isNull(), F.col(f"f.{c}")).alias(c) for c in ("edge_id", "record", "surface", "road_class", "access", "structure", "confidence", "seasonal")))


def a11_unrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the roads that begin in each nation, from metres as they are and from rounded ones."""
    nation = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("query"))
    pieces = edges(spark, sf_dir).join(nation, "a").select("query", "edge_id", (F.col("m") / 300 + F.col("seq") % 7 * 0.25).alias("meters"), classify.code_name(F.col("s"), classify.SURFACES).alias("surface"), classify.code_name(F.col("ac"), classify.ACCESSES).alias("access"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("error"))
    shares = lambda rounded, name: routing.route_stats(pieces, rounded).select("query", "pieces", "meters", *(F.col(f"{c}_percent").alias(f"{c}_{name}") for c in ("paved", "dirt", "track", "unknown_access", "verified_access")))
    return shares(False, "exact").join(shares(True, "whole").drop("pieces", "meters"), "query")


def q07_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles after users came, some of whom had one; then some are renamed."""
    k = F.col("c_custkey")
    users = spark.read.parquet(f"{sf_dir}/customer.parquet")
    there = users.where(F.col("c_acctbal") < 0).select(k.alias("user_id"), F.concat(F.lit("Old "), "c_name").alias("display_name"))
    meta = F.when(k % 3 == 0, F.to_json(F.struct(F.col("c_name").alias("display_name")))).when(k % 3 == 1, "{}")
    rows = groups.with_profiles(there, users.select(k.alias("user_id"), meta.alias("meta"))).withColumn("updated_at", F.lit(0).cast("long"))
    renamed = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"), F.lit("Rider").alias("display_name"))
    return groups.touched(rows, renamed, "user_id", F.lit(9).cast("long"))


QUERIES = {"A11_unrounded": a11_unrounded, "Q07_profiles": q07_profiles, "C09_quarters": c09_quarters, "P04_packed": p04_packed, "X03_edits": x03_edits, "X11_modes": x11_modes, "REXT_fabric": rext_fabric, "J01_bent": j01_bent}

_NEAR_HUB = "(" + " OR ".join(f"{_hav(f'(x{e} / 1e5)', f'(y{e} / 1e5)', f'({x})::DOUBLE', f'({y})::DOUBLE')} <= 3000" for x, y in HUBS for e in "ab") + ")"
_THROUGH = "rt IN ('freeway', 'arterial', 'ramp', 'collector')"
_KEPT = {
    "osm": "k = 0 AND rt <> 'service'", "osm-provincial": "k = 2 OR k = 0 AND rt <> 'service'", "osm-only": "k = 0 AND (rt <> 'service' OR hub)",
    "hub": f"k = 0 AND ({_THROUGH} OR hub) OR k = 1 AND s <> 3 AND ({_THROUGH} OR rt <> 'resource' AND hub)",
    **{m: f"k = 0 AND ({_THROUGH} OR hub) OR k = 1 AND s <> 3" for m in ("maritime", "corridor", "dense")},
}
_MID = "WITH l AS (SELECT seq AS key, p.lon_e5 / 1e5 AS xa, p.lat_e5 / 1e5 AS ya, q.lon_e5 / 1e5 AS xb, q.lat_e5 / 1e5 AS yb, CASE WHEN seq % 2 = 0 THEN 0 ELSE seq % 4 * 0.00012::DOUBLE END AS up FROM e JOIN n p ON p.node_id = a JOIN n q ON q.node_id = b)"
_MODE_FLAGS = "query % 3 = 0 OR query % 6 = 5"
_LISTED = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
_D = lambda c: _dealt_sql("p_partkey", PACKED[c])
#: What the descriptions of the query mean: reason, surface, road class, access, confidence, season.
_MEANING = {"ROAD Paved": (None, "paved", "local", "motorized_permissive", "high", False), "Resource Access ROAD Dry Weather": (None, "resource", "resource", "motorized_permissive", "medium", True), "TRACK Indefinite": (None, "track", "track", "motorized_unknown", "low", False),
            "Unpaved ROAD": (None, "gravel", "local", "motorized_permissive", "high", False), "ROAD Abandoned Paved": (None, "paved", "local", "motorized_restricted", "low", False), "": ("missing_feat_desc", None, "unknown", "motorized_unknown", "medium", False)}
_SQL = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"
_MEANT = ", ".join("(" + ", ".join(map(_SQL, (d, *m))) + ")" for d, m in _MEANING.items())
_Y = "y AS (SELECT pack, a, b FROM d WHERE a <> b UNION SELECT pack, b, a FROM d WHERE a <> b)"
_SHARE = lambda test, name: ", ".join(f"CAST(floor(sum(CASE WHEN {test} THEN {x} ELSE 0 END) / sum(meters) * 100 + 0.5) AS BIGINT) AS {name}_{kind}" for x, kind in (("meters", "exact"), ("floor(meters + 0.5)", "whole")))
ORACLE_SQL = {
    "A11_unrounded": _NET + f", p AS (SELECT c_nationkey AS query, m / 300 + seq % 7 * 0.25::DOUBLE AS meters, s, ac FROM e JOIN customer ON c_custkey = a) SELECT query, count(*) AS pieces, round(sum(meters), 2) AS meters, {_SHARE('s = 0', 'paved')}, {_SHARE('s <> 0', 'dirt')}, {_SHARE('s = 3', 'track')}, {_SHARE('ac = 2', 'unknown_access')}, {_SHARE('ac = 0', 'verified_access')} FROM p GROUP BY query",
    "Q07_profiles": "SELECT c_custkey AS user_id, CASE WHEN u.o_custkey IS NOT NULL THEN 'Rider' WHEN c_acctbal < 0 THEN 'Old ' || c_name WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS display_name, CASE WHEN u.o_custkey IS NOT NULL THEN 9 ELSE 0 END::BIGINT AS updated_at FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') u ON o_custkey = c_custkey",
    "P04_packed": f"""WITH t(d, reason, surface, road_class, access, confidence, seasonal) AS (VALUES {_MEANT}),
p AS (SELECT p_partkey, p_partkey % 11 <> 0 AS line, nullif({_D('surfaceClass')}, '') AS s, {_D('accessClass')} AS ac, coalesce({_D('feat_desc')}, '') AS d, {_D('edgeId')} AS e, {_D('sourceRecordId')} AS r, {_D('structureType')} AS st, {_D('confidence')} AS cf, {_D('seasonal')} AS se, (p_partkey % 90) || ',' AS x FROM part),
q AS (SELECT p.*, t.*, s IS NOT NULL AND ac IS NOT NULL AS packed, CASE WHEN s = 'access' THEN 'resource' ELSE s END AS s2, coalesce(r, e, 'unknown') AS rec FROM p JOIN t ON p.d = t.d),
o AS (SELECT *, CASE WHEN NOT line THEN 'no_usable_geometry' WHEN NOT packed AND reason IS NOT NULL THEN reason WHEN packed AND ac = 'motorized_excluded' THEN 'motorized_excluded' END AS why FROM q)
SELECT p_partkey, why AS reason, CASE WHEN why IS NULL THEN CASE WHEN e LIKE 'ns-%' THEN replace(e, 'ns-gov-', 'ns-nstdb-') ELSE 'ns-nstdb-' || substr(sha1(rec || '|0|' || x || '1|' || x || '2'), 1, 12) END END AS edge_id, CASE WHEN why IS NULL THEN rec END AS record, CASE WHEN why IS NULL THEN CASE WHEN packed THEN s2 ELSE surface END END AS surface,
  CASE WHEN why IS NULL THEN CASE WHEN NOT packed THEN road_class WHEN s2 IN ('paved', 'gravel') THEN 'local' ELSE s2 END END AS road_class, CASE WHEN why IS NULL THEN CASE WHEN packed THEN ac ELSE access END END AS access, CASE WHEN why IS NULL THEN CASE WHEN packed THEN coalesce(st, 'none') ELSE 'none' END END AS structure,
  CASE WHEN why IS NULL THEN CASE WHEN packed THEN coalesce(cf, 'medium') ELSE confidence END END AS confidence, CASE WHEN why IS NULL THEN CASE WHEN packed THEN coalesce(se = 'true', false) ELSE seasonal END END AS seasonal FROM o""",
    "C09_quarters": _NET.replace("WITH n", "WITH RECURSIVE n", 1) + f""", k AS (SELECT min(lon_e5) AS w, max(lon_e5) - min(lon_e5) AS dx, min(lat_e5) AS s, max(lat_e5) - min(lat_e5) AS dy FROM n), q(pack, x, y) AS (VALUES ('sw', 0, 0), ('se', 4, 0), ('nw', 0, 4), ('ne', 4, 4)),
box AS (SELECT pack, w + dx * x // 10 AS x1, w + dx * (x + 6) // 10 AS x2, s + dy * y // 10 AS y1, s + dy * (y + 6) // 10 AS y2 FROM q, k),
d AS (SELECT pack, edge_id, a, b, CAST(CASE WHEN ac = 2 THEN 1 ELSE ac END AS INT) AS ac FROM e JOIN n f ON f.node_id = a JOIN n t ON t.node_id = b, box WHERE seq % 3 = 0 AND (f.lon_e5 BETWEEN x1 AND x2 AND f.lat_e5 BETWEEN y1 AND y2 OR t.lon_e5 BETWEEN x1 AND x2 AND t.lat_e5 BETWEEN y1 AND y2)),
{_Y}, cc(pack, node, component) USING KEY (pack, node) AS (SELECT pack, a, a FROM y GROUP BY pack, a UNION (
  SELECT y.pack, y.b, min(cc.component) FROM cc JOIN y ON y.pack = cc.pack AND y.a = cc.node JOIN recurring.cc AS known ON known.pack = y.pack AND known.node = y.b WHERE cc.component < known.component GROUP BY y.pack, y.b))
SELECT d.pack, edge_id, ac, component FROM d JOIN cc ON cc.pack = d.pack AND cc.node = d.a""",
    "REXT_fabric": _NET + f", w AS (SELECT edge_id, seq, s, ac, seq % 3 AS k, CASE WHEN seq % 8 = 5 THEN 'service' ELSE rt END AS rt, p.lon_e5 AS xa, p.lat_e5 AS ya, q.lon_e5 AS xb, q.lat_e5 AS yb FROM e JOIN n p ON p.node_id = a JOIN n q ON q.node_id = b), h AS (SELECT *, {_NEAR_HUB} AS hub FROM w) " + " UNION ALL ".join(f"SELECT '{m}' AS mode, edge_id, CAST(CASE WHEN k = 0 AND ac = 2 THEN 1 ELSE ac END AS INT) AS ac FROM h WHERE {test}" for m, test in _KEPT.items()),
    "J01_bent": _NET + f""", l AS ({_MID} SELECT * FROM l), g AS (SELECT key, CASE WHEN key % 5 = 0 OR key % 3 = 0 THEN xa + (xb - xa) * 0.5 + 0.002::DOUBLE ELSE xb END AS mx, CASE WHEN key % 5 = 0 OR key % 3 = 0 THEN ya + (yb - ya) * 0.5 ELSE yb END + up AS my, xa, ya, xb, yb, up FROM l),
r AS (SELECT key, floor(mx * 1e5 + 0.5) AS x, floor(my * 1e5 + 0.5) AS y, (degrees(atan2((floor((yb + up) * 1e5 + 0.5) - floor((ya + up) * 1e5 + 0.5)) / 1e5, (floor(xb * 1e5 + 0.5) - floor(xa * 1e5 + 0.5)) / 1e5)) + 180) % 180 AS dir FROM g),
c AS (SELECT b.key AS base_key, s.key AS sup_key, {_hav('(s.x / 1e5)', '(s.y / 1e5)', '(b.x / 1e5)', '(b.y / 1e5)')} AS meters, abs(b.dir - s.dir) AS d FROM r b JOIN r s ON b.key % 2 = 0 AND s.key % 2 <> 0 AND abs(b.x - s.x) <= 400 AND abs(b.y - s.y) <= 400)
SELECT base_key, sup_key, round(meters, 3) AS meters FROM c WHERE meters <= 28 AND least(d, 180 - d) <= 28""",
    "X11_modes": _WAYS.replace("FROM customer),", f"""FROM customer),
v AS (SELECT query, query % 13 = 0 AS named, CASE WHEN query % 5 = 0 THEN x1 WHEN query % 7 = 3 THEN 10 ELSE x1 END AS x1, y1, CASE WHEN query % 5 = 0 THEN x1 + 0.01::DOUBLE WHEN query % 7 = 3 THEN 10 ELSE x2 END AS x2, y2 FROM w),""", 1).replace("FROM w UNION ALL SELECT query * 2 + 1, x2, y2 FROM w", "FROM v UNION ALL SELECT query * 2 + 1, x2, y2 FROM v", 1) + f"""
t AS (SELECT v.query, named, least(f.region, t.region) AS r1, greatest(f.region, t.region) AS r2 FROM v JOIN g f ON f.c_custkey = v.query * 2 JOIN g t ON t.c_custkey = v.query * 2 + 1),
c AS (SELECT t.*, CASE WHEN r1 = r2 THEN [r1] ELSE list_sort(path) END AS way, {_MODE_FLAGS} AS long FROM t LEFT JOIN paths ON start = r1 AND goal = r2 AND r1 <> r2),
m AS (SELECT *, list_filter(way, lambda r: NOT list_contains(CASE WHEN long THEN {_LISTED(LONG)} ELSE {_LISTED(FULL)} END, r)) AS gone, len(way) AS n FROM c),
o AS (SELECT *, CASE WHEN named THEN CASE WHEN long THEN 'explicit-longhaul' ELSE 'explicit' END WHEN r1 IS NULL THEN NULL WHEN query % 2 = 0 AND r1 = 'ns' AND r2 = 'ns' THEN 'legacy-production'
  WHEN query % 6 <> 5 AND n >= 4 AND query % 11 <> 2 AND list_contains(way, 'ns') AND list_contains(way, 'bc') THEN 'canada-longhaul-local' WHEN query % 4 <> 1 AND r1 <> r2 AND n >= 2 AND (query % 6 = 5 OR n >= 4) THEN 'canada-chain'
  ELSE CASE WHEN n > 1 THEN 'multi-' ELSE '' END || CASE WHEN long THEN 'longhaul' ELSE 'regional' END || CASE WHEN len(gone) > 0 THEN '-remote' ELSE '-local' END END AS mode FROM m)
SELECT query, mode, CASE WHEN named THEN ['ns', 'qc', 'bc'][query % 3 + 1] ELSE array_to_string(way, ',') END AS regions, CASE WHEN mode LIKE 'multi-%' THEN array_to_string(gone, ',') END AS missing, CASE WHEN NOT named AND r1 IS NULL THEN 'region_unknown' END AS error FROM o""",
}
