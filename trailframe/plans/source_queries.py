"""Queries of source classification, cues and stage states, with the same in SQL; attributes are dealt to rows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import cues, source_rules
from trailframe.operators import stages

#: Attribute values, dealt to the rows of `part` by p_partkey modulo their number.
INVENTORY = {
    "ROADCLASS": ["Freeway", "Expressway / Highway", "Arterial", "Collector", "Local / Street", "Resource / Recreation", "Ramp", "Service Lane", "Ferry Connection", "Abandoned road", ""],
    "PAVSTATUS": [" Paved ", "Unpaved", "", "Unknown"], "UNPAVSURF": ["", "Gravel", "DIRT", "None", "Unknown"], "PAVSURF": ["Rigid", "asphalt", "Paved"],
    "STRUCTTYPE": ["None", "Bridge covered", "Tunnel", "Barrier Gate", "Blocked passage", "Dam", ""], "TRAFFICDIR": ["Both directions", "Same direction", "Opposite direction", "", "Positive", "Negative", "x", "y", "z"],
}
DESCRIPTIONS = [
    "ROAD Paved 2 lane", "ROAD Unpaved", "Road Resource Access Dry Weather", "Road Resource Access", "TRACK", "TRACK Indefinite", "Track Abandoned", "TRAIL", "Railway", "BRIDGE Paved", "BRIDGE", "Driveway",
    "Ramp Paved RAMP", "Ferry route", "Dam crest", "Something else", "", "Road Unpaved Seasonal", "Footpath", "Ford TRACK Approximate", "No Vehicular Traffic Paved", "Cycleway", "Damaged Unpaved Road",
]
TAGS = {
    "highway": ["motorway", "motorway_link", "trunk", "primary", "secondary", "tertiary_link", "residential", "Track ", "service", "path", "footway", "road", "unclassified", "abandoned", "raceway", "tertiary"],
    "surface": ["", "asphalt", "gravel", "dirt", "unknown", "Ground", "wood"], "access": ["", "yes", "private", "", "no"], "motor_vehicle": ["", "designated", " "],
    "motorcycle": ["", "yes", "no", "", "", "", "", "", "", "", ""], "bridge": ["", "yes", "viaduct", "", "", "", "", "", "", "", "", "", ""], "tunnel": ["no"] * 16 + ["yes"],
}


def _dealt(values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values)).cast("int"))


def _dealt_sql(values: list[str]) -> str:
    return f"[{', '.join(repr(v) for v in values)}][p_partkey % {len(values)} + 1]"


def _parts(spark: SparkSession, sf_dir: str, struct: Column) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", struct.alias("r")).select("p_partkey", "r.*")


def p01_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, source_rules.inventory_road(lambda name: _dealt(INVENTORY[name])))


def p02_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, source_rules.described_road(_dealt(DESCRIPTIONS)))


def p06_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, source_rules.tagged_way(lambda name: _dealt(TAGS[name]) if name in TAGS else F.lit(None).cast("string")))


def w05_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = cues.curve_number((10 + F.col("p_partkey") * 7 % 170).cast("double"), (5 + F.col("p_partkey") * 13 % 300).cast("double"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", number.alias("number")).select("p_partkey", "number", cues.severity(F.col("number")).alias("severity"))


def w08_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", cues.junction_side((F.col("p_partkey") * 7 % 360 - 180).cast("double")).alias("side"))


def x02_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages are users, their events those of `events` by id: kinds, points and routes follow from the id."""
    i = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, [*stages.KINDS, "other"])), (i * 5 % 8).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("stage"), i.alias("seq"), kind.alias("kind"), F.when(i % 5 != 0, F.concat(F.lit("s"), i)).alias("start_point"),
        F.when(i % 7 != 0, F.concat(F.lit("e"), i)).alias("end_point"), F.when(i % 3 != 0, F.concat(F.lit("r"), i)).alias("route"))
    return stages.stage_states(rows)


QUERIES = {"P01_inventory": p01_inventory, "P02_descriptions": p02_descriptions, "P06_ways": p06_ways, "W05_curves": w05_curves, "W08_junctions": w08_junctions, "X02_stages": x02_stages}

_P01_SQL = "WITH t AS (SELECT p_partkey, " + ", ".join(f"trim({_dealt_sql(v)}) AS {k}" for k, v in INVENTORY.items()) + r""" FROM part)
SELECT p_partkey, CASE WHEN ROADCLASS ILIKE '%abandoned%' THEN 'abandoned' WHEN ROADCLASS ILIKE '%ferry%' THEN 'ferry_as_roadseg' END AS reason,
  CASE WHEN g THEN 'gravel' WHEN p THEN 'paved' WHEN b THEN 'resource' ELSE 'unknown' END AS surface, CASE WHEN g OR p THEN 'high' WHEN b THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN ROADCLASS IN ('Freeway', 'Expressway / Highway') THEN 'freeway' WHEN ROADCLASS = 'Resource / Recreation' THEN 'resource' WHEN ROADCLASS = 'Local / Street' THEN 'local' WHEN ROADCLASS = 'Service Lane' THEN 'service'
    WHEN ROADCLASS IN ('Arterial', 'Collector', 'Ramp') THEN lower(ROADCLASS) ELSE 'unknown' END AS road_class,
  CASE WHEN b AND NOT g AND NOT p THEN 'motorized_unknown' ELSE 'motorized_permissive' END AS access,
  CASE STRUCTTYPE WHEN 'Bridge covered' THEN 'bridge' WHEN 'Tunnel' THEN 'tunnel' WHEN 'Barrier Gate' THEN 'blocked_passage' WHEN 'Blocked passage' THEN 'blocked_passage' ELSE 'none' END AS structure,
  CASE WHEN TRAFFICDIR IN ('Same direction', 'Positive') THEN 'forward' WHEN TRAFFICDIR IN ('Opposite direction', 'Negative') THEN 'reverse' ELSE 'both' END AS direction
FROM (SELECT *, PAVSTATUS = 'Unpaved' OR UNPAVSURF IN ('Gravel', 'DIRT') AS g, PAVSTATUS = 'Paved' OR PAVSURF IN ('asphalt', 'Paved') AS p, ROADCLASS = 'Resource / Recreation' AS b FROM t)"""

_P02_SQL = f"WITH t AS (SELECT p_partkey, {_dealt_sql(DESCRIPTIONS)} AS d FROM part), u AS (SELECT *, " + r"""
  CASE WHEN regexp_matches(d, '\b(bridge)\b', 'i') THEN 'bridge' WHEN regexp_matches(d, '\b(ford)\b', 'i') THEN 'ford' ELSE 'none' END AS structure FROM t
), v AS (SELECT *, CASE WHEN regexp_matches(d, '\bpaved\b', 'i') THEN 'paved' WHEN d ILIKE '%resource access%' THEN 'resource' WHEN regexp_matches(d, '\btrack\b', 'i') THEN 'track' WHEN d ILIKE '%unpaved%' THEN 'gravel'
  WHEN structure <> 'none' THEN 'unknown' END AS surface FROM u)
SELECT p_partkey, CASE WHEN d = '' THEN 'missing_feat_desc' WHEN d ILIKE 'no vehicular%' THEN 'no_vehicular_traffic' WHEN d = 'TRAIL' THEN 'non_motorized_trail' WHEN d = 'Railway' THEN 'railway' WHEN d = 'Ferry route' THEN 'ferry'
    WHEN d = 'Driveway' THEN 'driveway' WHEN d = 'Dam crest' THEN 'dam' WHEN d = 'Footpath' THEN 'pedestrian_only' WHEN d = 'Cycleway' THEN 'bicycle_only' WHEN d = 'Something else' THEN 'unclassified_description' END AS reason,
  surface, CASE WHEN surface = 'paved' AND d ILIKE '%ramp%' THEN 'ramp' WHEN surface IN ('paved', 'gravel') THEN 'local' WHEN surface IN ('resource', 'track') THEN surface ELSE 'unknown' END AS road_class, structure,
  CASE WHEN d ILIKE '%abandoned%' THEN 'motorized_restricted' WHEN surface IN ('paved', 'gravel', 'resource') THEN 'motorized_permissive' ELSE 'motorized_unknown' END AS access,
  CASE WHEN d ILIKE '%abandoned%' OR surface = 'track' AND regexp_matches(d, 'indefinite|approximate', 'i') THEN 'low' WHEN surface IN ('paved', 'gravel') OR surface = 'resource' AND d NOT ILIKE '%dry weather%' THEN 'high' ELSE 'medium' END AS confidence,
  regexp_matches(d, 'dry weather|seasonal|winter', 'i') AS seasonal FROM v"""

_P06_SQL = "WITH t AS (SELECT p_partkey, " + ", ".join(f"lower(trim({_dealt_sql(v)})) AS {k}" for k, v in TAGS.items()) + r""" FROM part), u AS (SELECT *, coalesce(nullif(motor_vehicle, ''), motorcycle) AS motor FROM t
), v AS (SELECT *, CASE WHEN surface IN ('asphalt', 'wood') THEN 'paved' WHEN surface = 'gravel' THEN 'gravel' WHEN surface IN ('dirt', 'ground') THEN 'resource' END AS tagged,
  CASE WHEN highway LIKE '%\_link' ESCAPE '\' THEN 'ramp' WHEN highway = 'motorway' THEN 'freeway' WHEN highway IN ('trunk', 'primary') THEN 'arterial' WHEN highway = 'secondary' THEN 'collector' WHEN highway = 'track' THEN 'track'
    WHEN highway IN ('residential', 'service') THEN 'service' ELSE 'local' END AS c FROM u)
SELECT p_partkey, CASE WHEN access IN ('no', 'private') OR motor IN ('no', 'private') THEN 'access_denied' WHEN highway = 'abandoned' THEN 'abandoned'
    WHEN highway IN ('path', 'footway') AND motor NOT IN ('yes', 'designated') AND motorcycle <> 'yes' THEN 'foot_bike_only' WHEN highway IN ('path', 'footway', 'raceway') THEN 'highway_excluded' END AS reason,
  coalesce(tagged, CASE WHEN highway IN ('track', 'service') THEN 'resource' WHEN highway IN ('motorway', 'motorway_link', 'trunk', 'primary') THEN 'paved' ELSE 'unknown' END) AS surface,
  CASE WHEN tagged = 'resource' AND c = 'local' THEN 'resource' ELSE c END AS road_class, CASE WHEN bridge = 'yes' THEN 'bridge' WHEN tunnel = 'yes' THEN 'tunnel' ELSE 'none' END AS structure FROM v"""

_W05_SQL = """WITH t AS (SELECT p_partkey, 10 + p_partkey * 7 % 170 AS d, 5 + p_partkey * 13 % 300 AS l FROM part), r AS (SELECT *, l / greatest(radians(d), 0.08) AS r FROM t
), a AS (SELECT *, CASE WHEN r >= 220 THEN 6 WHEN r >= 140 THEN 5 WHEN r >= 85 THEN 4 WHEN r >= 50 THEN 3 WHEN r >= 28 THEN 2 ELSE 1 END AS n0 FROM r
), b AS (SELECT *, CASE WHEN d >= 75 AND r >= 160 THEN greatest(n0, 5) ELSE n0 END AS n1 FROM a), c AS (SELECT *, CASE WHEN d >= 75 AND r >= 240 THEN 6 ELSE n1 END AS n2 FROM b
), e AS (SELECT *, CASE WHEN d >= 55 AND l < 55 AND r < 45 THEN least(n2, 3) ELSE n2 END AS n3 FROM c), f AS (SELECT *, CASE WHEN d >= 70 AND l < 45 AND r < 32 THEN least(n3, 2) ELSE n3 END AS n4 FROM e
), g AS (SELECT *, CASE WHEN n4 = 1 AND NOT (d >= 120 AND r < 36) THEN 2 WHEN n4 <> 1 AND d >= 140 AND r < 28 THEN 1 ELSE n4 END AS n5 FROM f
), h AS (SELECT p_partkey, CASE WHEN d >= 15 THEN CASE WHEN d < 35 AND n5 <= 3 THEN 6 ELSE n5 END END AS number FROM g)
SELECT p_partkey, CAST(number AS INT) AS number, CASE WHEN number <= 2 THEN 'tight' WHEN number <= 4 THEN 'normal' WHEN number <= 6 THEN 'fast' END AS severity FROM h"""

_X02_SQL = """WITH e AS (SELECT user_id AS stage, event_id AS seq, ['set-start', 'set-end', 'set-points', 'invalidate', 'route-failed', 'route-start', 'route-success', 'other'][event_id * 5 % 8 + 1] AS kind,
  CASE WHEN event_id % 5 <> 0 THEN 's' || event_id END AS sp, CASE WHEN event_id % 7 <> 0 THEN 'e' || event_id END AS ep, CASE WHEN event_id % 3 <> 0 THEN 'r' || event_id END AS rt FROM events
), k AS (SELECT * FROM e WHERE kind <> 'other'
), c AS (SELECT *, max(CASE WHEN kind NOT IN ('route-start', 'route-success') THEN seq ELSE -1 END) OVER (PARTITION BY stage) AS cleared FROM k
), s AS (SELECT stage, last(kind ORDER BY seq) AS kind, last(sp ORDER BY seq) FILTER (kind = 'set-start' OR kind = 'set-points' AND sp IS NOT NULL) AS start_point,
  last(ep ORDER BY seq) FILTER (kind = 'set-end' OR kind = 'set-points' AND ep IS NOT NULL) AS end_point, last(rt ORDER BY seq) FILTER (kind = 'route-success' AND rt IS NOT NULL AND seq > cleared) AS route FROM c GROUP BY stage)
SELECT stage, CASE WHEN start_point IS NULL OR end_point IS NULL THEN 'draft' WHEN kind = 'route-start' THEN 'loading' WHEN kind = 'route-failed' THEN 'failed' WHEN route IS NOT NULL THEN 'complete' ELSE 'ready' END AS status,
  start_point, end_point, route FROM s"""

ORACLE_SQL = {
    "P01_inventory": _P01_SQL, "P02_descriptions": _P02_SQL, "P06_ways": _P06_SQL, "W05_curves": _W05_SQL, "X02_stages": _X02_SQL,
    "W08_junctions": "SELECT p_partkey, CASE WHEN abs(p_partkey * 7 % 360 - 180) < 15 THEN 'straight' WHEN p_partkey * 7 % 360 > 180 THEN 'right' ELSE 'left' END AS side FROM part",
}
