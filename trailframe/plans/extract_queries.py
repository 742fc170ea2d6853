"""Queries of provincial and trail classification, extracts and numbering, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import capillary_rules as rules
from trailframe.operators import extracts
from trailframe.operators.components import checkpointed, connected_components
from trailframe.plans.queries import _CC, _NET
from trailframe.plans.source_queries import INVENTORY, _dealt, _dealt_sql, _parts
from trailframe.sources.network import edges, nodes

#: Attribute values, dealt to the rows of `part` by p_partkey modulo their number.
FREE = ["Gravel road", "Closed in winter", "cut line 7", "Truck trail", "ASPHALT", "Winter road", "seismic", "No-motor zone", "earth", "Private trail", ""]
RESOURCE = {
    "NATIONAL_ROAD_CLASS": ["Resource / Recreation", "Local", "Arterial", "", "Unknown", "Gravel", "Street", "Collector resource", "Local road", "Access"], "CLOSED_STATE": ["", "Open", "CLOSED", "", "", "", ""],
    "PRIVATE_ROAD_IND": ["No"] * 8 + ["Y", "true", ""], "YEAR_DECOMMISSIONED": [" "] * 12 + ["1999"],
}
MULTI = {"Gestion": ["", "Public", "Fermé", "zec", "ferme", ""] + [""] * 5, "Notes": ["", "accès interdit", "x" * 150 + " interdit partout"], "CaractRte": ["", "Pavé", "Gravier", "Sentier", "béton", "", "non pavé"], "Che_Multi": ["OUI", "piste"]}
TENURE = {"LIFE_CYCLE_STATUS_CODE": ["ACTIVE", "retired", "PENDING", "", ""], "FILE_STATUS_CODE": ["", "APPLICATION", "CANCELLED"], "RETIREMENT_DATE": ["", "", "", "2001-01-01"]}
TRAIL = {
    "highway": ["track", "path", "bridleway", "road", ""], "motorcycle": ["", "Yes", "no", "", "", ""], "atv": ["", "", "designated", "", "private", "", ""], "tracktype": ["", "grade1", "grade2", "grade3", "grade4", "Grade5", "grade5", "", "x"],
    "surface": ["", "Asphalt", "dirt"], "access": ["private", "", "", "yes"],
}
HUBS, HUB_M = [(-65.9, 44.01)], 2_000.0


def _given(values: dict[str, list[str]]):
    return lambda name: _dealt(values[name]) if name in values else F.lit(None).cast("string")


def p07_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, rules.free_attributes(F.struct(_dealt(FREE).alias("description"))))


def p08_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, rules.resource_road(_given(RESOURCE)))


def p09_multi_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, rules.multi_use_road(_given(MULTI)))


def p10_tenures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, F.struct(rules.tenure_reason(_given(TENURE)).alias("reason")))


def p12_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, rules.display_class(_given(INVENTORY)))


def p13_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, rules.trail(_given(TRAIL)))


def p14_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, F.struct(rules.grade_class(_given(TRAIL)).alias("grade")))


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.when(F.col("seq") % 3 == 0, "National Road Network").when(F.col("seq") % 3 == 1, "OpenStreetMap")
    return edges(spark, sf_dir).withColumns({"src": src, "rt": F.when(F.col("seq") % 4 != 0, F.col("rt"))})


def rext_longhaul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.with_ends(_sourced(spark, sf_dir), nodes(spark, sf_dir)).where(extracts.is_through()).select("edge_id", "m")


def rext_unclassed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.with_ends(_sourced(spark, sf_dir), nodes(spark, sf_dir)).where(extracts.is_through(classed=False)).select("edge_id", "m")


def rext_highway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.highway(edges(spark, sf_dir)).select("edge_id", "m")


def rext_maritime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.maritime(_sourced(spark, sf_dir)).select("edge_id", "m")


def rext_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.hub_extract(extracts.with_ends(_sourced(spark, sf_dir), nodes(spark, sf_dir)), HUBS, HUB_M).select("edge_id", "m")


def j14_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.compacted(edges(spark, sf_dir)).select("edge_id", "a", "b")


def rrel_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return extracts.relabelled(checkpointed(connected_components(e)), e)


def g14_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.sequence(F.lit(0), F.col("p_size").cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array_join(extracts.thinned(line, 6).cast("array<string>"), ",").alias("kept"))


QUERIES = {
    "G14_thinned": g14_thinned, "J14_compact": j14_compact, "P07_attributes": p07_attributes, "P08_resource": p08_resource, "P09_multi_use": p09_multi_use, "P10_tenures": p10_tenures,
    "P12_display": p12_display, "P13_trails": p13_trails, "P14_grades": p14_grades, "REXT_highway": rext_highway, "REXT_hubs": rext_hubs, "REXT_longhaul": rext_longhaul,
    "REXT_maritime": rext_maritime, "REXT_unclassed": rext_unclassed, "RREL_numbers": rrel_numbers,
}


def _t(values: dict[str, list[str]]) -> str:
    return "WITH t AS (SELECT p_partkey, " + ", ".join(f"{_dealt_sql(v)} AS {k}" for k, v in values.items()) + " FROM part)"


_ENDS = _NET + """, k AS (SELECT min(lon_e5) AS w, max(lon_e5) AS o, min(lat_e5) AS s0, max(lat_e5) AS u FROM n
), p AS (SELECT n.*, lon_e5 <= w + (o - w) * 0.04 OR lon_e5 >= o - (o - w) * 0.04 OR lat_e5 <= s0 + (u - s0) * 0.04 OR lat_e5 >= u - (u - s0) * 0.04 AS near FROM n, k
), g AS (SELECT e.* REPLACE (CASE WHEN seq % 4 <> 0 THEN rt END AS rt), x.near OR y.near AS border, x.lon_e5 AS xa, x.lat_e5 AS ya, y.lon_e5 AS xb, y.lat_e5 AS yb FROM e JOIN p x ON x.node_id = a JOIN p y ON y.node_id = b
), h AS (SELECT *, coalesce(rt IN ('freeway', 'arterial', 'ramp', 'collector'), false) OR rt IS NULL AND s NOT IN (2, 3) OR border AND s <> 3 AND m >= 150 AS through FROM g)"""


def _near_sql(x: str, y: str) -> str:
    (lon, lat), = HUBS
    h = f"(pow(sin(radians({lat} - {y} / 1e5) / 2), 2) + cos(radians({y} / 1e5)) * cos(radians({lat})) * pow(sin(radians({lon} - {x} / 1e5) / 2), 2))"
    return f"2 * 6371000.0 * atan2(sqrt{h}, sqrt(1 - {h})) <= {HUB_M}"


ORACLE_SQL = {
    "G14_thinned": "SELECT p_partkey, CASE WHEN p_size < 6 THEN array_to_string(range(0, p_size + 1), ',') ELSE array_to_string([CAST(floor(i * p_size / 5.0 + 0.5) AS INT) for i in range(0, 6)], ',') END AS kept FROM part",
    "J14_compact": _NET + ", x AS (SELECT * FROM e), d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT a AS v FROM x UNION SELECT b FROM x)) SELECT edge_id, p.i AS a, q.i AS b FROM x JOIN d p ON p.v = x.a JOIN d q ON q.v = x.b",
    "P07_attributes": _t({"d": FREE}) + " SELECT p_partkey, CASE WHEN d IN ('Closed in winter', 'No-motor zone', 'Private trail') THEN 'restricted_or_closed' WHEN d IN ('cut line 7', 'seismic') THEN 'cutline_not_routable' END AS reason, CASE WHEN d = 'ASPHALT' THEN 'paved' WHEN d IN ('Gravel road', 'earth') THEN 'gravel' WHEN d LIKE '%trail' THEN 'track' ELSE 'resource' END AS surface FROM t",
    "P08_resource": _t(RESOURCE) + " SELECT p_partkey, CASE WHEN YEAR_DECOMMISSIONED = '1999' OR CLOSED_STATE = 'CLOSED' OR PRIVATE_ROAD_IND IN ('Y', 'true') THEN 'restricted_or_closed' WHEN NATIONAL_ROAD_CLASS IN ('Local', 'Arterial', 'Street', 'Local road') THEN 'orn_or_conventional_skip' END AS reason, 'gravel' AS surface FROM t",
    "P09_multi_use": _t(MULTI) + ", u AS (SELECT *, CASE WHEN CaractRte <> '' THEN CaractRte ELSE Che_Multi END AS c FROM t), v AS (SELECT *, CASE WHEN c IN ('Pavé', 'béton', 'non pavé') THEN 'paved' WHEN c = 'Gravier' THEN 'gravel' WHEN c IN ('Sentier', 'piste') THEN 'track' ELSE 'resource' END AS surface FROM u) SELECT p_partkey, CASE WHEN Gestion IN ('Fermé', 'ferme') OR Notes = 'accès interdit' THEN 'restricted_or_closed' END AS reason, surface, CASE surface WHEN 'paved' THEN 'local' WHEN 'track' THEN 'track' ELSE 'resource' END AS road_class FROM v",
    "P10_tenures": _t(TENURE) + ", u AS (SELECT *, CASE WHEN LIFE_CYCLE_STATUS_CODE = '' THEN FILE_STATUS_CODE ELSE upper(LIFE_CYCLE_STATUS_CODE) END AS c FROM t) SELECT p_partkey, CASE WHEN c IN ('PENDING', 'APPLICATION') THEN 'pending_or_proposed' WHEN c IN ('RETIRED', 'CANCELLED') OR RETIREMENT_DATE <> '' THEN 'deactivated_or_closed' END AS reason FROM u",
    "P12_display": _t(INVENTORY) + ", u AS (SELECT *, PAVSTATUS = 'Unpaved' OR UNPAVSURF IN ('Gravel', 'DIRT') AS g, PAVSTATUS = ' Paved ' OR PAVSURF <> 'Rigid' AS p FROM t) SELECT p_partkey, CASE WHEN g OR NOT p AND ROADCLASS LIKE 'Resource%' THEN 'gravel' ELSE 'paved' END AS track_class, CASE WHEN g OR p THEN 'pavement-field' ELSE 'roadclass-inferred' END AS confidence FROM u",
    "P13_trails": _t(TRAIL) + ", u AS (SELECT *, CASE WHEN motorcycle = 'Yes' AND highway = 'path' THEN 'single' WHEN atv = 'designated' OR lower(tracktype) IN ('grade4', 'grade5') THEN 'atv' WHEN highway IN ('path', 'bridleway') THEN 'single' WHEN surface = 'Asphalt' OR tracktype = 'grade1' THEN 'paved' ELSE 'gravel' END AS kind FROM t) SELECT p_partkey, kind, highway IN ('track', 'path', 'bridleway') AND kind <> 'paved' AS keep, CASE WHEN motorcycle = 'Yes' OR atv = 'designated' THEN 'allowed' WHEN motorcycle = 'no' OR atv = 'private' OR access = 'private' THEN 'restricted' ELSE 'unknown' END AS status, CASE WHEN motorcycle = 'Yes' THEN 'motorcycle=Yes' WHEN atv = 'designated' THEN 'atv=designated' WHEN motorcycle = 'no' THEN 'motorcycle=no' WHEN atv = 'private' THEN 'atv=private' WHEN access = 'private' THEN 'access=private' ELSE 'no OSM motor access tag' END AS detail FROM u",
    "P14_grades": _t(TRAIL) + " SELECT p_partkey, CASE WHEN highway IN ('path', 'bridleway') THEN 'single' WHEN highway = 'track' AND tracktype IN ('grade1', 'grade2') THEN 'g2' WHEN highway = 'track' AND tracktype IN ('grade3', 'grade4', 'grade5') THEN replace(tracktype, 'grade', 'g') ELSE 'unknown' END AS grade FROM t",
    "REXT_highway": _NET + " SELECT edge_id, m FROM e WHERE s <> 3",
    "REXT_hubs": _ENDS + f" SELECT edge_id, m FROM h WHERE through OR s <> 3 AND ({_near_sql('xa', 'ya')} OR {_near_sql('xb', 'yb')})",
    "REXT_longhaul": _ENDS + " SELECT edge_id, m FROM h WHERE through",
    "REXT_maritime": _NET + " SELECT edge_id, m FROM e WHERE CASE WHEN seq % 3 = 0 THEN s <> 3 ELSE seq % 4 <> 0 AND rt IN ('freeway', 'arterial', 'ramp', 'collector') END",
    "REXT_unclassed": _ENDS + " SELECT edge_id, m FROM h WHERE s <> 3 AND (border AND m >= 100 OR m >= 350)",
    "RREL_numbers": _NET + _CC + ", f AS (SELECT component, min(seq) AS seq FROM x JOIN cc ON cc.node = x.a GROUP BY component) SELECT component, row_number() OVER (ORDER BY seq) - 1 AS number FROM f",
}
