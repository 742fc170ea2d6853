"""Queries of reports, source filters and set operations on regions, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import capillary_rules, source_rules
from trailframe.functions import network_rules as rules
from trailframe.operators import reports
from trailframe.plans.extract_queries import TRAIL, _given
from trailframe.plans.rule_text_queries import _dealt, _dealt_sql
from trailframe.plans.source_queries import DESCRIPTIONS, INVENTORY
from trailframe.sources.network import EDGES_SQL, NODES_SQL, edges

_NET = f"WITH n AS ({NODES_SQL}), e AS ({EDGES_SQL})"
REASONS, SURFACES, ACCESSES = [None, "ferry", None, "abandoned", None, None], ["paved", None, "gravel", "track", "resource"], ["motorized_permissive", "motorized_unknown", None]
CODES, KINDS, TOPS = ["RTRAIL", "DLLN", None, "TRACK7", "RESOURCE", "xx"], ["Local", "Trail", None, "Resource Road"], ["Paved", None, "Gravel", "Asphalt", "Dirt"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def a02_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source's report says, its maps as rows."""
    key = F.col("seq")
    rows = edges(spark, sf_dir).select(_dealt(key, REASONS).alias("reason"), _dealt(key, SURFACES).alias("surface"), _dealt(key, ACCESSES).alias("access"), F.col("m").cast("double").alias("meters"))
    out = reports.adapter_report(rows)
    maps = F.flatten(F.array(*(F.transform(F.map_entries(n), lambda e: F.struct(F.lit(n).alias("of"), e["key"].alias("name"), e["value"].alias("n"))) for n in ("reason", "surface", "access"))))  # noqa: B023
    return out.select("scanned", "accepted", "excluded", "meters", F.explode(maps).alias("x")).select("scanned", "accepted", "excluded", "meters", "x.*")


def a18_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and access of the ways that a trail overlay keeps (C13)."""
    rows = _table(spark, sf_dir, "part").select(capillary_rules.trail(_given(TRAIL)).alias("t")).select("t.*").where("keep")
    return reports.counts_by(rows, "kind", "status")


def a19_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, confidence and road classes of an inventory's gravel roads (C13: paved ones are dropped)."""
    rows = _table(spark, sf_dir, "part").select(capillary_rules.display_class(_given(INVENTORY)).alias("d"), _given(INVENTORY)("ROADCLASS").alias("road_class")).select("d.*", "road_class")
    return reports.counts_by(rows.where("track_class = 'gravel'"), "track_class", "confidence", "road_class")


def a20_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = _given(TRAIL)
    ways = _table(spark, sf_dir, "part").select((F.floor(F.col("p_partkey") / 37) % 9).alias("area"), capillary_rules.grade_class(get).alias("grade"), get("highway").alias("highway"), get("tracktype").alias("tracktype"))
    return reports.area_verdict(ways)


def s21_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    get, k = _given(TRAIL), F.col("p_partkey")
    return _table(spark, sf_dir, "part").where(reports.rideable_way(get("highway"), get("surface"), F.when(k % 5 == 0, "yes"))).select("p_partkey")


def s22_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").where(reports.trail_like(_dealt(k, CODES), _dealt(k, KINDS), _dealt(k, TOPS))).select("p_partkey")


def s08_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a box whose descriptions are asked for."""
    k = F.col("p_partkey")
    inside = ((k * 37 % 400) / 100.0).between(1.0, 3.0) & ((k * 53 % 300) / 100.0).between(0.5, 2.5)
    return _table(spark, sf_dir, "part").where(inside & reports.wanted_description(_dealt(k, DESCRIPTIONS))).select("p_partkey")


def l03_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most twenty roads of each class, by seq: a cap that a build is given."""
    return reports.first_of_each(edges(spark, sf_dir), "rt", F.col("seq"), 20).select("edge_id", "rt")


def l01_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the network with their place by edges, most first, then by name."""
    from pyspark.sql import Window

    from trailframe.plans.queries import k04_grid_chunks

    rows = k04_grid_chunks(spark, sf_dir).select(F.concat_ws("_", F.col("cx").cast("string"), F.col("cy").cast("string")).alias("id"), "edges")
    return rows.select("id", "edges", F.row_number().over(Window.orderBy(F.desc("edges"), "id")).alias("place"))  # a row for each chunk of 0.4 degrees


def k09_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the registry's regions, of which those with customers have been built."""
    registry = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.lit("planned").alias("status"), F.when(F.col("n_nationkey") % 2 == 0, "roads").alias("mode"), F.lit(0).cast("long").alias("edges"), F.lit(0).cast("long").alias("nodes"))
    c = _table(spark, sf_dir, "customer").where("c_nationkey % 3 = 0").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("code"))
    builds = edges(spark, sf_dir).join(c, "a").groupBy("code").agg(F.lit("built").alias("status"), F.lit("full").alias("mode"), F.count("*").alias("edges"), F.count_distinct("a").alias("nodes"))
    return reports.updated_registry(registry, builds)


def u05_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that each nation's customers are in, distinct and sorted; those of its neighbours that aren't among them (U6)."""
    k = F.col("c_custkey")
    lon, lat = F.lit(-141.0) + (k * 37 % 900) / 10.0, F.lit(41.0) + (k * 53 % 420) / 10.0
    named = _table(spark, sf_dir, "customer").select("c_nationkey", rules.primary_region(lon, lat).alias("region")).where("region IS NOT NULL")
    near = spark.createDataFrame([(a, list(b)) for a, b in rules.REGION_NEIGHBOURS.items()], "region string, near array<string>")
    each = named.distinct().join(near, "region").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("region")).alias("regions"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return each.select("c_nationkey", F.array_join("regions", ",").alias("regions"), F.array_join(F.array_sort(F.array_except("near", "regions")), ",").alias("beyond"))


def u07_backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the main sources or of none, then the others (U2: main roads first)."""
    source = _dealt(F.col("seq"), ["NRN", "NSTDB", "OpenStreetMap roads", None, "NB Forest Roads", ""])
    main = F.coalesce(source, F.lit("")).rlike(r"(?i)^$|OpenStreetMap|^NRN\b|National Road")
    return edges(spark, sf_dir).select("edge_id", source.alias("source"), F.when(main, 0).otherwise(1).alias("phase"))


QUERIES = {
    "A02_report": a02_report, "A18_trails": a18_trails, "A19_display": a19_display, "A20_verdicts": a20_verdicts, "S21_ways": s21_ways, "S22_trails": s22_trails, "S08_described": s08_described, "L03_caps": l03_caps,
    "L01_chunks": l01_chunks, "K09_registry": k09_registry, "U05_regions": u05_regions, "U07_backbone": u07_backbone,
}

_T = lambda c: _dealt_sql("p_partkey", TRAIL[c])
_PARTS = f"WITH p AS (SELECT p_partkey, lower({_T('highway')}) AS highway, lower({_T('tracktype')}) AS grade, {_T('tracktype')} AS tracktype, {_T('surface')} AS surface, {_T('motorcycle')} AS motorcycle, {_T('atv')} AS atv, {_T('access')} AS access FROM part)"
_GRADE = "CASE WHEN highway IN ('path', 'bridleway') THEN 'single' WHEN highway = 'track' THEN CASE tracktype WHEN 'grade1' THEN 'g2' WHEN 'grade2' THEN 'g2' WHEN 'grade3' THEN 'g3' WHEN 'grade4' THEN 'g4' WHEN 'grade5' THEN 'g5' ELSE 'unknown' END ELSE 'unknown' END"
_KIND = "CASE WHEN highway = 'path' AND lower(motorcycle) IN ('yes', 'designated', 'permissive', 'destination') THEN 'single' WHEN lower(atv) IN ('yes', 'designated', 'permissive', 'destination') OR grade IN ('grade4', 'grade5') THEN 'atv' WHEN highway IN ('path', 'bridleway') THEN 'single' WHEN lower(surface) = 'asphalt' OR grade = 'grade1' THEN 'paved' ELSE 'gravel' END"
_OPEN = "lower(motorcycle) IN ('yes', 'designated') OR lower(atv) IN ('yes', 'designated')"
_SHUT = "lower(motorcycle) IN ('no', 'private') OR lower(atv) IN ('no', 'private') OR access = 'private'"
_I = lambda c: _dealt_sql("p_partkey", INVENTORY[c])
_BOX = "list(region ORDER BY region)"


def _regions_sql() -> str:
    from trailframe.plans.rules_queries import ORACLE_SQL as known

    near = ", ".join(f"('{a}', {list(b)!r})" for a, b in rules.REGION_NEIGHBOURS.items())
    return f"WITH x AS ({known['P31_regions']}), d AS (SELECT DISTINCT c_nationkey, region FROM x JOIN customer USING (c_custkey) WHERE region IS NOT NULL), v(region, near) AS (VALUES {near}), a AS (SELECT c_nationkey, list(region) AS regions, flatten(list(near)) AS near FROM d JOIN v USING (region) GROUP BY 1) SELECT c_nationkey, array_to_string(list_sort(regions), ',') AS regions, coalesce(array_to_string(list_sort(list_distinct(list_filter(near, lambda n: NOT list_contains(regions, n)))), ','), '') AS beyond FROM a"


ORACLE_SQL = {
    "A02_report": _NET + f", c AS (SELECT {_dealt_sql('seq', REASONS)} AS reason, {_dealt_sql('seq', SURFACES)} AS surface, {_dealt_sql('seq', ACCESSES)} AS access, m FROM e), t AS (SELECT count(*) AS scanned, count(*) FILTER (reason IS NULL) AS accepted, count(reason) AS excluded, CAST(sum(m) FILTER (reason IS NULL) AS BIGINT) AS meters FROM c) SELECT scanned, accepted, excluded, meters, x.of, x.name, x.n FROM t, (SELECT 'reason' AS of, reason AS name, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY 2 UNION ALL SELECT 'surface', coalesce(surface, 'null'), count(*) FROM c WHERE reason IS NULL GROUP BY 2 UNION ALL SELECT 'access', coalesce(access, 'null'), count(*) FROM c WHERE reason IS NULL GROUP BY 2) x",
    "A18_trails": _PARTS + f", k AS (SELECT {_KIND} AS kind, CASE WHEN {_OPEN} THEN 'allowed' WHEN {_SHUT} THEN 'restricted' ELSE 'unknown' END AS status FROM p WHERE highway IN ('track', 'path', 'bridleway')) SELECT 'kind' AS of, kind AS name, count(*) AS n FROM k WHERE kind <> 'paved' GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM k WHERE kind <> 'paved' GROUP BY 2",
    "A19_display": f"WITH p AS (SELECT {_I('ROADCLASS')} AS c, {_I('PAVSTATUS')} || ' ' || {_I('UNPAVSURF')} AS u, {_I('PAVSTATUS')} || ' ' || {_I('PAVSURF')} AS v FROM part), g AS (SELECT *, regexp_matches(u, '(?i)unpaved|gravel|earth|dirt') AS gravel, regexp_matches(v, '(?i)paved|asphalt|concrete') AS paved FROM p), k AS (SELECT CASE WHEN gravel OR paved THEN 'pavement-field' ELSE 'roadclass-inferred' END AS confidence, coalesce(nullif(c, ''), 'Unknown') AS road_class FROM g WHERE gravel OR NOT paved AND regexp_matches(c, '(?i)resource|recreation')) SELECT 'track_class' AS of, 'gravel' AS name, count(*) AS n FROM k UNION ALL SELECT 'confidence', confidence, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'road_class', road_class, count(*) FROM k GROUP BY 2",
    "A20_verdicts": _PARTS + f", k AS (SELECT p_partkey // 37 % 9 AS area, {_GRADE} AS g, highway = 'track' AND tracktype <> '' AS told, highway = 'track' AND tracktype = '' AS not_told FROM p), a AS (SELECT area, count(*) AS total, count(*) FILTER (told) AS graded, count(*) FILTER (not_told) AS ungraded, count(*) FILTER (g LIKE 'g_') AS grades FROM k GROUP BY 1) SELECT area, total, graded, ungraded, CASE WHEN total >= 40 AND grades > 0 AND 4 * graded >= greatest(1, graded + ungraded) THEN 'Rich + graded' ELSE 'Present, mostly ungraded' END AS verdict FROM a",
    "S21_ways": _PARTS + " SELECT p_partkey FROM p WHERE highway IN ('track', 'bridleway') OR highway = 'path' AND (surface = 'dirt' OR p_partkey % 5 = 0)",
    "S22_trails": f"WITH p AS (SELECT p_partkey, {_dealt_sql('p_partkey', CODES)} AS c, {_dealt_sql('p_partkey', KINDS)} AS k, {_dealt_sql('p_partkey', TOPS)} AS t FROM part) SELECT p_partkey FROM p WHERE c IN ('RTRAIL', 'TRACK7', 'RESOURCE') OR k IN ('Trail', 'Resource Road') OR t IN ('Gravel', 'Dirt')",
    "S08_described": f"WITH p AS (SELECT p_partkey, {_dealt_sql('p_partkey', DESCRIPTIONS)} AS d FROM part WHERE (p_partkey * 37 % 400) BETWEEN 100 AND 300 AND (p_partkey * 53 % 300) BETWEEN 50 AND 250) SELECT p_partkey FROM p WHERE d LIKE '%Unpaved%' OR d LIKE '%Paved%' OR d IN ('TRACK', 'TRACK - Indefinite/Approximate') OR d LIKE 'BRIDGE%' OR d LIKE 'TUNNEL%' OR d LIKE 'ROAD - Abandoned%' OR d LIKE 'TRAIL%'",
    "L03_caps": _NET + " SELECT edge_id, rt FROM e QUALIFY row_number() OVER (PARTITION BY rt ORDER BY seq) <= 20",
    "L01_chunks": _NET + ", c AS (SELECT CAST(floor(lon_e5 / 40000) AS BIGINT) || '_' || CAST(floor(lat_e5 / 40000) AS BIGINT) AS id, count(*) AS edges FROM e JOIN n ON node_id = a GROUP BY 1) SELECT id, edges, CAST(row_number() OVER (ORDER BY edges DESC, id) AS INT) AS place FROM c",
    "K09_registry": _NET + ", b AS (SELECT c_nationkey AS code, count(*) AS edges, count(DISTINCT a) AS nodes FROM e JOIN customer ON c_custkey = a WHERE c_nationkey % 3 = 0 GROUP BY 1) SELECT n_nationkey AS code, CASE WHEN b.code IS NULL THEN 'planned' ELSE 'built' END AS status, CASE WHEN b.code IS NOT NULL THEN 'full' WHEN n_nationkey % 2 = 0 THEN 'roads' END AS mode, coalesce(edges, 0) AS edges, coalesce(nodes, 0) AS nodes FROM nation LEFT JOIN b ON b.code = n_nationkey",
    "U05_regions": _regions_sql(),
    "U07_backbone": _NET + ", s AS (SELECT edge_id, ['NRN', 'NSTDB', 'OpenStreetMap roads', NULL, 'NB Forest Roads', ''][seq % 6 + 1] AS source FROM e) SELECT edge_id, source, CASE WHEN coalesce(source, '') IN ('', 'NRN', 'OpenStreetMap roads') THEN 0 ELSE 1 END AS phase FROM s",
}
