"""Queries of profile costs, labels, points of interest and their packs, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import classify, labels, profiles
from trailframe.functions import network_rules as rules
from trailframe.functions.geometry import angle_between, bearing, haversine, project_on_segment
from trailframe.operators import packs
from trailframe.sources.network import EDGES_SQL, NODES_SQL, edges, nodes

_NET = f"WITH n AS ({NODES_SQL}), e AS ({EDGES_SQL})"
_PROFILES = ("direct", "balanced", "dirt", "cleanest", "other")
#: The ends of the request that costs are for, and by how much the network is moved to lie in a town (degrees).
START, END, MOVED = (-63.6, 44.35), (-63.4, 44.75), (2.4, 0.35)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(key: Column, values: list) -> Column:
    """One of some values by a key's remainder."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values)).cast("int"))


def _dealt_sql(key: str, values: list) -> str:
    listed = ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"CAST(([{listed}])[{key} % {len(values)} + 1] AS VARCHAR)"


SOURCES = ["NSTDB roads", "OpenStreetMap", "NRN", "NB Forest Roads", None]


def _moved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    end = lambda e: n.select(F.col("node_id").alias(e), (F.col("lon_e5") / 1e5 + MOVED[0]).alias(f"x{e}"), (F.col("lat_e5") / 1e5 + MOVED[1]).alias(f"y{e}"))
    return edges(spark, sf_dir).join(end("a"), "a").join(end("b"), "b")


def rcost_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each edge costs from a to b, by profile, with and without unknown access."""
    lit = lambda p: (F.lit(p[0]), F.lit(p[1]))
    lines = _moved_lines(spark, sf_dir)
    tag = F.when(F.col("seq") % 10 == 3, F.concat(F.lit("ns-"), "edge_id")).otherwise(F.col("edge_id"))
    rows = lines.select(
        "edge_id", "seq", "m", "rt", classify.code_name(F.col("s"), classify.SURFACES).alias("surface"), classify.code_name(F.col("ac"), classify.ACCESSES).alias("access"), profiles.is_provincial(tag, _dealt(F.col("seq"), SOURCES)).alias("provincial"),
        *(c.alias(k) for k, c in profiles.places((F.col("xa"), F.col("ya")), (F.col("xb"), F.col("yb")), lit(START), lit(END)).items()))
    asked = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(u).alias("unknown")) for p in _PROFILES for u in (False, True)))).alias("q")
    cost = profiles.step_cost(F.col("m"), F.col("surface"), F.col("rt"), F.col("access"), F.col("provincial"), F.col("q.profile"), F.col("q.unknown"), F.col("seq") % 13 == 0, F.col("seq") % 26 == 0)
    return rows.select("*", asked).select("edge_id", "q.profile", "q.unknown", F.round(cost + 3e-8, 6).alias("cost"))  # off the ties of short decimals


def _case(column: str, values: dict, otherwise) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {otherwise} END"


def _hav(x1, y1, x2, y2) -> str:
    h = f"(pow(sin(radians({y2} - ({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - ({x1})) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def _towns_sql(x: str, y: str) -> str:
    return "(" + " OR ".join(f"{y} BETWEEN {s}::DOUBLE AND {n}::DOUBLE AND {x} BETWEEN {w}::DOUBLE AND {e}::DOUBLE" for s, n, w, e, _ in profiles.TOWNS) + ")"


def _costs_sql() -> str:
    listed = lambda t: [f"WHEN p = '{p}' THEN {_case('sn', w, 1.0)}" for p, w in t.items()]
    surface = "CASE " + " ".join(listed(profiles.SURFACE_WEIGHTS)) + f" ELSE {_case('sn', profiles.SURFACE_WEIGHTS['balanced'], 1.0)} END"
    road = "CASE " + " ".join(f"WHEN p = '{p}' THEN {_case('rt', dict(zip(profiles.CLASSES, w)), 1.0)}" for p, w in profiles.CLASS_WEIGHTS.items()) + " ELSE 1.0 END"
    asked = ", ".join(f"('{p}', {u})" for p in _PROFILES for u in (False, True))
    away = lambda k: _case("p", {p: v[k] for p, v in profiles.AWAY_PRICE.items()}, 0.0)
    return _NET + f""", l AS (SELECT e.*, ['paved', 'gravel', 'access', 'track', 'unknown'][s + 1] AS sn, {_dealt_sql('seq', SOURCES)} AS src, x.lon_e5 / 1e5 + {MOVED[0]}::DOUBLE AS xa, x.lat_e5 / 1e5 + {MOVED[1]}::DOUBLE AS ya, y.lon_e5 / 1e5 + {MOVED[0]}::DOUBLE AS xb, y.lat_e5 / 1e5 + {MOVED[1]}::DOUBLE AS yb
  FROM e JOIN n x ON x.node_id = a JOIN n y ON y.node_id = b), q(p, u) AS (VALUES {asked}),
d AS (SELECT *, {_hav('xa', 'ya', END[0], END[1])} AS before, {_hav('xb', 'yb', END[0], END[1])} AS after, {_hav(*START, *END)} AS direct, (xa + xb) / 2 AS mx, (ya + yb) / 2 AS my FROM l),
t AS (SELECT *, {_towns_sql('mx', 'my')} AND {_hav('mx', 'my', *START)} >= 2500 AND {_hav('mx', 'my', *END)} >= 2500 AS town, after - before AS away FROM d),
c AS (SELECT t.*, p, u, m / 1000.0::DOUBLE AS km, CASE WHEN town AND p <> 'cleanest' THEN {_case('p', profiles.TOWN_FACTOR, profiles.TOWN_FACTOR['direct'])} ELSE 1.0 END AS tf, u AND p <> 'cleanest' AS f FROM t, q)
SELECT edge_id, p AS profile, u AS unknown, round(CASE
  WHEN seq % 13 = 0 THEN (km * CASE WHEN seq % 26 = 0 THEN 12 ELSE 1 END + CASE WHEN p <> 'cleanest' AND away > 60 AND before < greatest(3500, direct * 0.3::DOUBLE) THEN away / 1000 * {_case('p', profiles.ACCESS_AWAY_PRICE, profiles.ACCESS_AWAY_PRICE['dirt'])} ELSE 0 END) * tf
  ELSE km * ({surface}) * ({road}) * CASE WHEN f AND ac = 2 THEN {_case('p', profiles.UNKNOWN_FACTOR, profiles.UNKNOWN_FACTOR['balanced'])} ELSE 1.0 END
    * CASE WHEN f AND (seq % 10 = 3 OR seq % 5 IN (0, 3)) THEN {_case('p', profiles.PROVINCIAL_FACTOR, profiles.PROVINCIAL_FACTOR['balanced'])} ELSE 1.0 END
    * CASE WHEN f AND p = 'balanced' AND s = 0 THEN 0.9::DOUBLE WHEN f AND p = 'balanced' AND s <= 3 THEN 1.06::DOUBLE ELSE 1.0 END * tf
    + CASE WHEN away > 50 THEN away / 1000 * CASE WHEN before < greatest(2800, direct * 0.28::DOUBLE) THEN {away(0)} ELSE {away(1)} END ELSE 0 END END + 3e-8, 6) AS cost FROM c"""


def p28_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of edges with the weights of two profiles and the speed; classes that aren't listed weigh 1, null ones as unknown."""
    surface = classify.code_name(F.col("s"), classify.SURFACES)
    kinds = edges(spark, sf_dir).groupBy("s", "rt").agg(F.count("*").alias("edges"))
    weights = [f(c, F.lit(p)).alias(f"{p}_{n}") for p in ("dirt", "none") for n, f, c in (("surface", profiles.surface_weight, surface), ("class", profiles.class_weight, F.col("rt")))]
    return kinds.select("s", "rt", "edges", *weights, profiles.by_name(surface, profiles.SPEED_KMH, 30).alias("kmh"))


def a21_greatest_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p, float(profiles.greatest_weight(p))) for p in _PROFILES], "profile string, weight double").withColumn("weight", F.round("weight", 6))


def p30_towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points around four towns: in a centre or not, and the latitude beyond."""
    key = F.col("c_custkey")
    lon, lat = F.lit(-64.4) + (key * 37 % 100) / 100.0, F.lit(45.7) + (key * 53 % 60) / 100.0
    points = _table(spark, sf_dir, "customer").select(key, F.when(key % 2 == 0, lon).otherwise(lon + 0.8).alias("lon"), F.when(key % 2 == 0, lat).otherwise(lat - 1.2).alias("lat"))
    return points.select("c_custkey", profiles.in_town(F.col("lon"), F.col("lat")).alias("in_town"), F.round(profiles.nudged_off_towns(F.col("lon"), F.col("lat")), 6).alias("lat"))


def _nudge_sql() -> str:
    out, previous = [], "p"
    for i, (s, n, w, e, step) in enumerate(profiles.TOWNS):
        out.append(f"t{i} AS (SELECT * REPLACE (CASE WHEN lat BETWEEN {s}::DOUBLE AND {n}::DOUBLE AND lon BETWEEN {w}::DOUBLE AND {e}::DOUBLE THEN {n}::DOUBLE + {step}::DOUBLE ELSE lat END AS lat) FROM {previous})")
        previous = f"t{i}"
    return ", ".join(out) + f" SELECT c_custkey, in_town, round(lat, 6) AS lat FROM {previous}"


NAMES, NUMBERS = ["qc-north", "QC", "qc", "ns", "Quebec", "qc_", None], ["1.5", " 7 ", "", "x", "NaN", "1e3", None, "-2"]
STATES, RIDERS = ["available", "Breakdown", "stuck", "", None, "elsewhere", "INJURED"], ["Ann", "  ", None, " Bo "]


def p32_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _dealt(F.col("p_partkey"), NAMES)
    return _table(spark, sf_dir, "part").select("p_partkey", rules.region_family(name).alias("family"))


def p34_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", labels.number_or_null(_dealt(F.col("p_partkey"), NUMBERS)).alias("number"))


def p35_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, name = _dealt(F.col("event_id"), STATES), _dealt(F.col("event_id"), RIDERS)
    return _table(spark, sf_dir, "events").select("event_id", labels.rider_label(name, status).alias("label"), labels.is_distress(status).alias("distress"), labels.publish_interval_ms(status).alias("every_ms"))


def p36_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    meters, seconds = (key * 7919 % 40_000).cast("double"), (key * 613 % 20_000 - 100).cast("double")
    return _table(spark, sf_dir, "customer").select(key, labels.km_label(meters).alias("distance"), labels.time_label(seconds).alias("time"))


def p37_same_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive edges of a start that go on where the one before ended, as far as coordinates tell."""
    lines = _moved_lines(spark, sf_dir)
    nudge = F.when(F.col("seq") % 2 == 0, 5e-8).when(F.col("seq") % 3 == 0, 5e-7).otherwise(0.0)
    return lines.select("edge_id", labels.same_point(F.col("xa"), F.col("ya"), F.col("xa") + nudge, F.col("ya")).alias("same"), labels.same_point(F.col("xa"), F.col("ya"), F.col("xb"), F.lit(None).cast("double")).alias("missing"))


def p38_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    curve = labels.curve_words(_dealt(key, ["left", "right"]), (key % 6 + 1).cast("int"))
    turn = labels.junction_words(_dealt(key, ["left", "right", "straight"]))
    return _table(spark, sf_dir, "part").select("p_partkey", curve.alias("c"), turn.alias("t")).select("p_partkey", "c.text", "c.spoken", "c.key", F.col("t.text").alias("turn"), "t.here", F.col("t.key").alias("turn_key"))


CITY, STREET = ["Yarmouth", "", None, " Digby "], ["Main St", "", None]
STAMPS = ["1700000000", " 2024-01-01 ", "", None]


def p16_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    where = labels.address(F.when(key % 5 > 0, (key % 90).cast("string")), _dealt(key, STREET), _dealt(key, CITY), F.when(key % 7 == 0, "NS"), F.when(key % 11 == 0, " B0S 1A0"))
    return _table(spark, sf_dir, "part").select("p_partkey", labels.cleaned(F.concat(F.lit(" "), F.when(key % 3 > 0, F.col("p_name")).otherwise(""))).alias("name"), where.alias("address"), labels.updated_at(_dealt(key, STAMPS)).alias("updated"))


def g15_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representative points of geometries of five kinds, three points a ring and one more in every third ring."""
    key = F.col("p_partkey")
    ring = lambda k: F.transform(F.sequence(F.lit(0), F.lit(2) + F.when((key + k) % 3 == 0, 1).otherwise(0)), lambda i: F.array((key % 50 + k + i).cast("double"), (key % 40 - k - i * i).cast("double")))
    kind = _dealt(key, ["Point", "LineString", "MultiLineString", "Polygon", "MultiPolygon"])
    rings = F.when(kind == "Point", F.array(F.slice(ring(0), 1, 1))).when(kind == "LineString", F.array(ring(0))).otherwise(F.array(ring(0), ring(1), ring(2)))
    return _table(spark, sf_dir, "part").select("p_partkey", labels.representative_point(kind, rings).alias("at")).select("p_partkey", "at.lon", "at.lat")


def g06_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place on each edge nearest to its start moved aside: share of the way, metres, bearing and turn."""
    lines = _moved_lines(spark, sf_dir)
    px, py = F.col("xa") + (F.col("seq") % 7 - 2) / 1000, F.col("ya") + (F.col("seq") % 5 - 1) / 1000
    t = project_on_segment(px, py, F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"))
    rows = lines.select("*", px.alias("px"), py.alias("py"), t.alias("t"))
    x, y = (F.col(f"{c}a") + (F.col(f"{c}b") - F.col(f"{c}a")) * F.col("t") for c in "xy")
    out = bearing(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"))
    return rows.select("edge_id", F.round("t", 6).alias("t"), F.round(haversine(F.col("px"), F.col("py"), x, y), 3).alias("meters"), F.round(out, 5).alias("bearing"), F.round(angle_between(out, F.lit(350.0)), 5).alias("turn"), F.round(haversine(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"), 6371.0), 6).alias("km"))


def poi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of interest from `part`: tags by size, places by key."""
    key, size = F.col("p_partkey"), F.col("p_size")
    tags = {"amenity": F.when(size % 5 == 0, "fuel"), "shop": F.when(size % 3 == 0, "alcohol").when(size % 3 == 1, "wine"), "tourism": F.when(size % 7 == 0, "motel").when(size % 7 == 1, "camp_site")}
    at = (F.lit(-66.0) + (key * 37 % 200) / 100.0, F.lit(44.0) + (key * 53 % 150) / 100.0)
    return _table(spark, sf_dir, "part").select(key.alias("id"), *(c.alias(n) for n, c in tags.items()), at[0].alias("lon"), at[1].alias("lat"))


def k06_poi_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.poi_chunks(packs.categorized(poi_rows(spark, sf_dir))).select("id", "n", *(F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")))


def a17_poi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.poi_counts(packs.categorized(poi_rows(spark, sf_dir)))


_POI = "p AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'fuel' WHEN p_size % 3 = 0 THEN 'liquor' WHEN p_size % 7 = 0 THEN 'lodging' WHEN p_size % 7 = 1 THEN 'campground' END AS category, round(-66.0::DOUBLE + (p_partkey * 37 % 200) / 100.0::DOUBLE, 6) AS lon, round(44.0::DOUBLE + (p_partkey * 53 % 150) / 100.0::DOUBLE, 6) AS lat FROM part)"

QUERIES = {
    "RCOST_steps": rcost_steps, "P28_weights": p28_weights, "A21_greatest_weights": a21_greatest_weights, "P30_towns": p30_towns, "P32_families": p32_families, "P34_numbers": p34_numbers, "P35_status": p35_status,
    "P36_labels": p36_labels, "P37_same_points": p37_same_points, "P38_words": p38_words, "P16_fields": p16_fields, "G15_points": g15_points, "G06_projections": g06_projections, "K06_poi_chunks": k06_poi_chunks, "A17_poi_counts": a17_poi_counts,
}

#: Kilometres with so many decimals: of the double's exact value, as a whole number of 2 ** -52, the nearest, the larger of two.
_FIXED = "((m // 1000 * {n} + ((CAST((m / 1000.0::DOUBLE - floor(m / 1000.0::DOUBLE)) * 4503599627370496 AS BIGINT) * {n} + 2251799813685248) >> 52)) // {n}) || '.' || lpad(CAST((m // 1000 * {n} + ((CAST((m / 1000.0::DOUBLE - floor(m / 1000.0::DOUBLE)) * 4503599627370496 AS BIGINT) * {n} + 2251799813685248) >> 52)) % {n} AS VARCHAR), {p}, '0') || ' km'"
_LINES = _NET + f", l AS (SELECT e.*, x.lon_e5 / 1e5 + {MOVED[0]}::DOUBLE AS xa, x.lat_e5 / 1e5 + {MOVED[1]}::DOUBLE AS ya, y.lon_e5 / 1e5 + {MOVED[0]}::DOUBLE AS xb, y.lat_e5 / 1e5 + {MOVED[1]}::DOUBLE AS yb FROM e JOIN n x ON x.node_id = a JOIN n y ON y.node_id = b)"
_STATUS_NAME = f"lower(coalesce(nullif({_dealt_sql('event_id', STATES)}, ''), 'available'))"
ORACLE_SQL = {
    "RCOST_steps": _costs_sql(),
    "P28_weights": _NET + f", k AS (SELECT s, rt, count(*) AS edges, ['paved', 'gravel', 'access', 'track', 'unknown'][s + 1] AS sn FROM e GROUP BY s, rt) SELECT s, rt, edges, {_case('sn', profiles.SURFACE_WEIGHTS['dirt'], 1.0)} AS dirt_surface, {_case('rt', dict(zip(profiles.CLASSES, profiles.CLASS_WEIGHTS['dirt'])), 1.0)} AS dirt_class, {_case('sn', profiles.SURFACE_WEIGHTS['balanced'], 1.0)} AS none_surface, 1.0::DOUBLE AS none_class, CAST([70, 45, 35, 25, 30][s + 1] AS INT) AS kmh FROM k",
    "A21_greatest_weights": "SELECT * FROM (VALUES ('direct', 6.345::DOUBLE), ('balanced', 4.472), ('dirt', 47.6), ('cleanest', 15.12), ('other', 1.72)) t(profile, weight)",
    "P30_towns": f"WITH r AS (SELECT c_custkey, -64.4::DOUBLE + (c_custkey * 37 % 100) / 100.0::DOUBLE AS x, 45.7::DOUBLE + (c_custkey * 53 % 60) / 100.0::DOUBLE AS y FROM customer), o AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN x ELSE x + 0.8::DOUBLE END AS lon, CASE WHEN c_custkey % 2 = 0 THEN y ELSE y - 1.2::DOUBLE END AS lat FROM r), p AS (SELECT *, {_towns_sql('lon', 'lat')} AS in_town FROM o), " + _nudge_sql(),
    "P32_families": f"WITH p AS (SELECT p_partkey, lower({_dealt_sql('p_partkey', NAMES)}) AS r FROM part) SELECT p_partkey, CASE WHEN r = 'qc' OR starts_with(r, 'qc-') THEN 'qc' ELSE r END AS family FROM p",
    "P34_numbers": f"WITH p AS (SELECT p_partkey, TRY_CAST(trim({_dealt_sql('p_partkey', NUMBERS)}) AS DOUBLE) AS x FROM part) SELECT p_partkey, CASE WHEN isfinite(x) THEN x END AS number FROM p",
    "P35_status": f"WITH p AS (SELECT event_id, {_STATUS_NAME} AS s, coalesce(nullif(trim({_dealt_sql('event_id', RIDERS)}), ''), 'Rider') AS name FROM events) SELECT event_id, name || ' - ' || CASE s WHEN 'breakdown' THEN 'Breakdown' WHEN 'stuck' THEN 'Stuck' WHEN 'injured' THEN 'Injured' ELSE 'Available' END AS label, s IN ('breakdown', 'stuck', 'injured') AS distress, CAST(CASE WHEN s IN ('breakdown', 'stuck', 'injured') THEN 5000 ELSE 15000 END AS INT) AS every_ms FROM p",
    "P36_labels": f"WITH p AS (SELECT c_custkey, c_custkey * 7919 % 40000 AS m, c_custkey * 613 % 20000 - 100 AS s, CAST(floor((c_custkey * 613 % 20000 - 100) / 60.0 + 0.5) AS BIGINT) AS t FROM customer) SELECT c_custkey, CASE WHEN m < 1000 THEN m || ' m' WHEN m >= 10000 THEN {_FIXED.format(n=10, p=1)} ELSE {_FIXED.format(n=100, p=2)} END AS distance, CASE WHEN s <= 0 THEN '—' WHEN t < 60 THEN t || ' min' ELSE (t // 60) || ' h' || CASE WHEN t % 60 > 0 THEN ' ' || (t % 60) || ' min' ELSE '' END END AS time FROM p",
    "P37_same_points": _LINES + " SELECT edge_id, NOT (seq % 2 <> 0 AND seq % 3 = 0) AS same, false AS missing FROM l",
    "P38_words": "WITH p AS (SELECT p_partkey, CAST(p_partkey % 6 + 1 AS INT) AS n, CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS s, ['left', 'right', 'straight'][p_partkey % 3 + 1] AS j FROM part), w AS (SELECT *, upper(s[1]) || s[2:] AS big, upper(j[1]) || j[2:] AS turn FROM p) SELECT p_partkey, big || ' ' || n || CASE n WHEN 1 THEN ' hairpin' ELSE '' END AS text, s || ' ' || n || CASE n WHEN 1 THEN ' hairpin' ELSE '' END AS spoken, n || '-' || s || CASE n WHEN 1 THEN '-hairpin' ELSE '' END AS key, CASE WHEN j = 'straight' THEN 'Straight' ELSE turn || ' turn' END AS turn, CASE WHEN j <> 'straight' THEN turn || ' turn here' END AS here, CASE WHEN j = 'straight' THEN 'straight' ELSE 'jct-' || j END AS turn_key FROM w",
    "P16_fields": f"WITH p AS (SELECT *, nullif(trim(concat_ws(' ', CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 90 AS VARCHAR) END, nullif({_dealt_sql('p_partkey', STREET)}, ''))), '') AS l, {_dealt_sql('p_partkey', STAMPS)} AS t FROM part) SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN nullif(trim(p_name), '') END AS name, nullif(concat_ws(', ', l, nullif(trim({_dealt_sql('p_partkey', CITY)}), ''), CASE WHEN p_partkey % 7 = 0 THEN 'NS' END, CASE WHEN p_partkey % 11 = 0 THEN 'B0S 1A0' END), '') AS address, CASE WHEN t = '1700000000' THEN '2023-11-14T22:13:20.000Z' ELSE nullif(trim(t), '') END AS updated FROM p",
    "G15_points": "WITH k AS (SELECT p_partkey AS p, p_partkey % 5 AS kind, unnest([0, 1, 2]) AS k FROM part), r AS (SELECT *, CASE WHEN (p + k) % 3 = 0 THEN 4 ELSE 3 END AS size FROM k WHERE kind IN (2, 4) OR k = 0), c AS (SELECT * FROM r QUALIFY kind <> 4 OR row_number() OVER (PARTITION BY p ORDER BY size DESC, k) = 1), i AS (SELECT p, k, unnest(range(CASE WHEN kind = 0 THEN 1 ELSE size END)) AS i FROM c) SELECT p AS p_partkey, floor(sum((p % 50 + k + i)::DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS lon, floor(sum((p % 40 - k - i * i)::DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS lat FROM i GROUP BY p",
    "G06_projections": _LINES + f", o AS (SELECT *, xa + (seq % 7 - 2) / 1000.0::DOUBLE AS px, ya + (seq % 5 - 1) / 1000.0::DOUBLE AS py FROM l), t AS (SELECT *, greatest(0, least(1, ((px - xa) * (xb - xa) + (py - ya) * (yb - ya)) / (pow(xb - xa, 2) + pow(yb - ya, 2)))) AS t FROM o), b AS (SELECT *, (degrees(atan2(sin(radians(xb - xa)) * cos(radians(yb)), cos(radians(ya)) * sin(radians(yb)) - sin(radians(ya)) * cos(radians(yb)) * cos(radians(xb - xa)))) + 360) % 360 AS d FROM t) SELECT edge_id, round(t, 6) AS t, round({_hav('px', 'py', '(xa + (xb - xa) * t)', '(ya + (yb - ya) * t)')}, 3) AS meters, round(d, 5) AS bearing, round(CASE WHEN 350 - d > 180 THEN -10 - d ELSE 350 - d END, 5) AS turn, round({_hav('xa', 'ya', 'xb', 'yb')} / 1000, 6) AS km FROM b",
    "K06_poi_chunks": f"WITH {_POI} SELECT CAST(floor(lon / 0.5) AS BIGINT) || '_' || CAST(floor(lat / 0.5) AS BIGINT) AS id, count(*) AS n, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM p WHERE category IS NOT NULL GROUP BY 1",
    "A17_poi_counts": f"WITH {_POI} SELECT coalesce(category, 'skipped') AS category, count(*) AS n, count(DISTINCT floor(lon / 0.5) || '_' || floor(lat / 0.5)) FILTER (category IS NOT NULL) AS chunks FROM p GROUP BY 1",
}
