"""Places that a long way is led over: seams between provinces, highway towns, and samples of the straight way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import network_rules as rules
from trailframe.functions.geometry import haversine
from trailframe.functions.profiles import moved_off_towns, nudged_off_towns
from trailframe.operators.components import checkpointed
from trailframe.operators.requests import region_paths

# Seams (lon, lat, the two regions they join).
SEAMS = (
    (-64.35, 45.92, "ns", "nb"), (-63.75, 46.21, "nb", "pe"), (-68.65, 47.55, "nb", "qc"), (-74.58, 45.61, "qc", "on"), (-94.49, 49.78, "on", "mb"),
    (-101.4, 49.7, "mb", "sk"), (-110.0, 49.7, "sk", "ab"), (-110.0, 51.4, "sk", "ab"), (-116.4, 51.2, "ab", "bc"),
)
# Towns on highways that a clean way goes over (lon, lat).
ANCHORS = (
    (-64.8, 46.099), (-63.75, 46.21), (-63.126, 46.238), (-66.643, 45.963), (-68.325, 47.373), (-68.65, 47.55), (-69.542, 47.837), (-71.208, 46.813),
    (-72.349, 46.353), (-72.701, 46.3), (-73.8, 45.6), (-75.697, 45.421), (-79.383, 43.653), (-81.0, 46.49), (-84.35, 46.52), (-89.247, 48.38),
    (-97.138, 49.895), (-104.618, 50.445), (-106.67, 52.133), (-113.491, 53.547), (-114.071, 51.045), (-119.496, 49.888), (-123.121, 49.283),
)
# Places that keep roads together where a corridor is cut out (lon, lat).
KEEPERS = (
    (-64.35, 45.92), (-63.75, 46.21), (-68.2, 47.35), (-70.9, 46.75), (-72.5, 46.2), (-73.9, 45.65), (-74.58, 45.61), (-74.73, 45.02), (-94.49, 49.78),
    (-101.4, 49.7), (-110.0, 49.7), (-110.0, 51.4), (-116.4, 51.2),
)
# Degrees between places that count as one, of an end, of a table's place and an end, of neighbours on the way; degrees by
# which tables reach beyond the ends; kilometres between samples and share of them from which there are any; ways too short for places.
SAME_END, SAME, SAME_NEXT = 0.02, 0.08, 0.15
SEAM_REACH, KEEPER_REACH, ANCHOR_REACH = 0.35, 0.4, 0.5
SAMPLE_KM, SAMPLE_FROM, SHORT_DEGREES, SHORT_KM = 320.0, 1.15, 3.0, 200.0
CLEAN = ("cleanest", "clean")
#: Parameter: tasks that requests are dealt to, for each core.
TASKS_A_CORE = 4
_POINT = "struct<lon: double, lat: double>"


def _literal(rows: tuple, *names: str) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names))) for row in rows))


def near(a: Column, b: Column, degrees: float) -> Column:
    return (F.abs(a["lon"] - b["lon"]) < degrees) & (F.abs(a["lat"] - b["lat"]) < degrees)


def ordered(points: Column, start: Column, end: Column) -> Column:
    """Points in the order of the way from west to east or back, without those that are near the one kept before; with both ends.

    Equal longitudes keep the order they are given in."""
    sign = F.when(start["lon"] < end["lon"], 1.0).otherwise(-1.0)
    keyed = F.array_sort(F.transform(points, lambda p, i: F.struct((p["lon"] * sign).alias("key"), i.alias("i"), p["lon"].alias("lon"), p["lat"].alias("lat"))))
    line = F.transform(keyed, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    none = F.array().cast(f"array<{_POINT}>")
    kept = F.aggregate(line, none, lambda acc, p: F.when(F.coalesce(near(F.try_element_at(acc, F.lit(-1)), p, SAME_NEXT), F.lit(False)), acc).otherwise(F.concat(acc, F.array(p))))
    return F.aggregate(F.array(), kept, lambda acc, _: acc, lambda k: F.concat(
        F.when(near(k[0], start, SAME_END), none).otherwise(F.array(start)), k, F.when(near(F.element_at(k, -1), end, SAME_END), none).otherwise(F.array(end))))


def _between(p: Column, start: Column, end: Column, reach: float) -> Column:
    return (p["lon"] >= F.least(start["lon"], end["lon"]) - reach) & (p["lon"] <= F.greatest(start["lon"], end["lon"]) + reach)


def _off_towns(p: Column) -> Column:
    return F.struct(p["lon"].alias("lon"), nudged_off_towns(p["lon"], p["lat"]).alias("lat"))


def samples(start: Column, end: Column, km: Column) -> Column:
    """Points on the straight way about every 320 kilometres, moved off town centres; none on ways of less than 368."""
    n = F.greatest(F.lit(1), F.floor(km / SAMPLE_KM + 0.5).cast("int"))
    at = lambda i, c: start[c] + (end[c] - start[c]) * (i / n)
    straight = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: (i > 0) & (i < n)), lambda i: F.struct(at(i, "lon").alias("lon"), at(i, "lat").alias("lat")))
    every = F.transform(straight, _off_towns)  # of points that are there: every box of a town reads them
    return F.when(km >= SAMPLE_KM * SAMPLE_FROM, every).otherwise(F.array().cast(f"array<{_POINT}>"))


def way_points(requests: DataFrame, mode: str | None = None) -> DataFrame:
    """Requests (query, profile, places: points (lon, lat)) with `points`, the places their way is led over.

    Places that aren't numbers go. Three places or more stay as they are, as do ways inside Quebec and short ones. A clean
    profile goes over the highway towns between its ends. Others go over the seams of the provinces on their way (mode
    "chain"), over samples of the straight way and the places that keep roads together (mode "clip"), or straight."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    places = F.filter(F.coalesce("places", F.array().cast(f"array<{_POINT}>")), lambda p: F.coalesce(fine(p["lon"]) & fine(p["lat"]), F.lit(False)))
    # Requests are short and their points much work, so they are dealt to all cores first, however few files they come in.
    requests = requests.repartition(TASKS_A_CORE * requests.sparkSession.sparkContext.defaultParallelism)
    rows = requests.withColumn("places", F.transform(places, lambda p: F.struct(p["lon"].cast("double").alias("lon"), p["lat"].cast("double").alias("lat"))))
    start, end = F.get("places", F.lit(0)), F.try_element_at("places", F.lit(-1))
    family = lambda p: rules.region_family(rules.primary_region(p["lon"], p["lat"]))
    rows = rows.withColumns({"_start": start, "_end": end}).withColumns({"_from": family(F.col("_start")), "_to": family(F.col("_end"))})
    rows = rows.withColumn("_km", haversine(F.col("_start.lon"), F.col("_start.lat"), F.col("_end.lon"), F.col("_end.lat"), 6371.0))
    rows = checkpointed(rows)  # they are read twice, and each in many places of the expressions below
    start, end, km = F.col("_start"), F.col("_end"), F.col("_km")
    quebec = (F.coalesce("_from", "_to") == "qc") & (F.coalesce("_to", "_from") == "qc")
    as_given = (F.size("places") != 2) | F.coalesce(quebec, F.lit(False)) | ((F.abs(start["lon"] - end["lon"]) < SHORT_DEGREES) & (km < SHORT_KM))
    straight, apart = F.array(start, end), lambda p: ~near(p, start, SAME) & ~near(p, end, SAME)
    inner = lambda a: (a["lon"] > F.least(start["lon"], end["lon"])) & (a["lon"] < F.greatest(start["lon"], end["lon"]))
    sign = F.when(start["lon"] < end["lon"], 1.0).otherwise(-1.0)
    towns = F.filter(_literal(ANCHORS, "lon", "lat"), lambda a: _between(a, start, end, ANCHOR_REACH) & apart(a) & inner(a))
    sorted_towns = F.transform(F.array_sort(F.transform(towns, lambda a, i: F.struct((a["lon"] * sign).alias("key"), i.alias("i"), a.alias("a")))), lambda x: x["a"])
    clean = F.concat(F.array(start), sorted_towns, F.array(end))
    if mode == "chain":
        pairs = rows.where("_from IS NOT NULL AND _to IS NOT NULL AND _from <> _to").select(F.col("_from").alias("start"), F.col("_to").alias("goal")).distinct()
        paths = region_paths(pairs).select(F.col("start").alias("_from"), F.col("goal").alias("_to"), F.col("path").alias("_path"))
        rows = rows.join(F.broadcast(paths), ["_from", "_to"], "left")  # at most a row for each two regions
        on_way = lambda s: F.array_contains("_path", s["a"]) & F.array_contains("_path", s["b"])
        seams = F.filter(_literal(SEAMS, "lon", "lat", "a", "b"), lambda s: on_way(s) & _between(s, start, end, SEAM_REACH) & apart(s))
        led = F.when(F.size("_path") >= 2, ordered(F.concat(straight, F.transform(seams, lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat")))), start, end)).otherwise(straight)
    elif mode == "clip":
        moved = tuple((lon, moved_off_towns(lon, lat)) for lon, lat in KEEPERS)
        keepers = F.filter(_literal(moved, "lon", "lat"), lambda p: _between(p, start, end, KEEPER_REACH))
        led = ordered(F.concat(straight, samples(start, end, km), keepers), start, end)
    else:
        led = straight
    points = F.when(as_given, F.col("places")).when(F.coalesce(F.lower("profile").isin(*CLEAN), F.lit(False)), clean).otherwise(led)
    return rows.withColumn("points", points).select(*requests.columns, "points")
