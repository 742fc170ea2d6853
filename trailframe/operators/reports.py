"""Reports of sources and packs: totals and exclusions, overlays and displays, verdicts on an area, the registry of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ways, and their share with a grade, from which an area counts as rich; grades; surfaces and classes of trail filters.
RICH_WAYS, RICH_SHARE, GRADED = 40, 0.25, ("g2", "g3", "g4", "g5")
DIRT_SURFACE = "dirt|ground|earth|gravel|unpaved|fine_gravel|compacted|sand|grass"
TRAIL_CODES, TRAIL_CLASSES, TRAIL_SURFACES = "TRAIL|TRACK|RESOURCE", ("Resource Road", "Trail"), ("Unpaved", "Gravel", "Dirt")
DESCRIBED = ("%Unpaved%", "%Paved%", "TRACK", "TRACK - Indefinite/Approximate", "BRIDGE%", "TUNNEL%", "ROAD - Abandoned%", "TRAIL%")


def adapter_report(classified: DataFrame) -> DataFrame:
    """One row of classified rows (reason, surface, access, meters): counts, and maps of exclusions and classes (null: "null")."""
    kept = F.col("reason").isNull()
    each = classified.select(kept.alias("kept"), "meters", F.explode(F.array(*(F.struct(F.lit(n).alias("of"), F.coalesce(F.when(c == kept, F.col(n)), F.when(c == kept, F.lit("null"))).alias("name")) for n, c in (("reason", F.lit(False)), ("surface", F.lit(True)), ("access", F.lit(True)))))).alias("x"))
    counts = each.where("x.name IS NOT NULL").groupBy("x.of", "x.name").agg(F.count("*").alias("n"))
    as_map = lambda n: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("of") == n, F.struct("name", "n"))))).alias(n)
    maps = counts.groupBy().agg(as_map("reason"), as_map("surface"), as_map("access"))
    totals = classified.groupBy().agg(F.count("*").alias("scanned"), F.count_if(kept).alias("accepted"), F.count_if(~kept).alias("excluded"), F.floor(F.coalesce(F.sum(F.when(kept, F.col("meters"))), F.lit(0.0)) + 0.5).cast("long").alias("meters"))
    return totals.select("*", *(maps.select(n).scalar().alias(n) for n in ("reason", "surface", "access")))


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """(of, name, n): counts by each of some columns in one pass; nulls are "Unknown"."""
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("Unknown")).alias("name")) for c in columns))).alias("x"))
    return each.groupBy("x.of", "x.name").agg(F.count("*").alias("n"))


def area_verdict(ways: DataFrame, area: str = "area") -> DataFrame:
    """(area, total, graded, ungraded, verdict) of ways (grade, highway, tracktype): rich with forty ways of which some have a grade
    and a quarter of the tracks too."""
    track, told = F.col("highway") == "track", F.coalesce(F.col("tracktype") != "", F.lit(False))
    rows = ways.groupBy(area).agg(F.count("*").alias("total"), F.count_if(track & told).alias("graded"), F.count_if(track & ~told).alias("ungraded"), F.count_if(F.col("grade").isin(*GRADED)).alias("grades"))
    share = F.col("graded") / F.greatest(F.lit(1), F.col("graded") + F.col("ungraded"))
    rich = (F.col("total") >= RICH_WAYS) & (F.col("grades") > 0) & (share >= RICH_SHARE)
    return rows.select(area, "total", "graded", "ungraded", F.when(rich, "Rich + graded").otherwise("Present, mostly ungraded").alias("verdict"))


def rideable_way(highway: Column, surface: Column, motorcycle: Column) -> Column:
    """Ways that an area's query asks for: tracks, bridleways, and paths of dirt or with a word on motorcycles."""
    path = (highway == "path") & (F.coalesce(surface.rlike(DIRT_SURFACE), F.lit(False)) | motorcycle.isNotNull())
    return F.coalesce(highway.isin("track", "bridleway") | path, F.lit(False))


def trail_like(code: Column, road_class: Column, surface: Column) -> Column:
    """Rows of the topographic roads that are trails, resource roads or unpaved."""
    false = F.lit(False)
    return F.coalesce(code.rlike(TRAIL_CODES), false) | F.coalesce(road_class.isin(*TRAIL_CLASSES), false) | F.coalesce(surface.isin(*TRAIL_SURFACES), false)


def wanted_description(text: Column) -> Column:
    """Descriptions that a source is asked for; one of the patterns, which files' readers get as pushed filters."""
    tests = [text.like(p) for p in DESCRIBED]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def first_of_each(rows: DataFrame, key: str, order: Column, most: int) -> DataFrame:
    """At most `most` rows of each key, a cap that a build is given: those first in the order, found by a partial top-k in each task."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def updated_registry(registry: DataFrame, builds: DataFrame) -> DataFrame:
    """The registry (code, status, mode, edges, nodes) with what regions' builds say; the others stay as they are."""
    new = builds.select("code", *(F.col(c).alias(f"new_{c}") for c in ("status", "mode", "edges", "nodes")))
    rows = registry.join(new, "code", "left")
    return rows.select("code", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("status", "mode", "edges", "nodes")))
