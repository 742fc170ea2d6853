"""Builds of packs and graphs from source files: readers, rules, conflation, graphs, extracts and writers put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import capillary_rules, labels, source_rules
from trailframe.functions.classify import ACCESSES, SURFACES, code_name, edge_id
from trailframe.functions.geometry import line_length
from trailframe.functions.network_rules import is_spine
from trailframe.operators import conflation, packs, regional, reports
from trailframe.operators.graph import component_stats
from trailframe.sources import files

#: Versions that packs carry.
GRAPH_VERSION, POI_VERSION = "canada-regional-1", "poi-1"


def _props(name: str) -> Column:
    return F.try_element_at("properties", F.lit(name))


def _features(parts: DataFrame, rule: Column, prefix: str, key: Column, source: str) -> DataFrame:
    """Classified lines as features: an id that stays, ends in 1e-5 degrees, metres along the line."""
    points = F.transform("line", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    rows = parts.select("*", rule.alias("rule"), points.alias("points"), key.alias("id")).select("*", "rule.*", line_length(F.col("points")).alias("meters"))
    e5 = lambda k, c: F.floor(F.element_at("points", k)[c] * 1e5 + 0.5).cast("long")
    return rows.select(
        edge_id(prefix, F.col("id"), F.col("part").cast("string")).alias("edge_id"), F.xxhash64("file", "id", "part").alias("seq"), F.lit(None).cast("string").alias("role"), F.lit(source).alias("source"), "reason", "surface",
        F.col("access") if "access" in rows.columns else F.lit("motorized_permissive").alias("access"), "road_class", "meters", "points", e5(1, "lon").alias("x1"), e5(1, "lat").alias("y1"), e5(-1, "lon").alias("x2"), e5(-1, "lat").alias("y2"))


def inventory_features(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a national inventory's sequence, with the reason for which some are out."""
    read = files.read_sequence(spark, path)
    rule = source_rules.inventory_road(_props)
    return _features(files.line_parts(read.where("reason IS NULL").drop("reason")), rule, "nrn-", F.coalesce(_props("NID"), _props("ROADSEGID"), F.col("geometry")), "NRN")


def tagged_features(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a sequence of tagged ways, with the reason for which some are out."""
    read = files.read_sequence(spark, path)
    rule = source_rules.tagged_way(_props)
    return _features(files.line_parts(read.where("reason IS NULL").drop("reason")), rule, "osm-", F.coalesce(_props("@id"), F.col("geometry")), "OpenStreetMap roads")


def regional_graph(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the features that are in."""
    return regional.build(features.where("reason IS NULL"))


def with_supplement(backbone: DataFrame, supplement: DataFrame) -> DataFrame:
    """The features of both that are in, without the supplement's lines that repeat others, with roles and found surfaces.

    Lines are told apart by middle vertex and direction, the backbone's order and then that of `seq` deciding."""
    both = backbone.where("reason IS NULL").withColumn("main", F.lit(True)).unionByName(supplement.where("reason IS NULL").withColumn("main", F.lit(False)))
    line = lambda main: conflation.by_middles(both.where(F.col("main") == main).select(F.col("seq").alias("key"), "points", "surface"))
    found = conflation.resolved(line(True), line(False)).where("role <> 'duplicate'").select(F.col("key").alias("seq"), F.col("role").alias("new_role"), F.col("surface").alias("new_surface"))
    return both.join(found, "seq").withColumns({"role": F.col("new_role"), "surface": F.col("new_surface")}).drop("new_role", "new_surface", "main")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, region: str) -> None:
    """Nodes and edges as Parquet, and one row of JSON that says what they are."""
    nodes.write.mode("errorifexists").parquet(f"{folder}/nodes")
    edges.write.mode("errorifexists").parquet(f"{folder}/edges")
    spark = nodes.sparkSession
    box = spark.read.parquet(f"{folder}/nodes").agg(F.count("*").alias("nodes"), F.count_if("boundary").alias("boundary"), *(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))))
    counts = spark.read.parquet(f"{folder}/edges").agg(F.count("*").alias("edges"), F.sum("m").alias("meters"), F.count_distinct("component").alias("components"))
    meta = box.join(F.broadcast(counts)).select(F.lit(GRAPH_VERSION).alias("schemaVersion"), F.lit(region).alias("region"), "*")  # two rows of figures
    meta.coalesce(1).write.mode("errorifexists").json(f"{folder}/meta")


#: Sources that a pack's backbone has, besides roads without a source.
BACKBONE = r"(?i)national road network|^nrn\b|openstreetmap"


def packed_edges(features: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of a graph with what their features say: a pack from which the features can be had again."""
    said = features.select("edge_id", "seq", "role", "source", "road_class", "points")
    return edges.join(said, "edge_id").select("edge_id", "seq", "a", "b", "m", "s", "ac", "component", "role", F.col("source").alias("src"), F.col("road_class").alias("rt"), "points")


def rehydrated(spark: SparkSession, folder: str, backbone: bool = False) -> DataFrame:
    """The features of a pack's edges; of its backbone alone (the inventory, the open street map and roads without a source) if asked.

    Classes are read back from their codes, costs' "access" as resource roads; edges without a line are left out. Only the columns that
    features need are read."""
    rows = spark.read.parquet(f"{folder}/edges").where(F.size("points") >= 2)
    if backbone:
        rows = rows.where((F.coalesce("src", F.lit("")) == "") | F.col("src").rlike(BACKBONE))
    surface = code_name(F.col("s"), SURFACES)
    e5 = lambda k, c: F.floor(F.element_at("points", k)[c] * 1e5 + 0.5).cast("long")
    return rows.select("edge_id", "seq", "role", F.col("src").alias("source"), F.lit(None).cast("string").alias("reason"), F.when(surface == "access", "resource").otherwise(surface).alias("surface"), code_name(F.col("ac"), ACCESSES, "motorized_unknown").alias("access"),
                       F.coalesce("rt", F.lit("unknown")).alias("road_class"), F.col("m").cast("double").alias("meters"), "points", e5(1, "lon").alias("x1"), e5(1, "lat").alias("y1"), e5(-1, "lon").alias("x2"), e5(-1, "lat").alias("y2"))


def resnapped(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and packed edges of a pack, built again from its own lines under the rules that hold now; once more changes nothing."""
    features = rehydrated(spark, folder)
    nodes, edges = regional_graph(features)
    return nodes, packed_edges(features, edges)


def topology_report(edges: DataFrame) -> DataFrame:
    """One row: edges, components, metres and the kilometres of the fifteen largest components."""
    stats = component_stats(edges.select("a", "b", "m"))
    top = F.array_sort(F.collect_list(F.when(F.col("by_meters").isNotNull(), F.struct("by_meters", F.round(F.col("meters") / 1000, 1).alias("km")))))
    return stats.agg(F.sum("edges").alias("edges"), F.count("*").alias("components"), F.sum("meters").alias("meters"), F.transform(top, lambda t: t["km"]).alias("largest_km"))


def national_spine(regions: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The main roads of regions (name, nodes (node, x, y, boundary), edges (edge_id, a, b, m, s, rt)) merged into one graph."""
    def spine(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        border = lambda e: nodes.select(F.col("node").alias(e), F.col("boundary").alias(f"border_{e}"))
        rows = edges.join(border("a"), "a").join(border("b"), "b")
        return rows.where(is_spine(F.col("rt"), F.col("s"), F.col("m"), F.col("border_a") | F.col("border_b"))).select("edge_id", "a", "b", "m")

    def used(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return nodes.join(ends, "node", "left_semi").select("node", "x", "y")

    kept = [(name, nodes, spine(nodes, edges)) for name, nodes, edges in regions]
    return regional.merged([(name, used(nodes, edges), edges) for name, nodes, edges in kept])


def poi_pack(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Writes the points of interest of a sequence by chunk; counts by category. Features without tags or place are skipped."""
    read = files.read_sequence(spark, path, "\x1e").where("reason IS NULL")
    kind, at = F.get_json_object("geometry", "$.type"), F.get_json_object("geometry", "$.coordinates")
    rings = (F.when(kind == "Point", F.array(F.array(F.from_json(at, "array<double>")))).when(kind == "LineString", F.array(F.from_json(at, "array<array<double>>"))).when(kind.isin("Polygon", "MultiLineString"), F.from_json(at, "array<array<array<double>>>"))
             .when(kind == "MultiPolygon", F.transform(F.from_json(at, "array<array<array<array<double>>>>"), lambda p: p[0])))
    where = labels.address(*(_props(f"addr:{n}") for n in ("housenumber", "street", "city", "province", "postcode")))
    first = lambda *names: F.coalesce(*(labels.cleaned(_props(n)) for n in names))
    rows = read.select(_props("@id").alias("id"), *(_props(n).alias(n) for n in ("amenity", "shop", "tourism")), labels.representative_point(kind, rings).alias("at"), first("name", "brand", "operator").alias("name"), where.alias("address"), first("brand", "operator").alias("brand"), first("opening_hours").alias("hours"), first("phone", "contact:phone").alias("phone"), first("website", "contact:website").alias("website"), labels.updated_at(_props("@timestamp")).alias("updated"))
    points = packs.categorized(rows.where("at IS NOT NULL").select("*", "at.lon", "at.lat").drop("at"))
    packs.write_poi_chunks(points, f"{folder}/chunks")
    counts = packs.poi_counts(points)
    counts.select(F.lit(POI_VERSION).alias("schemaVersion"), "*").coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
    return counts


def trail_overlay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The lines that a trail overlay keeps, with kind and access, and their counts."""
    parts = files.line_parts(files.read_sequence(spark, path).where("reason IS NULL").drop("reason"))
    rows = parts.select("*", capillary_rules.trail(_props).alias("t")).select("line", _props("@id").alias("id"), "t.*").where("keep").drop("keep")
    return rows, reports.counts_by(rows, "kind", "status")


def gravel_overlay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The gravel lines of an inventory with how that is known, and counts."""
    parts = files.line_parts(files.read_sequence(spark, path).where("reason IS NULL").drop("reason"))
    rows = parts.select("*", capillary_rules.display_class(_props).alias("d")).select("line", _props("ROADCLASS").alias("road_class"), "d.*").where("track_class = 'gravel'")
    return rows, reports.counts_by(rows, "track_class", "confidence", "road_class")
