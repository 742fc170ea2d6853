"""Extracts of a road graph, and dense numbers for what they keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.geometry import haversine
from trailframe.operators.components import checkpointed, connected_components

# Classes of through roads; share of the box that counts as its border; metres from a hub that are kept.
THROUGH, BORDER, HUB_M, TRACK = ("freeway", "arterial", "ramp", "collector"), 0.04, 45_000.0, 3


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with `at_border` and the coordinates (xa, ya, xb, yb, in 1e-5 degrees) of their ends."""
    box = nodes.agg(F.struct(*(f(c).alias(f"{c}_{n}") for c in ("lon_e5", "lat_e5") for n, f in (("lo", F.min), ("hi", F.max)))).alias("box"))  # one row
    low, high = (lambda c: F.col(f"box.{c}_lo")), (lambda c: F.col(f"box.{c}_hi"))
    pad = lambda c: (high(c) - low(c)) * BORDER
    near = reduce(lambda a, b: a | b, (t for c in ("lon_e5", "lat_e5") for t in (F.col(c) <= low(c) + pad(c), F.col(c) >= high(c) - pad(c))))
    marked = nodes.select("*", box.scalar().alias("box")).select("node_id", "lon_e5", "lat_e5", near.alias("near"))
    end = lambda e: marked.select(F.col("node_id").alias(e), F.col("lon_e5").alias(f"x{e}"), F.col("lat_e5").alias(f"y{e}"), F.col("near").alias(f"near_{e}"))
    return edges.join(end("a"), "a").join(end("b"), "b").withColumn("at_border", F.col("near_a") | F.col("near_b")).drop("near_a", "near_b")


def is_through(classed: bool = True) -> Column:
    """Long-haul roads. With classes: through roads, others without class that aren't tracks or access, longer ones at the border; without: longer ones."""
    surface, meters, border = F.col("s"), F.col("m"), F.col("at_border")
    if classed:
        return F.col("rt").isin(*THROUGH) | ((F.coalesce("rt", F.lit("")) == "") & ~surface.isin(2, TRACK)) | (border & (surface != TRACK) & (meters >= 150))
    return (surface != TRACK) & ((border & (meters >= 100)) | (meters >= 350))


def highway(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("s") != TRACK)


def maritime(edges: DataFrame) -> DataFrame:
    """What isn't a track of the national inventory, and through roads of the other sources (column `src`)."""
    national = F.coalesce(F.col("src"), F.lit("")).rlike("(?i)national road network")
    return edges.where(F.when(national, F.col("s") != TRACK).otherwise(F.col("rt").isin(*THROUGH)))


def hub_extract(edges: DataFrame, hubs: list[tuple[float, float]], meters: float = HUB_M) -> DataFrame:
    """Long-haul roads, and all but tracks with an end near a hub; hubs (lon, lat) are part of the request and so constants."""
    near = [haversine(F.col(f"x{e}") / 1e5, F.col(f"y{e}") / 1e5, F.lit(h[0]), F.lit(h[1])) <= meters for h in hubs for e in ("a", "b")]
    return edges.where(is_through() | ((F.col("s") != TRACK) & reduce(lambda a, b: a | b, near, F.lit(False))))


# Metres from a hub within which fabric keeps small roads; names of modes that take the open street map only, and it
# with the provinces' roads; modes that take all of the national inventory but tracks.
FABRIC_HUB_M, MAP_ONLY, MAP_AND_PROVINCIAL, DENSE = 40_000.0, ("osm", "osm-only"), ("osm-provincial", "osm+provincial", "osm+nstdb", "osm-nstdb"), ("corridor", "dense", "maritime")


def fabric(edges: DataFrame, mode: str = "hub", hubs: list[tuple[float, float]] = (), meters: float = FABRIC_HUB_M, no_service: bool = False, service_near_hubs: bool = False) -> DataFrame:
    """The road fabric of a long-haul graph, by source and mode; roads of the open street map whose access is unknown become permissive.

    Map modes take its roads, with the provinces' or without them; others take it and the national inventory: through roads
    everywhere, others near hubs, the inventory's resource roads nowhere. Dense modes take all of the inventory but tracks.
    Hubs (lon, lat) are part of the request and so constants; edges come from `with_ends`."""
    source, road = F.coalesce(F.col("src"), F.lit("")), F.coalesce(F.col("rt"), F.lit(""))
    mapped, national = source.rlike("(?i)openstreetmap"), source.rlike("(?i)national road network")
    near = [haversine(F.col(f"x{e}") / 1e5, F.col(f"y{e}") / 1e5, F.lit(h[0]), F.lit(h[1])) <= meters for h in hubs for e in ("a", "b")]
    at_hub = reduce(lambda a, b: a | b, near, F.lit(False))
    service = F.lit(no_service) & (road == "service")
    if mode in MAP_ONLY:
        kept = mapped & ~service & ~(F.lit(service_near_hubs) & (road == "service") & ~at_hub)
    elif mode in MAP_AND_PROVINCIAL:
        kept = ~national & ~(mapped & service)
    else:
        inventory = (F.col("s") != TRACK) & (F.lit(mode in DENSE) | road.isin(*THROUGH) | ((road != "resource") & at_hub))
        kept = F.when(mapped, road.isin(*THROUGH) | at_hub).when(national, inventory).otherwise(False)
    return edges.where(kept).withColumn("ac", F.when(mapped & (F.col("ac") == 2), 1).otherwise(F.col("ac")))


def numbered(rows: DataFrame, key: str, name: str = "number") -> DataFrame:
    """`rows` with numbers from 0 in the order of the unique `key`; no task sees all rows.

    Rows are sorted by ranges and numbered as they are written, without another shuffle; the counts of the ranges before give the
    offset. Those are a row for each partition, so that the window over them, without a partition, is small."""
    ordered = checkpointed(rows.orderBy(key).withColumn("_at", F.monotonically_increasing_id()))  # range << 33, plus the place in it
    ordered = ordered.withColumns({"_range": F.shiftright("_at", 33), name: F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    counts = ordered.groupBy("_range").count()
    offsets = counts.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    return ordered.join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def dealt_to_boxes(edges: DataFrame, boxes: Column) -> DataFrame:
    """`edges` (with the ends xa, ya, xb, yb) once for each box (name, west, south, east, north; in 1e-5 degrees) that an end lies in, as column
    `pack`: one pass over the edges, however many boxes overlap."""
    inside = lambda b, e: F.col(f"x{e}").between(b["west"], b["east"]) & F.col(f"y{e}").between(b["south"], b["north"])
    hit = F.transform(F.filter("_boxes", lambda b: inside(b, "a") | inside(b, "b")), lambda b: b["name"])
    return edges.select("*", boxes.alias("_boxes")).select("*", F.explode(hit).alias("pack")).drop("_boxes")


def pack_components(edges: DataFrame) -> DataFrame:
    """(pack, node, component) of the edges (pack, a, b) of many packs, found together; components are named by their smallest node.

    Nodes of different packs are told apart by numbers of their own."""
    used = edges.select("pack", F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = checkpointed(numbered(used.select("pack", "node", F.struct("pack", "node").alias("_key")), "_key", "id").select("pack", "node", "id"))
    end = lambda e: ids.select("pack", F.col("node").alias(e), F.col("id").alias(f"id_{e}"))
    links = edges.join(end("a"), ["pack", "a"]).join(end("b"), ["pack", "b"])
    found = checkpointed(connected_components(links, "id_a", "id_b"))
    names = ids.select(F.col("id").alias("component"), F.col("node").alias("name"))
    return ids.join(found.withColumnRenamed("node", "id"), "id").join(names, "component").select("pack", "node", F.col("name").alias("component"))


def compacted(edges: DataFrame) -> DataFrame:
    """`edges` with ends numbered from 0 in the order of the node ids that are left."""
    left = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = checkpointed(numbered(left, "node"))
    to = lambda e: ids.select(F.col("node").alias(e), F.col("number").alias(f"new_{e}"))
    return edges.join(to("a"), "a").join(to("b"), "b").withColumns({"a": F.col("new_a"), "b": F.col("new_b")}).drop("new_a", "new_b")


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, number): components in the order of their first edge (column `seq`)."""
    first = edges.join(labels.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.min("seq").alias("seq"))
    return numbered(first, "seq").select("component", "number")


def thinned(points: Column, most: int) -> Column:
    """At most `most` points at even steps, with both ends; halves round up."""
    last = F.size(points) - 1
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(points, F.floor(i * last / (most - 1) + 0.5).cast("int")))
    return F.when(last < most, points).otherwise(at)
