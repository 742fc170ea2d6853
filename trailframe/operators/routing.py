"""Routes of many requests at once: snapping to roads, cheapest paths by profile inside an ellipse, chains of several
places, and what a route is made of.

A request is (query, profile, permissive, unknown, start_lon, start_lat, end_lon, end_lat); a road is (edge_id, seq, a, b,
m, s, ac, rt, src, component, line), its line being points (lon, lat). All requests run in the same rounds: labels are
spread by request and block of nodes, and only those that got better go on."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import classify, profiles
from trailframe.functions.geometry import haversine, project_on_segment
from trailframe.operators import graph, lines, regional
from trailframe.operators.components import checkpointed, connected_components
from trailframe.operators.trips import percent

# Cells that roads are found by (degrees), metres within which a point takes a road at first, of a chain's places, and
# when none is found, and by which roads of the wished surface seem nearer; widenings of the ellipse (none: no bound), what a
# path may cost in it; degrees and share of the way around the ends of a request in which roads are stitched together.
CELL, MATCH_M, CHAIN_M, WIDE_M, SOFT_M, PAVED_M = 0.01, 250.0, 500.0, 750.0, 22.0, 30.0
WIDENINGS, SANE = (1.0, 1.25, 1.6, None), 2.5
STITCH_PAD, STITCH_SHARE, STITCH = 0.04, 0.35, "soft-stitch-"
METERS_PER_DEGREE = 111_320.0
#: Parameters: nodes of a block that a request's labels settle in by themselves, cells by which requests meet roads (degrees).
BLOCK, AREA = 1 << 13, 0.05
_ROAD = ["edge_id", "a", "b", "m", "s", "ac", "rt", "src", "component"]


def _legs_of(line: Column) -> Column:
    """The segments (k, p, q, long) of a line, in order."""
    at = lambda i, c: F.get(line, i)[c]
    return F.transform(F.sequence(F.lit(0), F.size(line) - 2), lambda i: F.struct(
        i.alias("k"), F.get(line, i).alias("p"), F.get(line, i + 1).alias("q"), haversine(at(i, "lon"), at(i, "lat"), at(i + 1, "lon"), at(i + 1, "lat")).alias("long")))


def _cells_along(p: Column, q: Column) -> Column:
    """The cells of points on a segment that lie at most a cell apart: a diagonal takes as many as it is long."""
    dx, dy = q["lon"] - p["lon"], q["lat"] - p["lat"]
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / CELL)).cast("int")
    at = lambda x: F.floor(x / CELL).cast("long")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(at(p["lon"] + dx * i / n).alias("cx"), at(p["lat"] + dy * i / n).alias("cy"))))


def candidates(points: DataFrame, roads: DataFrame, limit: float, avoid: DataFrame | None = None) -> DataFrame:
    """Points with the open segments around them, each with `chosen` (what a match says), `distance` and `score`.

    Pins that start on anything but pavement, and ends or clean profiles on pavement, count as nearer. A point on a segment is
    at most half a cell from one that names a cell, so asking the cells within `limit` and that much more finds all."""
    reach = (limit + PAVED_M) / METERS_PER_DEGREE
    spread = lambda c, r: F.sequence(F.floor((F.col(c) - r) / CELL).cast("long"), F.floor((F.col(c) + r) / CELL).cast("long"))
    wide = F.lit(reach) / F.cos(F.radians(F.least(F.lit(85.0), F.abs("lat") + reach)))
    asked = points.select("*", F.explode(spread("lon", wide + CELL / 2)).alias("cx")).select("*", F.explode(spread("lat", F.lit(reach + CELL / 2))).alias("cy"))
    if avoid is not None:
        roads = roads.join(avoid.select("edge_id"), "edge_id", "left_anti")
    parts = roads.where(F.size("line") >= 2).select("seq", *_ROAD, F.explode(_legs_of(F.col("line"))).alias("g")).select("seq", *_ROAD, "g.*")
    given = parts.select("*", F.explode(_cells_along(F.col("p"), F.col("q"))).alias("c")).select("*", "c.cx", "c.cy").drop("c")
    access, surface = classify.code_name(F.col("ac"), classify.ACCESSES), classify.code_name(F.col("s"), classify.SURFACES)
    both = asked.join(given, ["cx", "cy"]).where(classify.access_allowed(access, F.col("permissive"), F.col("unknown"), F.col("src")))
    t = project_on_segment(F.col("lon"), F.col("lat"), F.col("p.lon"), F.col("p.lat"), F.col("q.lon"), F.col("q.lat"))
    at = both.withColumn("t", t).withColumns({"x": F.col("p.lon") + (F.col("q.lon") - F.col("p.lon")) * F.col("t"), "y": F.col("p.lat") + (F.col("q.lat") - F.col("p.lat")) * F.col("t")})
    at = at.withColumn("distance", haversine(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")))
    paved = (F.col("profile") == "cleanest") | (F.col("role") == "end")
    bias = F.when(~paved & (surface != "paved"), -SOFT_M).when(paved & (surface == "paved"), -PAVED_M).otherwise(0.0)
    chosen = F.struct("seq", *_ROAD, "x", "y", "distance", "k", (F.col("long") * F.col("t")).alias("rest"))
    return at.withColumns({"score": F.struct((F.col("distance") + bias).alias("score"), "seq", "k"), "chosen": chosen})


def _with_along(found: DataFrame, roads: DataFrame, *matches: str) -> DataFrame:
    """Matches with the metres of the road's line before them; only the roads that were taken are measured."""
    for match in matches:
        lines = roads.select(F.col("seq").alias("_seq"), F.col("line").alias("_line"))
        before = F.aggregate(F.slice(_legs_of(F.col("_line")), F.lit(1), F.col(f"{match}.k")), F.lit(0.0), lambda acc, g: acc + g["long"])
        fields = [F.col(f"{match}.{c}").alias(c) for c in (*_ROAD, "x", "y", "distance", "k")]
        whole = F.struct(*fields, (before + F.col(f"{match}.rest")).alias("along"))
        found = found.withColumn("_seq", F.col(f"{match}.seq")).join(lines, "_seq", "left").withColumn(match, F.when(F.col(match).isNotNull(), whole)).drop("_seq", "_line")
    return found


def matched(points: DataFrame, roads: DataFrame, giant: Column, limit: float, avoid: DataFrame | None = None) -> DataFrame:
    """The road that each point (query, role, lon, lat, profile, permissive, unknown) takes, if one is near enough.

    Open roads are scored by distance. A road of the largest component within the limit goes before any other; ties to the first road."""
    near = candidates(points, roads, limit, avoid)
    in_giant = (F.col("component") == giant) & (F.col("distance") <= limit)
    best = near.groupBy("query", "role").agg(F.min_by("chosen", "score").alias("any"), F.min_by("chosen", F.when(in_giant, F.col("score"))).alias("main"))
    return _with_along(best.select("query", "role", F.coalesce("main", "any").alias("match")).where(F.col("match.distance") <= limit), roads, "match")


def giant_component(roads: DataFrame) -> Column:
    """The component of most roads, of equal ones that of the first road; 0 without roads."""
    sizes = roads.where("component >= 0").groupBy("component").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return F.coalesce(sizes.agg(F.max_by("component", F.struct("n", -F.col("first")))).scalar(), F.lit(0))


def reconciled(asked: DataFrame, roads: DataFrame, giant: Column, avoid: DataFrame | None = None, hubs: bool = False) -> DataFrame:
    """Requests with matches `start` and `end` and `reach` (metres they were looked for within), brought into one component if they aren't.

    For both ends the nearest roads of the other end's component and of the largest one are looked for in one pass. Graphs of
    `hubs` take the other end's component for the end, else for the start, else the largest one for both; other graphs
    bring the ends that aren't there into the largest one, if all of them find a road there. Else both stay."""
    component = lambda role: F.col(f"{role}.component")
    apart = checkpointed(asked.where("start IS NOT NULL AND end IS NOT NULL AND start.component >= 0 AND end.component >= 0 AND start.component <> end.component"))
    if apart.isEmpty():
        return asked.drop("reach")
    end = lambda role, other: apart.select("query", F.lit(role).alias("role"), F.col(f"{role}_lon").alias("lon"), F.col(f"{role}_lat").alias("lat"), "profile", "permissive", "unknown", "reach", component(other).alias("other"))
    near = candidates(end("start", "end").unionByName(end("end", "start")), roads, WIDE_M, avoid)
    # Roads without component stand in the way of those looked for, if they are nearer.
    inside = lambda c: F.when((F.col("component") == c) | (F.coalesce("component", F.lit(-1)) < 0), F.col("score"))
    best = near.withColumn("giant", giant).groupBy("query", "role").agg(F.min_by("chosen", inside(F.col("other"))).alias("beside"), F.min_by("chosen", inside(F.col("giant"))).alias("main"), F.first("other").alias("other"), F.first("giant").alias("giant"), F.first("reach").alias("reach"))
    valid = lambda m, c: F.when((F.col(f"{m}.component") == F.col(c)) & (F.col(f"{m}.distance") <= F.col("reach")), F.col(m))
    best = _with_along(best.select("query", "role", valid("beside", "other").alias("beside"), valid("main", "giant").alias("main"), "giant"), roads, "beside", "main")
    of = lambda role: best.where(F.col("role") == role).select("query", F.col("beside").alias(f"{role}_beside"), F.col("main").alias(f"{role}_main"), F.col("giant").alias(f"{role}_giant"))
    both = apart.join(of("start"), "query", "left").join(of("end"), "query", "left").withColumn("giant", F.coalesce("start_giant", "end_giant"))
    has, there = (lambda c: F.col(c).isNotNull()), (lambda role: F.col(f"{role}.component") == F.col("giant"))
    to_main = has("start_main") & has("end_main")
    if hubs:
        new_end = F.when(has("end_beside"), F.col("end_beside")).when(has("start_beside"), F.col("end")).when(to_main, F.col("end_main")).otherwise(F.col("end"))
        new_start = F.when(has("end_beside"), F.col("start")).when(has("start_beside"), F.col("start_beside")).when(to_main, F.col("start_main")).otherwise(F.col("start"))
    else:
        moved = lambda role, other: F.when(there(role), F.col(role)).when(there(other) & has(f"{role}_main"), F.col(f"{role}_main")).when(~there(other) & to_main, F.col(f"{role}_main")).otherwise(F.col(role))
        new_start, new_end = moved("start", "end"), moved("end", "start")
    changed = checkpointed(both.select("query", new_start.alias("_start"), new_end.alias("_end")))
    return asked.join(changed, "query", "left").withColumns({"start": F.coalesce("_start", "start"), "end": F.coalesce("_end", "end")}).drop("_start", "_end", "reach")


def snapped(requests: DataFrame, roads: DataFrame, avoid: DataFrame | None = None, limit: float = MATCH_M, hubs: bool = False) -> DataFrame:
    """Requests with the matches `start` and `end` (null: no road), looked for within `limit` and then 750 metres, and in one component where that can be."""
    end = lambda role: requests.select("query", F.lit(role).alias("role"), F.col(f"{role}_lon").alias("lon"), F.col(f"{role}_lat").alias("lat"), "profile", "permissive", "unknown")
    points, giant = end("start").unionByName(end("end")), giant_component(roads)
    near = checkpointed(matched(points, roads, giant, limit, avoid))
    rest = checkpointed(points.join(near, ["query", "role"], "left_anti"))
    both = near.withColumn("reach", F.lit(limit))
    if limit < WIDE_M and not rest.isEmpty():
        both = checkpointed(both.unionByName(matched(rest, roads, giant, WIDE_M, avoid).withColumn("reach", F.lit(WIDE_M))))
    of = lambda role: both.where(F.col("role") == role).select("query", F.col("match").alias(role), F.col("reach").alias(f"_{role}"))
    asked = requests.join(of("start"), "query", "left").join(of("end"), "query", "left").withColumn("reach", F.greatest("_start", "_end")).drop("_start", "_end")
    return reconciled(checkpointed(asked), roads, giant, avoid, hubs)


def _point(c: str) -> tuple[Column, Column]:
    return F.col(f"{c}.x"), F.col(f"{c}.y")


def _cost(meters: Column, edge: str, leg: bool, rt: Column | None = None) -> Column:
    """The cost of a step over an edge whose fields begin with `edge`, given the columns of `profiles.places`."""
    name = lambda c, names: classify.code_name(F.col(f"{edge}{c}"), names)
    return profiles.step_cost(meters, name("s", classify.SURFACES), F.col(f"{edge}rt") if rt is None else rt, name("ac", classify.ACCESSES), profiles.is_provincial(F.col(f"{edge}edge_id"), F.col(f"{edge}src")), F.col("profile"), F.col("unknown"), F.lit(True) if leg else None)


def _placed(rows: DataFrame, at: tuple, to: tuple) -> DataFrame:
    return rows.withColumns(profiles.places(at, to, _point("start"), _point("end")))


def _legs(requests: DataFrame, nodes: DataFrame, role: str) -> DataFrame:
    """(query, node, meters, cost) of the two ways between a match and the ends of its road."""
    m = lambda c: F.col(f"{role}.{c}")
    ways = F.array(F.struct(m("a").alias("node"), m("along").alias("meters")), F.struct(m("b").alias("node"), F.greatest(F.lit(0.0), m("m") - m("along")).alias("meters")))
    rows = requests.select("*", F.explode(ways).alias("w")).select("*", "w.*").join(nodes, "node")
    here, there = (F.col("lon"), F.col("lat")), _point(role)
    at, to = (there, here) if role == "start" else (here, there)
    return _placed(rows, at, to).select("query", "node", "meters", _cost(F.col("meters"), f"{role}.", True).alias("cost"))


def _arcs(roads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ways of each road, with the coordinates of its ends."""
    ends = lambda e, k: nodes.select(F.col("node").alias(e), F.col("lon").alias(f"x{k}"), F.col("lat").alias(f"y{k}"))
    fields = ["edge_id", "m", "s", "ac", "rt", "src"]
    ways = F.explode(F.array(F.struct(F.col("a").alias("from"), F.col("b").alias("to")), F.struct(F.col("b").alias("from"), F.col("a").alias("to")))).alias("w")
    return roads.where("a <> b").select(*fields, ways).select(*fields, "w.*").join(ends("from", 1), "from").join(ends("to", 2), "to")


def _open(rows: DataFrame) -> DataFrame:
    return rows.where(classify.access_allowed(classify.code_name(F.col("ac"), classify.ACCESSES), F.col("permissive"), F.col("unknown"), F.col("src")))


def _area(c: Column) -> Column:
    return F.floor(c / AREA).cast("long")


def _areas(rows: DataFrame, low_x: Column, high_x: Column, low_y: Column, high_y: Column) -> DataFrame:
    """Rows once for each cell (cx, cy) of a box."""
    spread = lambda a, b: F.explode(F.sequence(_area(a), _area(b)))
    return rows.select("*", spread(low_x, high_x).alias("cx"), low_y.alias("_ly"), high_y.alias("_hy")).select("*", spread(F.col("_ly"), F.col("_hy")).alias("cy")).drop("_ly", "_hy")


def _most(widening: float) -> Column:
    """Metres by way of a node of a request's ellipse."""
    return profiles.by_name(F.col("profile"), profiles.ELLIPSE, 1.5) * widening * haversine(*_point("start"), *_point("end")) * (1 + 1e-7)


def _inside(x: str, y: str) -> Column:
    return haversine(*_point("start"), F.col(x), F.col(y)) + haversine(F.col(x), F.col(y), *_point("end")) <= F.col("most")


def _cheapest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query", "from", "to").agg(F.min(F.struct("price", "edge_id")).alias("p")).select("query", "from", "to", "p.*")


_ASKED = ["query", "profile", "permissive", "unknown", "start", "end"]


def _with_price(rows: DataFrame) -> DataFrame:
    return _placed(rows, (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))).withColumn("price", _cost(F.col("m"), "", False))


def priced(requests: DataFrame, roads: DataFrame, nodes: DataFrame, widening: float) -> DataFrame:
    """(query, from, to, edge_id, price): the steps that snapped requests may take inside their ellipse, both ways of each road.

    Requests meet roads by the cells around their ellipse."""
    arcs = _arcs(roads, nodes)
    arcs = arcs.withColumns({"cx": _area(F.col("x1")), "cy": _area(F.col("y1"))})
    (sx, sy), (ex, ey) = _point("start"), _point("end")
    half = F.col("most") / 2 / 111_000
    wide = half / F.cos(F.radians(F.least(F.lit(85.0), F.abs((sy + ey) / 2) + half)))
    given = _areas(requests.select(*_ASKED, _most(widening).alias("most")), (sx + ex) / 2 - wide, (sx + ex) / 2 + wide, (sy + ey) / 2 - half, (sy + ey) / 2 + half)
    rows = _open(given.join(arcs, ["cx", "cy"])).where(_inside("x2", "y2"))
    return _cheapest(_with_price(rows).select("query", "from", "to", "edge_id", "price"))


def stitched(requests: DataFrame, roads: DataFrame, nodes: DataFrame, giant: Column) -> DataFrame:
    """(query, from, to, edge_id, price, x2, y2): joins that snapped requests may take from small components to the largest, both ways.

    Requests that allow unknown access, but for the clean profile, may cross from a node of a small component's road of unknown
    access to the nearest through node of the largest one, at twelve times its kilometres; in the box around their ends, and
    into a town centre only near an end."""
    pairs = regional.stitch_pairs(nodes.select("node", (F.col("lon") * 1e5).alias("x"), (F.col("lat") * 1e5).alias("y")), roads, giant)
    at = lambda e, k: nodes.select(F.col("node").alias(e), F.col("lon").alias(f"x{k}"), F.col("lat").alias(f"y{k}"))
    pairs = pairs.join(at("a", 1), "a").join(at("b", 2), "b").withColumns({"cx": _area(F.col("x1")), "cy": _area(F.col("y1"))})
    (sx, sy), (ex, ey) = _point("start"), _point("end")
    pad = F.greatest(F.lit(STITCH_PAD), haversine(sx, sy, ex, ey) / METERS_PER_DEGREE * STITCH_SHARE)
    box = requests.where("unknown AND profile <> 'cleanest'").select(*_ASKED, (F.least(sx, ex) - pad).alias("west"), (F.greatest(sx, ex) + pad).alias("east"), (F.least(sy, ey) - pad).alias("south"), (F.greatest(sy, ey) + pad).alias("north"))
    given = _areas(box, F.col("west"), F.col("east"), F.col("south"), F.col("north"))
    inside = lambda k: F.col(f"x{k}").between(F.col("west"), F.col("east")) & F.col(f"y{k}").between(F.col("south"), F.col("north"))
    near_end = (haversine(F.col("x2"), F.col("y2"), sx, sy) <= 2500) | (haversine(F.col("x2"), F.col("y2"), ex, ey) <= 2500)
    rows = given.join(pairs, ["cx", "cy"]).where(inside(1) & inside(2) & (~F.col("town") | near_end))
    best = rows.groupBy("query", "a").agg(F.min_by(F.struct("b", "meters", "x1", "y1", "x2", "y2", "profile", "unknown", "start", "end"), F.struct("meters", "b")).alias("t")).select("query", "a", "t.*")
    way = lambda f, t, i, j: F.struct(F.col(f).alias("from"), F.col(t).alias("to"), F.col(f"x{i}").alias("u1"), F.col(f"y{i}").alias("v1"), F.col(f"x{j}").alias("u2"), F.col(f"y{j}").alias("v2"))
    name = F.concat(F.lit(STITCH), F.least("a", "b").cast("string"), F.lit(":"), F.greatest("a", "b").cast("string"))
    ways = best.select("*", name.alias("edge_id"), F.explode(F.array(way("a", "b", 1, 2), way("b", "a", 2, 1))).alias("w")).select("query", "profile", "unknown", "start", "end", "edge_id", F.greatest(F.lit(1.0), "meters").alias("meters"), "w.*")
    none = F.lit(None).cast("string")
    price = profiles.step_cost(F.col("meters"), none, none, none, profiles.is_provincial(F.col("edge_id"), none), F.col("profile"), F.col("unknown"), F.lit(True), F.lit(True))
    return _placed(ways, (F.col("u1"), F.col("v1")), (F.col("u2"), F.col("v2"))).select("query", "from", "to", "edge_id", price.alias("price"), F.col("u2").alias("x2"), F.col("v2").alias("y2")).dropDuplicates(["query", "from", "to"])


def search(requests: DataFrame, roads: DataFrame, nodes: DataFrame, widening: float | None, joins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels (query, node, cost, prev, edge_id) and goals (query, cost, node or null where the way stays on one road, meters) of snapped requests.

    Only nodes in the ellipse of a request's profile, widened, are visited; without a bound, steps are priced where labels
    arrive. `joins` are the stitches that requests may take too. Labels that cost no less than a goal already reached go no
    further. They spread block by block (`graph.spread`)."""
    legs_in, legs_out = _legs(requests, nodes, "start"), checkpointed(_legs(requests, nodes, "end"))
    same = requests.where(F.col("start.edge_id") == F.col("end.edge_id"))
    meters = F.abs(F.col("start.along") - F.col("end.along"))
    one_road = _placed(same, _point("start"), _point("end")).select("query", _cost(meters, "start.", False, F.lit("unknown")).alias("cost"), F.lit(None).cast("long").alias("node"), meters.alias("meters"))
    where = lambda rows: graph.in_block(rows, "from", BLOCK)
    if widening is None:
        asked = checkpointed(requests.select(*_ASKED))
        arcs = _arcs(roads, nodes)
        arcs = checkpointed(arcs.withColumn("block", where(arcs)).repartitionByRange("block", "from").sortWithinPartitions("block"))
        more = None if joins is None else checkpointed(joins.select("query", "from", "to", "edge_id", "price").withColumn("block", where(joins)))
    else:
        steps = priced(requests, roads, nodes, widening)
        if joins is not None:
            inside = joins.join(requests.select("query", "start", "end", _most(widening).alias("most")), "query").where(_inside("x2", "y2"))
            steps = _cheapest(steps.unionByName(inside.select("query", "from", "to", "edge_id", "price")))
        steps = checkpointed(steps.withColumn("block", where(steps)))

    def goals(labels: DataFrame) -> DataFrame:
        return labels.join(legs_out.withColumnRenamed("cost", "leg"), ["query", "node"]).select("query", (F.col("cost") + F.col("leg")).alias("cost"), "node", "meters")

    def least_goal(rows: DataFrame) -> DataFrame:
        return rows.groupBy("query").agg(F.min(F.struct("cost", "node", "meters")).alias("g")).select("query", "g.*")

    def steps_of(entered: DataFrame, read: Callable) -> DataFrame:
        if widening is not None:
            return read(steps).join(entered, ["query", "block"])
        rows = _with_price(_open(read(arcs).join(entered, "block").join(asked, "query"))).select("query", "block", "from", "to", "edge_id", "price")
        if more is not None:
            rows = rows.unionByName(read(more).join(entered, ["query", "block"]))
        return rows.groupBy("query", "block", "from", "to").agg(F.min(F.struct("price", "edge_id")).alias("p")).select("query", "block", "from", "to", "p.*")

    goal = checkpointed(least_goal(one_road))

    def bounds(reached: DataFrame) -> DataFrame:
        nonlocal goal
        goal = checkpointed(least_goal(goals(reached).unionByName(goal)))
        return goal.select("query", F.col("cost").alias("bound"))

    starts = legs_in.groupBy("query", "node").agg(F.min("cost").alias("cost")).select("query", "node", "cost", F.lit(None).cast("long").alias("prev"), F.lit(None).cast("string").alias("edge_id"))
    labels = graph.spread(starts, steps_of, BLOCK, bounds)
    return checkpointed(labels.groupBy("query", "node").agg(F.min(F.struct("cost", "prev", "edge_id")).alias("label")).select("query", "node", "label.*")), goal


def unreachable(requests: DataFrame, roads: DataFrame, joins: DataFrame) -> DataFrame:
    """(query) of the snapped requests whose ends no way joins, over the roads open to them and the stitches `joins` they may take.

    Told by components of the open roads, one set for each policy, and by hops over stitches between these; without it, a search
    without a bound would go through all that can be reached."""
    code = F.col("permissive").cast("int") * 2 + F.col("unknown").cast("int")
    named = lambda c: F.col(c).cast("long") * 4 + F.col("policy")
    policies = requests.select("permissive", "unknown").distinct()  # four at most
    ways = _open(roads.crossJoin(F.broadcast(policies))).withColumn("policy", code).select(named("a").alias("a"), named("b").alias("b"))
    parts = checkpointed(connected_components(ways))
    # A node that no open road leads to is by itself.
    part_of = lambda rows, c: rows.withColumn("node", named(c)).join(parts, "node", "left").withColumn(c, F.coalesce("component", "node")).drop("node", "component")
    asked = requests.withColumn("policy", code)
    ends = lambda role: part_of(asked.select("query", "policy", F.explode(F.array(f"{role}.a", f"{role}.b")).alias("at")), "at").select("query", "at").distinct()
    over = joins.select("query", "from", "to").join(asked.select("query", "policy"), "query")
    over = checkpointed(part_of(part_of(over, "from"), "to").where(F.col("from") != F.col("to")).select("query", "from", "to").distinct())
    reached = new = checkpointed(ends("start"))
    while not new.isEmpty():
        new = checkpointed(new.withColumnRenamed("at", "from").join(over, ["query", "from"]).select("query", F.col("to").alias("at")).distinct().join(reached, ["query", "at"], "left_anti"))
        reached = checkpointed(reached.unionByName(new))
    return requests.select("query").join(ends("end").join(reached, ["query", "at"], "left_semi"), "query", "left_anti")


def backtracked(labels: DataFrame, goals: DataFrame) -> DataFrame:
    """(query, back, node, prev, edge_id): the labels from each goal back to the start, by doubling jumps: few rounds for long paths.

    Only labels that cost no more than their request's goal can lie on its path."""
    ends = goals.where("node IS NOT NULL")
    jumps = checkpointed(labels.join(ends.select("query", F.col("cost").alias("most")), "query").where("cost <= most").select("query", "node", "prev", "edge_id"))
    on = [checkpointed(ends.select("query", "node", F.lit(0).alias("back")))]
    jump, length = jumps.where("prev IS NOT NULL").select("query", "node", F.col("prev").alias("up")), 1
    while True:
        more = checkpointed(reduce(DataFrame.unionByName, on).join(jump, ["query", "node"]).select("query", F.col("up").alias("node"), (F.col("back") + length).alias("back")))
        if more.isEmpty():
            return reduce(DataFrame.unionByName, on).join(jumps, ["query", "node"]).select("query", "back", "node", "prev", "edge_id")
        on.append(more)
        ahead = jump.select("query", F.col("node").alias("up"), F.col("up").alias("top"))
        jump, length = checkpointed(jump.join(ahead, ["query", "up"]).select("query", "node", F.col("top").alias("up"))), length * 2


def routes(requests: DataFrame, roads: DataFrame, nodes: DataFrame, avoid: DataFrame | None = None, limit: float = MATCH_M, hubs: bool = False) -> DataFrame:
    """The pieces (query, place, edge_id, meters, surface, access, leg, cost) of the cheapest route of each request, in order.

    A request without a road at one of its ends, or without a path, has one row with `error`. Requests whose ellipse holds
    no path, or only one that costs too much, are tried again in wider ones. Ends in two components that no stitch leaves have no path."""
    asked = checkpointed(snapped(requests, roads, avoid, limit, hubs))
    giant = giant_component(roads)
    if avoid is not None:
        roads = roads.join(avoid.select("edge_id"), "edge_id", "left_anti")
    missing = asked.where("start IS NULL OR end IS NULL").select("query", F.lit("match_failed").alias("error"))
    both = asked.where("start IS NOT NULL AND end IS NOT NULL")
    joins = checkpointed(stitched(both, roads, nodes, giant))
    apart = "start.component >= 0 AND end.component >= 0 AND start.component <> end.component"
    cut = checkpointed(both.where(apart).select("query").join(joins.select("query"), "query", "left_anti"))
    left = checkpointed(both.join(cut, "query", "left_anti"))
    missing, pieces = missing.unionByName(cut.select("query", F.lit("no_route").alias("error"))), None
    for widening in WIDENINGS:
        if widening is None and not left.isEmpty():
            never = checkpointed(unreachable(left, roads, joins))
            missing = missing.unionByName(never.select("query", F.lit("no_route").alias("error")))
            left = checkpointed(left.join(never, "query", "left_anti"))
        if left.isEmpty():
            break
        labels, goals = search(left, roads, nodes, widening, joins)
        goals = goals.join(left.select("query", "profile", "start", "end"), "query")
        if widening is not None:
            km = F.greatest(haversine(*_point("start"), *_point("end")) / 1000, F.lit(0.001))
            most = profiles.by_name(F.col("profile"), {p: profiles.ELLIPSE[p] * profiles.greatest_weight(p) for p in profiles.ELLIPSE}, 1.5 * profiles.greatest_weight("balanced"))
            goals = goals.where(F.col("cost") <= most * widening * km * SANE)
        goals = checkpointed(goals)
        if goals.isEmpty():
            continue
        path = checkpointed(backtracked(labels, goals))
        inner = path.where("edge_id IS NOT NULL").join(roads.select("edge_id", "m", "s", "ac"), "edge_id").select("query", (-F.col("back")).alias("place"), "edge_id", F.col("m").cast("double").alias("meters"), "s", "ac", F.lit(False).alias("leg"))
        at = lambda e, k: nodes.select(F.col("node").alias(e), F.col("lon").alias(f"x{k}"), F.col("lat").alias(f"y{k}"))
        gaps = path.where(F.col("edge_id").startswith(STITCH)).join(at("node", 1), "node").join(at("prev", 2), "prev")
        gap = F.greatest(F.lit(1.0), haversine(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
        track, unknown = classify.SURFACES.index("track"), classify.ACCESSES.index("motorized_unknown")
        across = gaps.select("query", (-F.col("back")).alias("place"), "edge_id", gap.alias("meters"), F.lit(track).alias("s"), F.lit(unknown).alias("ac"), F.lit(True).alias("leg"))
        firsts = path.where("prev IS NULL").join(left.select("query", "start"), "query").select("query", F.lit(-(2**30)).alias("place"), F.col("start.edge_id").alias("edge_id"), F.when(F.col("node") == F.col("start.a"), F.col("start.along")).otherwise(F.greatest(F.lit(0.0), F.col("start.m") - F.col("start.along"))).alias("meters"), F.col("start.s").alias("s"), F.col("start.ac").alias("ac"), F.lit(True).alias("leg"))
        lasts = goals.select("query", F.lit(1).alias("place"), F.col("end.edge_id").alias("edge_id"), "meters", F.col("end.s").alias("s"), F.col("end.ac").alias("ac"), F.col("node").isNotNull().alias("leg"))
        found = checkpointed(firsts.unionByName(inner).unionByName(across).unionByName(lasts).join(goals.select("query", "cost"), "query"))
        pieces = found if pieces is None else pieces.unionByName(found)
        left = checkpointed(left.join(goals.select("query"), "query", "left_anti"))
    failed = missing.unionByName(left.select("query", F.lit("no_route").alias("error")))
    if pieces is None:  # nothing was searched
        pieces = left.select("query", *(F.lit(None).cast(kind).alias(c) for c, kind in (("place", "int"), ("edge_id", "string"), ("meters", "double"), ("s", "int"), ("ac", "int"), ("leg", "boolean"), ("cost", "double")))).limit(0)
    names = pieces.select("query", "place", "edge_id", "meters", classify.code_name(F.col("s"), classify.SURFACES).alias("surface"), classify.code_name(F.col("ac"), classify.ACCESSES).alias("access"), "leg", "cost", F.lit(None).cast("string").alias("error"))
    return names.unionByName(failed, allowMissingColumns=True)


def chains(requests: DataFrame, roads: DataFrame, nodes: DataFrame, avoid: DataFrame | None = None, hubs: bool = False) -> DataFrame:
    """The pieces of routes over several places: requests (query, profile, permissive, unknown, places: points (lon, lat)).

    The hops between neighbouring places of all requests are searched in one batch, from place to place; places take roads
    within 500 metres. (query, hop, place, edge_id, meters, surface, access, leg, cost) in order of hop (from 1) and place; a
    chain with a hop that fails has one row with the first such hop and `error`; so has one of fewer than two places, with hop 0."""
    enough = F.coalesce(F.size("places") >= 2, F.lit(False))
    pairs = F.transform(F.sequence(F.lit(0), F.size("places") - 2), lambda i: F.struct((i + 1).alias("hop"), F.get("places", i).alias("p"), F.get("places", i + 1).alias("q")))
    each = requests.where(enough).select("query", "profile", "permissive", "unknown", F.explode(pairs).alias("h")).select(
        F.struct("query", "h.hop").alias("query"), "profile", "permissive", "unknown", F.col("h.p.lon").alias("start_lon"), F.col("h.p.lat").alias("start_lat"), F.col("h.q.lon").alias("end_lon"), F.col("h.q.lat").alias("end_lat"))
    pieces = checkpointed(routes(checkpointed(each), roads, nodes, avoid, CHAIN_M, hubs).select("query.query", "query.hop", "place", "edge_id", "meters", "surface", "access", "leg", "cost", "error"))
    failed = checkpointed(pieces.where("error IS NOT NULL").groupBy("query").agg(F.min(F.struct("hop", "error")).alias("first")).select("query", "first.hop", "first.error"))
    short = requests.where(~enough).select("query", F.lit(0).alias("hop"), F.lit("chain_failed").alias("error"))
    whole = pieces.join(failed.select("query"), "query", "left_anti")
    return whole.unionByName(failed.unionByName(short), allowMissingColumns=True)


def chain_stats(pieces: DataFrame) -> DataFrame:
    """A row for each chain: status, the hop that failed, metres, seconds and dirt in whole per cent, rolled up from its hops."""
    whole = F.floor(F.col("meters") + 0.5)
    speed = profiles.by_name(F.col("surface"), profiles.SPEED_KMH, 30)
    hops = pieces.groupBy(F.col("query").alias("chain"), "hop").agg(
        F.max(F.col("error").isNull()).alias("ok"), F.sum("meters").alias("meters"), F.sum(F.col("meters") / 1000 / speed * 3600).alias("moving"), F.sum(F.when(F.col("surface") != "paved", whole).otherwise(0)).cast("double").alias("dirt_m"), F.lit(0).alias("from"), F.lit(0).alias("to"))
    return lines.chained(hops)


def route_stats(pieces: DataFrame, rounded: bool = True) -> DataFrame:
    """A row for each route: metres, seconds, cost, and shares by surface and access in whole per cent of the pieces' metres, each rounded
    first unless told otherwise."""
    surface, access, whole = F.col("surface"), F.col("access"), F.floor(F.col("meters") + 0.5) if rounded else F.col("meters")
    speed = profiles.by_name(surface, profiles.SPEED_KMH, 30)
    total = lambda test: F.sum(F.when(test, whole).otherwise(0))
    sums = {"paved": surface == "paved", "gravel": surface == "gravel", "access": surface == "access", "track": surface == "track", "unknown_surface": surface == "unknown", "dirt": surface != "paved",
            "unknown_access": access == "motorized_unknown", "permissive_access": access == "motorized_permissive", "verified_access": access == "motorized_verified"}
    rows = pieces.where("error IS NULL").groupBy("query").agg(F.count("*").alias("pieces"), F.max("cost").alias("cost"), F.sum("meters").alias("meters"), F.sum(F.col("meters") / 1000 / speed * 3600).alias("seconds"), *(total(t).alias(n) for n, t in sums.items()))
    return rows.select("query", "pieces", F.round("cost", 6).alias("cost"), F.round("meters", 2).alias("meters"), F.round("seconds", 1).alias("moving_s"), F.round(F.col("seconds") * 1.15, 1).alias("elapsed_s"), *(percent(F.col(n), F.col("meters")).alias(f"{n}_percent") for n in sums))
