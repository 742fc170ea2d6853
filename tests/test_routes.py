"""Ends brought into one component, stitches, chains of places and way points, against brute force on small networks."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_graphs import metres
from trailframe.functions import classify, profiles
from trailframe.operators import routing, waypoints

ROAD = "edge_id string, seq long, a long, b long, m long, s int, ac int, rt string, src string, component long, line array<struct<lon: double, lat: double>>"
REQUEST = "query long, profile string, permissive boolean, unknown boolean, start_lon double, start_lat double, end_lon double, end_lat double"


def network(spark, places, links):
    """Roads and nodes of places {node: (lon, lat)} and links (a, b, surface, access, component), with a bend in every third road."""
    rows = []
    for k, (a, b, s, ac, component) in enumerate(links):
        (x1, y1), (x2, y2) = places[a], places[b]
        bend = [((x1 + x2) / 2 + 2e-4, (y1 + y2) / 2)] if k % 3 == 0 else []
        line = [places[a], *bend, places[b]]
        m = round(sum(metres(*p, *q) for p, q in zip(line, line[1:])))
        rows.append((f"e-{k}", k, a, b, max(1, m), s, ac, "local", "NSTDB", component, line))
    return spark.createDataFrame(rows, ROAD), spark.createDataFrame([(n, x, y) for n, (x, y) in places.items()], "node long, lon double, lat double"), rows


def near_roads(rows, lon, lat, profile, role, unknown):
    """(score, seq, segment, distance, component, edge) of all segments of open roads."""
    out = []
    for edge, seq, _, _, _, s, ac, _, _, component, line in rows:
        if ac == 3 or ac == 2 and not unknown:
            continue
        for k, ((ax, ay), (bx, by)) in enumerate(zip(line, line[1:])):
            dx, dy = bx - ax, by - ay
            t = min(1.0, max(0.0, ((lon - ax) * dx + (lat - ay) * dy) / (dx * dx + dy * dy)))
            d = metres(lon, lat, ax + dx * t, ay + dy * t)
            paved = profile == "cleanest" or role == "end"
            bias = -22.0 if not paved and s != 0 else -30.0 if paved and s == 0 else 0.0
            out.append((d + bias, seq, k, d, component, edge))
    return out


def taken(found, giant, limit, prefer=None):
    if prefer is None:
        main = min((x for x in found if x[4] == giant and x[3] <= limit), default=None)
        best = main or min(found, default=None)
    else:
        best = min(found, key=lambda x: (x[0] + (1e6 if x[4] != prefer else 0), *x[1:3]), default=None)
    return best if best and best[3] <= limit else None


def brought_together(found, giant, hubs):
    """Match of start and end, one after the other, as the rules say."""
    reach, match = 250.0, {}
    for role in ("start", "end"):
        match[role] = taken(found[role], giant, 250.0)
        if match[role] is None and (wide := taken(found[role], giant, 750.0)):
            match[role], reach = wide, 750.0
    start, end = match["start"], match["end"]
    if start is None or end is None or start[4] == end[4]:
        return start, end
    to = lambda role, c: (x := taken(found[role], giant, reach, c)) and x[4] == c and x or None
    both = to("start", giant), to("end", giant)
    if hubs:
        if x := to("end", start[4]):
            return start, x
        if x := to("start", end[4]):
            return x, end
        return both if all(both) else (start, end)
    if end[4] == giant:
        return to("start", giant) or start, end
    if start[4] == giant:
        return start, to("end", giant) or end
    return both if all(both) else (start, end)


def test_ends_come_into_one_component(spark):
    rng = random.Random(4)
    places, links = {}, []
    for component in range(6):  # pieces of road all over a small area, the first much larger
        node = 100 * component
        for k in range(14 if component == 0 else 4):
            x, y = -63.0 + rng.random() * 0.02, 45.0 + rng.random() * 0.015
            places[node + k] = (x, y)
            if k:
                links.append((node + k - 1, node + k, rng.randrange(4), rng.choice((0, 1, 2)), 100 * component))
    roads, _, rows = network(spark, places, links)
    point = lambda: (-63.005 + rng.random() * 0.03, 44.995 + rng.random() * 0.025)
    asked = [(q, rng.choice(("dirt", "cleanest", "balanced")), True, rng.random() < 0.7, *point(), *point()) for q in range(60)]
    requests = spark.createDataFrame(asked, REQUEST)
    moved = 0
    for hubs in (False, True):
        got = {r.query: r for r in routing.snapped(requests, roads, hubs=hubs).collect()}
        assert len(got) == len(asked)
        for q, profile, _, unknown, *at in asked:
            found = {role: near_roads(rows, *p, profile, role, unknown) for role, p in (("start", at[:2]), ("end", at[2:]))}
            start, end = brought_together(found, 0, hubs)
            r = got[q]
            assert [m and m.edge_id for m in (r.start, r.end)] == [x and x[5] for x in (start, end)], (q, hubs)
            assert all(m is None or math.isclose(m.distance, x[3], rel_tol=1e-6, abs_tol=1e-6) for m, x in ((r.start, start), (r.end, end)))
            moved += start != taken(found["start"], 0, 250.0) or end != taken(found["end"], 0, 250.0)
    assert moved > 10


def island(spark):
    """A main road along a parallel with a side road, and an island north of it whose nearest node is 50 metres off."""
    places = {k: (-63.0 + 0.001 * k, 45.0) for k in range(12)} | {20: (-62.996, 45.00045), 21: (-62.996, 45.004), 22: (-62.996, 45.009), 23: (-62.999, 45.012)}
    links = [(k, k + 1, 1, 1, 0) for k in range(11)] + [(20, 21, 3, 2, 20), (21, 22, 3, 2, 20), (22, 23, 3, 2, 20)]
    return network(spark, places, links)


def test_an_island_is_left_by_a_stitch_only(spark, monkeypatch):
    roads, nodes, _ = island(spark)
    at = (-62.999, 45.0121, -62.9905, 45.0001)
    requests = spark.createDataFrame([(1, "dirt", True, True, *at), (2, "cleanest", True, True, *at), (3, "balanced", True, False, *at)], REQUEST)
    out = routing.routes(requests, roads, nodes).orderBy("query", "place").collect()
    one = [r for r in out if r.query == 1]
    assert [r.edge_id for r in one if r.edge_id.startswith(routing.STITCH)] == ["soft-stitch-4:20"]
    (gap,) = (r for r in one if r.edge_id == "soft-stitch-4:20")
    assert math.isclose(gap.meters, metres(-62.996, 45.00045, -62.996, 45.0), rel_tol=1e-9) and gap.leg and (gap.surface, gap.access) == ("track", "motorized_unknown")
    assert {r.query: r.error for r in out if r.error} == {2: "no_route", 3: "match_failed"}
    joins = {(r["from"], r["to"]): r.price for r in routing.stitched(routing.snapped(requests.where("query = 1"), roads), roads, nodes, F.lit(0)).collect()}
    assert set(joins) == {(20, 4), (4, 20)} and all(p >= 12 * gap.meters / 1000 - 1e-12 for p in joins.values())
    none = routing.stitched
    monkeypatch.setattr(routing, "stitched", lambda *a: none(*a).limit(0))
    assert {r.query: r.error for r in routing.routes(requests, roads, nodes).collect()} == {1: "no_route", 2: "no_route", 3: "match_failed"}


def cheapest(match, rows, places):
    """The cost of the cheapest way between two matches over all open roads, by a heap."""
    s, e, profile, unknown = (match.start.x, match.start.y), (match.end.x, match.end.y), match.profile, match.unknown
    direct = metres(*s, *e)

    def away_price(at, to, prices, near_m, share, least):
        before = metres(*at, *e)
        away = metres(*to, *e) - before
        return (away / 1000 * prices[0 if before < max(near_m, direct * share) else 1]) if away > least else 0.0

    def step(m, surface, rt, access, at, to):
        cost = m / 1000 * profiles.SURFACE_WEIGHTS[profile][surface] * dict(zip(profiles.CLASSES, profiles.CLASS_WEIGHTS[profile]))[rt]
        if unknown and profile != "cleanest":
            cost *= profiles.UNKNOWN_FACTOR[profile] if access == "motorized_unknown" else 1.0
            cost *= profiles.PROVINCIAL_FACTOR[profile]  # all roads are of a provincial source
            cost *= {"paved": 0.9, "gravel": 1.06, "access": 1.06, "track": 1.06}.get(surface, 1.0) if profile == "balanced" else 1.0
        return cost + away_price(at, to, profiles.AWAY_PRICE[profile], 2800.0, 0.28, 50)

    def leg(m, at, to):
        if profile == "cleanest":
            return m / 1000
        return m / 1000 + away_price(at, to, (profiles.ACCESS_AWAY_PRICE[profile], 0.0), 3500.0, 0.3, 60)

    around = {}
    for _, _, a, b, m, sf, ac, rt, _, _, _ in rows:
        if ac == 3 or ac == 2 and not unknown:
            continue
        for u, v in ((a, b), (b, a)):
            around.setdefault(u, []).append((v, step(m, classify.SURFACES[sf], rt, classify.ACCESSES[ac], places[u], places[v])))
    ways = lambda m: ((m.a, m.along), (m.b, max(0.0, m.m - m.along)))
    heap, cost = [(leg(d, s, places[v]), v) for v, d in ways(match.start)], {}
    heapq.heapify(heap)
    while heap:
        c, v = heapq.heappop(heap)
        if v not in cost:
            cost[v] = c
            for u, price in around.get(v, []):
                heapq.heappush(heap, (c + price, u))
    best = min(cost[v] + leg(d, places[v], e) for v, d in ways(match.end))
    if match.start.edge_id == match.end.edge_id:
        m = abs(match.start.along - match.end.along)
        best = min(best, step(m, classify.SURFACES[match.start.s], "unknown", classify.ACCESSES[match.start.ac], s, e))
    return best


def test_chains_are_their_hops(spark):
    rng = random.Random(9)
    places = {10 * y + x: (-63.0 + 0.004 * x, 45.0 + 0.003 * y) for x in range(6) for y in range(6)}
    links = [(n, n + d, rng.randrange(4), rng.choice((0, 1, 1, 2)), 0) for n in places for d in (1, 10) if n + d in places]
    roads, nodes, rows = network(spark, places, links)
    spot = lambda: (-63.0 + rng.random() * 0.02, 45.0 + rng.random() * 0.015)
    asked = [(q, ("dirt", "balanced", "direct")[q % 3], True, q % 2 == 0, [spot() for _ in range(3 + q % 2)]) for q in range(5)]
    asked += [(10, "dirt", True, True, [spot(), spot(), (-64.0, 44.0), spot()]), (11, "dirt", True, True, [spot()]), (12, "dirt", True, True, None)]
    requests = spark.createDataFrame(asked, "query long, profile string, permissive boolean, unknown boolean, places array<struct<lon: double, lat: double>>")
    out = routing.chains(requests, roads, nodes)
    pieces, failed = {}, {}
    for r in out.collect():
        if r.error:
            failed[r.query] = (r.hop, r.error)
        else:
            pieces.setdefault((r.query, r.hop), []).append(r)
    assert failed == {10: (2, "match_failed"), 11: (0, "chain_failed"), 12: (0, "chain_failed")}
    hops = [((q, h + 1), profile, p, u, *places_[h], *places_[h + 1]) for q, profile, p, u, places_ in asked if q < 10 for h in range(len(places_) - 1)]
    assert set(pieces) == {h[0] for h in hops}
    single = spark.createDataFrame([(100 * q + h, *rest) for (q, h), *rest in hops], REQUEST)
    for m in routing.snapped(single, roads, limit=routing.CHAIN_M).collect():
        rows_of = pieces[divmod(m.query, 100)]
        want = cheapest(m, rows, places)
        ellipse = rows_of[0].cost  # a bounded search may cost more than the best of all ways, never less
        assert ellipse >= want - 1e-9 and (math.isclose(ellipse, want, rel_tol=1e-9) or profiles.ELLIPSE[m.profile] < 2), m.query
    stats = {r.chain: r for r in routing.chain_stats(out).collect()}
    for q, *_, places_ in asked[:5]:
        assert stats[q].status == "ok" and stats[q].hops == len(places_) - 1
        assert math.isclose(stats[q].meters, sum(r.meters for (c, _), rs in pieces.items() if c == q for r in rs), rel_tol=1e-9)
    assert stats[10].status == "chain_hop_failed" and stats[10].failed_hop == 2


@pytest.mark.parametrize("mode", ["chain", "clip", None])
def test_way_points_edge_cases(spark, mode):
    rows = [(1, "dirt", [(-63.0, 45.0)]), (2, "dirt", None), (3, "dirt", [(-63.0, 45.0), (float("nan"), 1.0), (-62.0, 45.1)]), (4, "dirt", [(-72.0, 46.0), (-68.9, 48.0)]), (5, "clean", [(-63.5, 44.7), (-123.2, 49.2)]), (6, "dirt", [(-60.0, 10.0), (-70.0, 10.0)]), (7, "dirt", [(-110.0, 50.0), (-70.0, 46.9), (-60.0, 46.0)])]
    out = {r.query: r.points for r in waypoints.way_points(spark.createDataFrame(rows, "query long, profile string, places array<struct<lon: double, lat: double>>"), mode).collect()}
    assert [len(out[q]) for q in (1, 2, 3, 4, 7)] == [1, 0, 2, 2, 3]
    assert len(out[5]) > 15 and out[5][0].lon == -63.5 and out[5][-1].lon == -123.2 and [p.lon for p in out[5]] == sorted((p.lon for p in out[5]), reverse=True)
    assert len(out[6]) == (2 if mode != "clip" else 7)  # two samples and three places of the table


def test_stage_edits_as_one_after_another(spark):
    """The log of all events, replayed by a loop."""
    from tests.test_queries import SF
    from trailframe.plans import edit_queries

    log = {}
    for r in edit_queries.edit_log(spark, SF).collect():
        log.setdefault(r.trip, []).append(r)
    point = lambda p: p and (p.lng, p.lat)
    new = lambda i, profile, start, end: {"id": i, "profile": profile, "start": start, "end": end, "route": None}
    want, kinds = {}, set()
    for trip, events in log.items():
        stages = [new("first", "balanced", None, None)]

        def begin(k, start):
            stages[k] = stages[k] | {"start": start, "route": None}  # noqa: B023

        def add(i, profile, start, end):
            stages.append(new(i, profile or "balanced", start or stages[-1]["end"], end))  # noqa: B023

        for e in sorted(events, key=lambda e: e.seq):
            k = next((k for k, s in enumerate(stages) if s["id"] == e.stage), None)
            before = list(stages)
            if e.kind == "add":
                add(e.stage, e.profile, point(e.start), point(e.end))
            elif e.kind == "move":
                if e["from"] in range(len(stages)) and e.to in range(len(stages)) and e["from"] != e.to:
                    stages.insert(e.to, stages.pop(e["from"]))
            elif k is None:
                continue
            elif e.kind == "remove" and len(stages) > 1:
                stages.pop(k)
            elif e.kind == "remove-waypoint" and len(stages) > 1 and stages[k]["start"] and stages[k]["end"]:
                if k + 1 < len(stages):
                    begin(k + 1, stages[k]["start"])
                stages.pop(k)
                for i in range(max(1, k), len(stages)):
                    end = stages[i - 1]["end"]
                    if end and stages[i]["start"] != end:
                        begin(i, end)
                if stages[-1]["start"] and stages[-1]["end"]:
                    add(f"draft-{e.seq}", stages[-1]["profile"], None, None)
            elif e.kind == "set-start":
                begin(k, point(e.start))
            elif e.kind == "set-end":
                stages[k] = stages[k] | {"end": point(e.end), "route": None}
            elif e.kind == "route-success":
                stages[k] = stages[k] | {"route": e.route or stages[k]["route"]}
            elif e.kind == "invalidate":
                stages[k] = stages[k] | {"route": None}
            if stages != before:
                kinds.add(e.kind)
        for place, s in enumerate(stages):
            status = "draft" if not (s["start"] and s["end"]) else "complete" if s["route"] else "ready"
            want[trip, place] = (s["id"], s["profile"], *(s["start"] or (None, None)), *(s["end"] or (None, None)), s["route"], status)
    got = {(r.trip, r.place): tuple(r)[2:] for r in edit_queries.x03_edits(spark, SF).collect()}
    assert got == want and kinds == set(edit_queries.KINDS)
