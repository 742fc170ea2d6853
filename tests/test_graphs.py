"""Operators whose results follow an order, against brute force: snapped ends, conflation, routes, roadbooks, riders."""

import heapq
import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF
from trailframe.functions import profiles
from trailframe.operators import conflation, regional, roadbook, routing
from trailframe.plans import graph_queries, live_queries
from trailframe.streaming import riders


def metres(x1, y1, x2, y2):
    a, b, c, d = map(math.radians, (y1, y2, y2 - y1, x2 - x1))
    h = math.sin(c / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(d / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_ends_snap_as_in_order(spark):
    rng = random.Random(2)
    rows = [(-6600000 + rng.randrange(120), 4400000 + rng.randrange(120), seq, end, seq >= 30) for seq in range(90) for end in (0, 1)]
    got = {(r.x, r.y): r.owner for r in regional.snapped_ends(spark.createDataFrame(rows, "x long, y long, seq long, end int, side boolean")).collect()}
    places, owner = [], {}
    for x, y, seq, end, side in sorted(rows, key=lambda r: (r[4], r[2], r[3])):
        if (x, y) in owner:
            continue
        k = len(places)
        places.append((x, y))
        near = [(metres(x / 1e5, y / 1e5, a / 1e5, b / 1e5), i) for i, (a, b) in enumerate(places[:-1]) if owner[a, b] == i]
        best = min((n for n in near if n[0] <= 18.0), default=None) if side else None
        owner[x, y] = best[1] if best else k
    assert got == owner


def test_conflation_as_in_order(spark):
    base, sup = graph_queries._surfaced(spark, SF)
    lines = {r.key: r for r in base.unionByName(sup).collect()}
    near = lambda a, b: metres(a.x2 / 1e5, a.y2 / 1e5, b.x2 / 1e5, b.y2 / 1e5) <= 28 and min(d := abs(fold(a) - fold(b)), 180 - d) <= 28
    fold = lambda r: math.degrees(math.atan2(r.y2 - r.y1, r.x2 - r.x1)) % 180
    kept, surface, want = sorted(k for k in lines if k % 2 == 0), {k: r.surface for k, r in lines.items()}, {}
    for k in sorted(k for k in lines if k % 2):
        twin = next((b for b in kept if near(lines[k], lines[b])), None)
        if twin is None:
            kept.append(k)
            continue
        want[k] = twin
        if surface[twin] == "unknown" and lines[k].surface in ("paved", "gravel", "resource"):
            surface[twin] = lines[k].surface
    got = {r.key: r for r in conflation.resolved(base, sup).collect()}
    assert {k: r.duplicate_of for k, r in got.items() if r.role == "duplicate"} == want
    assert all(got[k].surface == surface[k] for k in kept)


def test_routes_cost_what_a_heap_search_finds(spark):
    roads, nodes = graph_queries.roads(spark, SF)
    asked = routing.checkpointed(routing.snapped(graph_queries.requests(spark, SF), roads))
    out = routing.routes(graph_queries.requests(spark, SF), roads, nodes).collect()
    pieces, failed = {}, {r.query for r in out if r.error}
    for r in sorted((r for r in out if not r.error), key=lambda r: (r.query, r.place)):
        pieces.setdefault(r.query, []).append(r)
    matches = {r.query: r for r in asked.collect()}
    assert set(matches) == set(pieces) | failed and failed == {q for q, r in matches.items() if r.start is None or r.end is None}
    every = routing.checkpointed(routing.priced(asked.where("start IS NOT NULL AND end IS NOT NULL"), roads, nodes, 1.6)).collect()
    legs = {role: routing._legs(asked.where("start IS NOT NULL AND end IS NOT NULL"), nodes, role).collect() for role in ("start", "end")}
    around = {}
    for r in every:
        around.setdefault((r["query"], r["from"]), []).append((r["to"], r["price"]))
    at = {r.node: (r.lon, r.lat) for r in nodes.collect()}
    for q in pieces:
        m = matches[q]
        s, e = (m.start.x, m.start.y), (m.end.x, m.end.y)
        most = profiles.ELLIPSE[m.profile] * metres(*s, *e) * (1 + 1e-7)
        inside = lambda v: metres(*s, *at[v]) + metres(*at[v], *e) <= most  # noqa: B023, E731
        heap, cost = [(r.cost, r.node) for r in legs["start"] if r.query == q], {}
        heapq.heapify(heap)
        while heap:
            c, v = heapq.heappop(heap)
            if v not in cost:
                cost[v] = c
                for u, price in around.get((q, v), []):
                    if inside(u):
                        heapq.heappush(heap, (c + price, u))
        best = min((cost[r.node] + r.cost for r in legs["end"] if r.query == q and r.node in cost), default=None)
        if best is not None and m.start.edge_id != m.end.edge_id:  # others took a wider ellipse, or stay on one road
            sane = profiles.greatest_weight(m.profile) * most / 1000 * 2.5
            assert best > sane or math.isclose(pieces[q][0].cost, best, rel_tol=1e-9), q
    stats = {r.query: r for r in routing.route_stats(spark.createDataFrame([r for r in out if not r.error], routing.routes(graph_queries.requests(spark, SF).limit(0), roads, nodes).schema)).collect()}
    for q, rows in pieces.items():
        assert math.isclose(stats[q].meters, sum(r.meters for r in rows), abs_tol=0.01) and stats[q].pieces == len(rows)


def test_curves_of_an_arc(spark):
    def arc(route, degrees, radius):
        x, y, way, rows = -63.3, 44.7, 0.0, []
        for k in range(60):
            rows.append((route, k, x, y))
            way += math.radians(degrees) / 20 if 20 <= k < 40 else 0.0
            step = radius * math.radians(abs(degrees)) / 20 if 20 <= k < 40 else 12.0
            x, y = x + step * math.sin(way) / (111320 * math.cos(math.radians(44.7))), y + step * math.cos(way) / 111320
        return rows

    points = spark.createDataFrame([*arc(1, 90, 80), *arc(2, -170, 18), *arc(3, 4, 400)], "route long, i long, lon double, lat double")
    out = {r.route: r for r in roadbook.curves(points).collect()}
    assert set(out) == {1, 2} and out[1].side == "right" and out[2].side == "left"
    assert abs(out[1].degrees - 90) < 8 and out[2].number < out[1].number
    cues = spark.createDataFrame([(1, 100.0, "left", 4, 30.0), (1, 130.0, "left", 3, 40.0), (1, 300.0, "right", 5, 20.0)], "route long, along_m double, side string, number int, degrees double")
    assert [(r.along_m, r.number) for r in roadbook.pruned(cues.select("route", "along_m", "side", "number", "degrees")).orderBy("along_m").collect()] == [(130.0, 3), (300.0, 5)]
    turns = spark.createDataFrame([(1, 310.0, "left", 50.0), (1, 350.0, "right", 80.0)], "route long, along_m double, side string, degrees double")
    assert [(r.along_m, r.kind) for r in roadbook.merged_cues(cues, turns).orderBy("along_m").collect()] == [(130.0, "curve"), (350.0, "junction")]


def test_curve_spans_as_point_by_point():
    rng = np.random.default_rng(4)
    for _ in range(200):
        rate = np.round(np.cumsum(rng.normal(0, 0.5, 80)) * rng.choice([0, 1, 1], 80), 3)
        rate[0], i, want = 0.0, 1, []
        while i < len(rate):
            if abs(rate[i]) < 1.0:
                i += 1
                continue
            sign, first, last, total, others = np.sign(rate[i]), i, i, 0.0, 0
            while i < len(rate) and others <= 2:
                if np.sign(rate[i]) == sign and abs(rate[i]) >= 0.18:
                    total, last, others = total + abs(rate[i]), i, 0
                else:
                    others += 1
                i += others <= 2
            want.append((first, last, round(sign * total, 6)))
        assert [(a, b, round(t, 6)) for a, b, _, _, t in roadbook.curve_spans(rate)] == want


def test_riders_over_a_stream_end_as_in_the_log(spark, tmp_path):
    log = live_queries.updates(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {r.user_id: tuple(r)[1:] for r in riders.riders_known(log, F.lit(7)).drop("label").collect()}
    cuts = [r.ts for r in log.select("ts").orderBy("ts").collect()]
    bounds = [None, cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3], None]
    for k in range(3):
        part = log.where(F.lit(True) if bounds[k] is None else F.col("ts") > bounds[k]).where(F.lit(True) if bounds[k + 1] is None else F.col("ts") <= bounds[k + 1])
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = riders.riders_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), F.lit(7))
    seen = {}

    def take(rows, _):
        for r in rows.collect():
            seen[r.user_id] = tuple(r)[2:] if r.known else None

    query = stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {u: v for u, v in seen.items() if v is not None} == want


@pytest.mark.parametrize("kind,old,want", [("off", True, None), ("presence", False, None), ("presence", True, 1.0), ("location", True, 1.0), ("database", True, None)])
def test_updates_without_a_place(kind, old, want):
    state = {"lng": 1.0, "lat": 2.0, "heading": None, "status": "stuck", "name": "Ann", "group_id": "g"} if old else None
    new = {"kind": kind, "lng": None, "lat": None, "heading": -90.0, "status": None, "name": None, "group_id": None, "sharing": False}
    out = riders.applied(state, new)
    assert (out and out["lng"]) == want


def test_entry_without_the_training_data_folder(tmp_path):
    """On a copy without it, the other queries are there."""
    import pathlib
    import shutil

    root = pathlib.Path(__file__).parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "trailframe", tmp_path / "trailframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'RSP1_shortest_paths' in e.queries(), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.split()[2:] == ["True", "False"]
    shutil.copy(root / "tests" / "conftest.py", tmp_path / "corpus_pipeline.py")  # a pipeline whose folder is gone counts as gone, too
    assert run().stdout.split()[2:] == ["True", "False"]
