"""Paths that settle block by block are those of a search over the whole graph."""

import heapq
import random

from pyspark.sql import functions as F

from trailframe.operators import graph


def _heap(arcs, start):
    around, want, heap = {}, {}, [(0, start)]
    for a, b, w in arcs:
        around.setdefault(a, []).append((b, w)), around.setdefault(b, []).append((a, w))
    while heap:
        c, v = heapq.heappop(heap)
        if v not in want:
            want[v] = c
            for u, d in around.get(v, []):
                heapq.heappush(heap, (c + d, u))
    return want


def test_rounds_do_not_grow_with_a_long_road(spark):
    road = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(2).alias("m"))
    got = graph.shortest_paths(road, spark.createDataFrame([("q", 0)], "query string, node long"), F.col("m"), max_rounds=8)
    assert {(r.node, r.cost) for r in got.collect()} == {(k, 2 * k) for k in range(3001)}


def test_paths_over_many_blocks(spark):
    rng = random.Random(3)
    arcs = [(k, k + step, rng.randint(0, 40)) for k in range(90) for step in (1, 7) if rng.random() < 0.9] + [(5, 5, 1), (80, 2, 0)]
    edges = spark.createDataFrame(arcs, "a long, b long, m long")
    starts = spark.createDataFrame([("p", 0), ("q", 60), ("q", 3)], "query string, node long")
    got = {(r.query, r.node): r.cost for r in graph.shortest_paths(edges, starts, F.col("m"), size=16).collect()}
    q = [_heap(arcs, s) for s in (60, 3)]
    want = {("p", v): c for v, c in _heap(arcs, 0).items()} | {("q", v): min(d[v] for d in q if v in d) for v in {*q[0], *q[1]}}
    assert got == want


def test_requests_that_no_open_road_joins_are_told_without_a_search(spark):
    from trailframe.operators import routing

    end = lambda a, b: {"a": a, "b": b}
    row = lambda q, unknown, s, e: (q, True, unknown, end(*s), end(*e))
    asked = spark.createDataFrame([row(1, True, (0, 1), (2, 3)), row(2, False, (0, 1), (2, 3)), row(3, True, (0, 1), (7, 8)), row(4, True, (0, 1), (5, 6)), row(5, False, (8, 8), (8, 7))], "query long, permissive boolean, unknown boolean, start struct<a: long, b: long>, end struct<a: long, b: long>")
    ac = {"verified": 0, "unknown": 2}
    roads = spark.createDataFrame([(0, 1, ac["verified"], "x"), (1, 2, ac["unknown"], "x"), (2, 3, ac["verified"], "x"), (5, 6, ac["unknown"], "x"), (7, 8, ac["verified"], "x")], "a long, b long, ac int, src string")
    joins = spark.createDataFrame([(4, 3, 5), (4, 5, 3)], "query long, from long, to long")
    assert {r.query for r in routing.unreachable(asked, roads, joins).collect()} == {2, 3}
