"""Every registered query with SQL gives what DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from trailframe.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def same(spark, query, sql, sf=SF):
    db = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got = query(spark, sf)
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple((x is None or isinstance(x, float) and math.isnan(x), str(x)) for x in row)
    return sorted((tuple(r[c] for c in names) for r in got.collect()), key=key), sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    got, want = same(spark, QUERIES[name], ORACLE_SQL[name])
    assert got == want


def test_paths_reach_all_nodes(spark):
    import heapq

    from trailframe.plans.queries import CLASS_PERCENT, SURFACE_PERCENT
    from trailframe.sources.network import edges

    around = {}
    for r in edges(spark, SF).where("ac IN (0, 1)").collect():
        c = r.m * SURFACE_PERCENT[r.s] * CLASS_PERCENT[r.rt]
        around.setdefault(r.a, []).append((r.b, c)), around.setdefault(r.b, []).append((r.a, c))
    want = {}
    for q, start in (("first", 0), ("second", 75)):
        heap = [(0, start)]
        while heap:
            c, v = heapq.heappop(heap)
            if (q, v) not in want:
                want[q, v] = c
                for u, d in around.get(v, []):
                    heapq.heappush(heap, (c + d, u))
    got = {(r.query, r.node): r.cost for r in QUERIES["RSP1_shortest_paths"](spark, SF).collect()}
    assert got == want


def test_whole_network_queries_see_all_edges(spark):
    from trailframe.sources.network import edges

    all_edges = edges(spark, SF).select("edge_id", "seq", "a", "b").collect()
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for r in all_edges:
        if r.a != r.b:
            x, y = sorted((top(r.a), top(r.b)))
            up[y] = x
    assert {(r.node, r.component) for r in QUERIES["RCC_components"](spark, SF).collect()} == {(v, top(v)) for v in up}
    assert QUERIES["J14_compact"](spark, SF).count() == len(all_edges)
    base = {r.base_key for r in QUERIES["J01_near_duplicates"](spark, SF).select("base_key").collect()}
    assert {k % 10 for k in base} - {0} and base <= {r.seq for r in all_edges}


def test_components_of_many_parts(spark):
    """A sparse network, long chains against the order of the names, and a hub, against a union-find."""
    import random

    from trailframe.operators.components import connected_components
    from trailframe.operators.graph import component_stats

    rng = random.Random(6)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(150)] + [(3000 - i, 2999 - i) for i in range(150)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7)]
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in pairs:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, m long")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(v, top(v)) for v in up}
    stats = {r.component: r.nodes for r in component_stats(edges).collect()}
    assert stats == {c: sum(top(v) == c for v in up) for c in {top(v) for v in up}}


def test_kilometres_round_the_exact_value(spark):
    """All metres up to 40 kilometres: the nearest decimal to the double, the larger of two as near."""
    from decimal import ROUND_HALF_UP, Decimal

    from pyspark.sql import functions as F

    from trailframe.functions.labels import km_label

    got = {r.m: r.label for r in spark.range(40_000).select(F.col("id").alias("m"), km_label(F.col("id").cast("double")).alias("label")).collect()}
    want = lambda m: f"{m} m" if m < 1000 else f"{Decimal(m / 1000).quantize(Decimal('0.1' if m >= 10_000 else '0.01'), ROUND_HALF_UP)} km"
    assert got == {m: want(m) for m in range(40_000)}
    assert got[8815] == "8.81 km" and got[9625] == "9.63 km"
