"""What large tables need: work dealt to all cores, code that the JVM compiles, few copies of rows."""

import re

from pyspark.sql import functions as F

from tests.test_queries import SF
from trailframe.functions import profiles
from trailframe.operators import extracts, regional, waypoints
from trailframe.plans import chain_queries, graph_queries


def test_ways_are_dealt_to_all_cores(spark):
    """Their table is one small file, whatever its number of rows."""
    for mode in ("chain", "clip"):
        assert waypoints.way_points(chain_queries._long_ways(spark, SF), mode).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_samples_read_lengths_that_are_there(spark, capsys):
    """Each box of a town would work out the way's length for each sample."""
    waypoints.way_points(chain_queries._long_ways(spark, SF), "clip").explain()
    assert "ATAN2" not in capsys.readouterr().out.upper()


def test_fixed_places_are_moved_as_columns_are(spark):
    places = [(box[2] + 0.01, box[0] + 0.01) for box in profiles.TOWNS] + list(waypoints.KEEPERS)
    got = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "k int, lon double, lat double").select("k", profiles.nudged_off_towns(F.col("lon"), F.col("lat")).alias("lat")).collect()
    assert {r.k: r.lat for r in got} == {k: profiles.moved_off_towns(*p) for k, p in enumerate(places)}


def test_code_of_step_costs_is_compiled(spark, capsys):
    """The JVM runs methods of 8000 bytes or more uncompiled, some ten times slower."""
    c = F.col
    rows = spark.range(10).selectExpr("id * 1.5D as m", "string(id) as s", "string(id + 1) as rt", "string(id + 2) as ac", "id > 1 as provincial", "string(id + 3) as profile", "id > 2 as unknown", "id > 3 as leg", "id > 4 as stitch", "id + 0.5D as _before", "id + 0.7D as _after", "id + 0.9D as _direct", "id > 5 as _town")
    rows.select(profiles.step_cost(c("m"), c("s"), c("rt"), c("ac"), c("provincial"), c("profile"), c("unknown"), c("leg"), c("stitch"))).explain("codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))) < 8000


def test_nodes_of_a_graph_need_no_components(spark, monkeypatch):
    want = {tuple(r) for r in regional.build(graph_queries.features(spark, SF))[0].collect()}
    monkeypatch.setattr(regional, "connected_components", None)
    assert {tuple(r) for r in graph_queries.rbld_nodes(spark, SF).collect()} == want


def test_points_ask_few_blocks_and_meet_all_near_cells(spark, monkeypatch):
    """A point that asks every cell around it is shuffled 9, 25 or 49 times."""
    points = [(k, k * 37 % 211 - 90, k * 53 % 197 - 90) for k in range(120)]
    left = spark.createDataFrame(points, "a int, x long, y long")
    right = spark.createDataFrame(points, "b int, x2 long, y2 long")
    cell, asked, join = lambda c, size: c // size, [], type(left).join
    monkeypatch.setattr(type(left), "join", lambda self, *a, **k: (asked.append(self), join(self, *a, **k))[1])
    for reach in (1, 2, 3):
        got = {(r.a, r.b) for r in regional.near_pairs(left, right, 1e9, 20, reach).collect()}
        assert got == {(a, b) for a, x, y in points for b, x2, y2 in points if abs(cell(x, 20) - cell(x2, 20)) <= reach and abs(cell(y, 20) - cell(y2, 20)) <= reach}
        assert asked.pop().count() <= 4 * len(points)


def test_pairs_of_decided_places_are_not_carried_on(spark, monkeypatch):
    """All but the first place of a star go in the first round; nothing but its pairs, as given, has more rows than their places."""
    stored, keep = [], regional.checkpointed
    monkeypatch.setattr(regional, "checkpointed", lambda df: (stored.append(keep(df)), stored[-1])[1])
    pairs = spark.createDataFrame([(i, j, float(j)) for i in range(1, 30) for j in range(i)], "place long, other long, meters double")
    got = {r.place: (r.owner, r.meters) for r in regional.settle(spark.range(30).toDF("place"), pairs).collect()}
    assert got == {0: (0, 0.0)} | {i: (0, 0.0) for i in range(1, 30)}
    assert sorted(df.count() for df in stored)[-2] <= 29
