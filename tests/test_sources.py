"""Feature files, and stage states against a fold in order."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from trailframe.functions import source_rules
from trailframe.operators import stages
from trailframe.sources import files

LINE = {"type": "Feature", "properties": {"ROADCLASS": "Local"}, "geometry": {"type": "LineString", "coordinates": [[-63.123456, 44.1], [-63.123458, 44.1], [-63.2, 44.2]]}}
MANY = {"type": "Feature", "properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [0.000001, 0]], [[1, 1], [2, 2]]]}}


@pytest.mark.parametrize("lead, separator", [("\x1e", None), ("\x1e", "\x1e"), ("", None)])
def test_sequence(spark, tmp_path, lead, separator):
    (tmp_path / "a.geojsonl").write_text(f"{lead}{json.dumps(LINE)}\n\n{lead}{{broken\n{lead}{json.dumps(MANY)}\n")
    rows = files.read_sequence(spark, str(tmp_path), separator)
    assert sorted((r.reason or "") for r in rows.collect()) == ["", "", "invalid_json"]
    parts = files.line_parts(rows.where("reason IS NULL")).collect()
    assert sorted((r.part, [list(p) for p in r.line]) for r in parts) == [(0, [[-63.12346, 44.1], [-63.2, 44.2]]), (1, [[1.0, 1.0], [2.0, 2.0]])]
    kinds = rows.where("reason IS NULL").select(source_rules.inventory_road(lambda n: F.col("properties")[n]).alias("r")).select("r.road_class")
    assert sorted(r.road_class for r in kinds.collect()) == ["local", "unknown"]


def test_collections_and_chunks(spark, tmp_path):
    for name in ("a", "b"):
        with gzip.open(tmp_path / f"{name}.geojson.gz", "wt") as f:
            json.dump({"type": "FeatureCollection", "features": [LINE, MANY]}, f)
    rows = files.read_collections(spark, f"{tmp_path}/*.geojson.gz")
    assert rows.count() == 4
    lines = files.line_parts(rows)
    files.write_chunks(lines, f"{tmp_path}/chunks", 0.4)
    again = spark.read.json(f"{tmp_path}/chunks")
    assert {(r.chunk_id, r["count"]) for r in again.groupBy("chunk_id").count().collect()} == {("-158_110", 2), ("2_2", 2)}
    files.write_audit(rows.withColumn("reason", F.lit("kept")), f"{tmp_path}/audit")
    assert spark.read.json(f"{tmp_path}/audit").count() == 4


def test_tracks(spark, tmp_path):
    point = lambda lat, lon: f'<trkpt lat="{lat}" lon="{lon}"><ele>5</ele></trkpt>'
    (tmp_path / "t.gpx").write_text(f'<gpx><trk><name>x</name><trkseg>{point(44, -63)}{point(44, -63.001)}{point("bad", 1)}{point(95, 1)}</trkseg><trkseg>{point(1, 1)}</trkseg><trkseg>{point(45, -63)}{point(45, -63)}</trkseg></trk></gpx>')
    (tmp_path / "r.gpx").write_text('<gpx><rte><name>y</name><rtept lat="1" lon="1"/><rtept lat="1" lon="2"/></rte></gpx>')
    got = {r.file.rsplit("/", 1)[1]: r for r in files.track_summary(files.read_tracks(spark, str(tmp_path))).collect()}
    assert got["t.gpx"].points == 4 and got["t.gpx"].lat_max == 45 and abs(got["t.gpx"].meters - 79.99) < 0.1
    assert got["r.gpx"].points == 2 and abs(got["r.gpx"].meters - 111178) < 20


def folded(events):
    s = {"start": None, "end": None, "route": None, "error": None, "loading": False}
    for _, kind, start, end, route in sorted(events):
        if kind not in stages.KINDS:
            continue
        s["error"], s["loading"] = None, kind == "route-start"
        if kind in stages.CLEARING:
            s["route"] = None
        if kind == "set-start" or kind == "set-points" and start:
            s["start"] = start
        if kind == "set-end" or kind == "set-points" and end:
            s["end"] = end
        if kind == "route-success":
            s["route"] = route or s["route"]
        if kind == "route-failed":
            s["error"] = "x"
    draft = s["start"] is None or s["end"] is None
    return "draft" if draft else "loading" if s["loading"] else "failed" if s["error"] else "complete" if s["route"] else "ready", s["start"], s["end"], s["route"]


def test_stage_states(spark):
    r = random.Random(7)
    events = {k: [(i, r.choice([*stages.KINDS, "other"]), r.choice([None, f"s{i}"]), r.choice([None, f"e{i}"]), r.choice([None, f"r{i}"])) for i in range(r.randint(1, 9))] for k in range(300)}
    rows = spark.createDataFrame([(k, *e) for k, es in events.items() for e in es], "stage long, seq long, kind string, start_point string, end_point string, route string")
    got = {x.stage: (x.status, x.start_point, x.end_point, x.route) for x in stages.stage_states(rows).collect()}
    assert got == {k: folded(es) for k, es in events.items() if any(e[1] in stages.KINDS for e in es)}


def test_components_of_long_chains(spark):
    from trailframe.operators.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(1000, 900), (None, 5), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(151)} | {900: 900, 1000: 900}


@pytest.mark.parametrize("style,counts", [("esri", True), ("socrata", True), ("wfs", False), ("esri", False)])
def test_paged_services(spark, style, counts):
    """A service of 23 features in pages of 5, which fails at first; with and without a count."""
    import http.server
    import json as js
    import threading
    import urllib.parse

    from trailframe.sources import paged

    names = {"esri": ("resultOffset", "resultRecordCount"), "socrata": ("$offset", "$limit"), "wfs": ("startIndex", "count")}[style]
    failed = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            if "returnCountOnly" in q or "$select" in q or "resultType" in q:
                body = ([{"count": "23"}] if style == "socrata" else {"count": 23}) if counts else {"error": 1}
            elif not failed:
                failed.append(1)
                self.send_error(503)
                return
            else:
                at, n = int(q[names[0]]), int(q[names[1]])
                line = [[0, 0], [1, 1]]
                one = {"esri": lambda i: {"attributes": {"id": i}, "geometry": {"paths": [line]}}, "socrata": lambda i: {"id": str(i), "the_geom": {"type": "LineString", "coordinates": line}},
                       "wfs": lambda i: {"type": "Feature", "properties": {"id": i, "none": None}, "geometry": {"type": "LineString", "coordinates": line}}}[style]
                rows = [one(i) for i in range(at, min(at + n, 23))]
                body = rows if style == "socrata" else {"features": rows}
            data = js.dumps(body).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(paged.PagedFeatures)
        rows = spark.read.format("paged_features").options(url=f"http://127.0.0.1:{server.server_port}/x", style=style, size="5").load().collect()
    finally:
        server.shutdown()
    assert sorted(int(r.properties["id"]) for r in rows) == list(range(23)) == sorted(r.position for r in rows)
    assert {js.loads(r.geometry)["type"] for r in rows} == {"MultiLineString" if style == "esri" else "LineString"} and failed


def _sequence(path, rows):
    path.write_text("\n".join("\x1e" + json.dumps({"type": "Feature", "properties": p, "geometry": {"type": t, "coordinates": c}}) for p, t, c in rows) + "\n\x1enot json\n")
    return str(path)


def test_graph_of_an_inventory_with_a_supplement(spark, tmp_path):
    from trailframe.operators import jobs

    line = lambda x, y: [[-63.0 + x / 100, 44.0 + y / 100], [-63.0 + (x + 1) / 100, 44.0 + y / 100]]
    roads = _sequence(tmp_path / "nrn.seq", [
        ({"NID": "1", "ROADCLASS": "Arterial", "PAVSTATUS": "Paved"}, "LineString", line(0, 0)), ({"NID": "2", "ROADCLASS": "Local / Street", "PAVSTATUS": "Unknown"}, "LineString", line(1, 0)),
        ({"NID": "3", "ROADCLASS": "Ferry Connection"}, "LineString", line(2, 0)), ({"NID": "4", "ROADCLASS": "Collector", "PAVSTATUS": "Unpaved"}, "MultiLineString", [line(0, 5), line(1, 5)])])
    ways = _sequence(tmp_path / "osm.seq", [({"@id": "w1", "highway": "residential", "surface": "gravel"}, "LineString", line(1, 0.005)), ({"@id": "w2", "highway": "track"}, "LineString", line(0, 9)), ({"@id": "w3", "highway": "footway"}, "LineString", line(0, 8))])
    backbone, supplement = jobs.inventory_features(spark, roads), jobs.tagged_features(spark, ways)
    assert backbone.count() == 5 and backbone.where("reason IS NOT NULL").count() == 1 and supplement.where("reason IS NULL").count() == 2
    assert abs(backbone.where("reason IS NULL").first().meters - 800) < 10
    both = jobs.with_supplement(backbone, supplement)
    assert sorted((r.role, r.surface) for r in both.collect()) == [("backbone", "gravel"), ("backbone", "gravel"), ("backbone", "gravel"), ("backbone", "paved"), ("supplement", "resource")]
    nodes, edges = jobs.regional_graph(both)
    jobs.write_graph(nodes, edges, str(tmp_path / "graph"), "ns")
    meta = spark.read.json(str(tmp_path / "graph" / "meta")).first()
    assert (meta.edges, meta.nodes, meta.components) == (5, 8, 3)
    report = jobs.topology_report(edges).first()
    assert report.components == 3 and report.largest_km == [1.6, 1.6, 0.8]
    end = [("n", nodes, edges.withColumn("rt", F.lit("arterial")))]
    assert jobs.national_spine(end)[1].count() == 5


def test_packs_of_points_and_overlays(spark, tmp_path):
    from trailframe.operators import jobs

    square = [[[-63.0, 44.0], [-63.0, 44.2], [-62.8, 44.2], [-62.8, 44.0]]]
    path = _sequence(tmp_path / "poi.seq", [({"@id": "n1", "amenity": "fuel", "name": " Stop "}, "Point", [-63.1, 44.1]), ({"@id": "w2", "tourism": "camp_site"}, "Polygon", square), ({"@id": "n3", "shop": "wine"}, "Point", [-63.1, 44.1])])
    counts = {r.category: (r.n, r.chunks) for r in jobs.poi_pack(spark, path, str(tmp_path / "pack")).collect()}
    assert counts == {"fuel": (1, 1), "campground": (1, 1), "skipped": (1, 0)}
    out = {r.id: (r.lon, r.lat, r.name, r.chunk_id) for r in spark.read.json(str(tmp_path / "pack" / "chunks")).collect()}
    assert out == {"n1": (-63.1, 44.1, "Stop", "-127_88"), "w2": (-62.9, 44.1, None, "-126_88")}
    line = [[-63.0, 44.0], [-63.1, 44.0]]
    ways = _sequence(tmp_path / "ways.seq", [({"@id": "1", "highway": "track", "tracktype": "grade4"}, "LineString", line), ({"@id": "2", "highway": "path", "motorcycle": "no"}, "LineString", line), ({"@id": "3", "highway": "track", "tracktype": "grade1"}, "LineString", line)])
    rows, counts = jobs.trail_overlay(spark, ways)
    assert sorted((r.id, r.kind, r.status) for r in rows.collect()) == [("1", "atv", "unknown"), ("2", "single", "restricted")] and counts.count() == 4
    roads = _sequence(tmp_path / "roads.seq", [({"ROADCLASS": "Local", "PAVSTATUS": "Unpaved"}, "LineString", line), ({"ROADCLASS": "Arterial", "PAVSTATUS": "Paved"}, "LineString", line)])
    assert jobs.gravel_overlay(spark, roads)[0].count() == 1


def test_a_pack_gives_its_features_back_and_snaps_once(spark, tmp_path):
    from trailframe.operators import jobs

    rng = random.Random(2)
    rows = []
    for k in range(60):  # side roads end up to 30 metres off the main roads' corners
        x, y, side = rng.randrange(5), rng.randrange(5), k % 3 == 0
        off = lambda: rng.randrange(25) * 1e-5 if side else 0.0  # noqa: B023, E731
        a, b = (-63.0 + x / 100 + off(), 44.0 + y / 100 + off()), (-63.0 + (x + 1) / 100 + off(), 44.0 + y / 100 + off())
        rows.append((f"e-{k}", k, "supplement" if side else "backbone", "NB Forest Roads" if side else "National Road Network", None, ("paved", "gravel", "resource", "track", "unknown")[k % 5], ("motorized_permissive", "motorized_unknown")[k % 2], "local", [a, ((a[0] + b[0]) / 2, a[1] + 1e-3), b]))
    features = spark.createDataFrame(rows, "edge_id string, seq long, role string, source string, reason string, surface string, access string, road_class string, points array<struct<lon: double, lat: double>>")
    e5 = lambda k, c: F.floor(F.element_at("points", k)[c] * 1e5 + 0.5).cast("long")
    features = features.withColumn("meters", F.lit(800.0)).withColumns({"x1": e5(1, "lon"), "y1": e5(1, "lat"), "x2": e5(-1, "lon"), "y2": e5(-1, "lat")})
    nodes, edges = jobs.regional_graph(features)
    jobs.write_graph(nodes, jobs.packed_edges(features, edges), str(tmp_path / "one"), "nb")
    back = jobs.rehydrated(spark, str(tmp_path / "one"))
    columns = ["edge_id", "seq", "role", "source", "surface", "access", "road_class", "meters", "points", "x1", "y1", "x2", "y2"]
    listed = lambda df: sorted(map(tuple, df.select(columns).collect()))
    kept = features.join(edges.select("edge_id"), "edge_id", "left_semi")
    assert listed(back) == listed(kept) and len(listed(back)) > 40
    assert {r.source for r in jobs.rehydrated(spark, str(tmp_path / "one"), backbone=True).collect()} == {"National Road Network"}
    scan = back.select("edge_id", "surface")._jdf.queryExecution().executedPlan().toString()
    assert "component" not in scan.split("ReadSchema")[1]
    for old, new in (("one", "two"), ("two", "three")):
        nodes, edges = jobs.resnapped(spark, str(tmp_path / old))
        jobs.write_graph(nodes, edges, str(tmp_path / new), "nb")
    read = lambda name, part: sorted(map(tuple, spark.read.parquet(str(tmp_path / name / part)).collect()), key=str)
    assert read("two", "edges") == read("three", "edges") and read("two", "nodes") == read("three", "nodes")
    assert [r[:2] for r in read("one", "edges")] == [r[:2] for r in read("two", "edges")]
