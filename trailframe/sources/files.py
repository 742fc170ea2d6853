"""Readers and writers of feature files: GeoJSON sequences, compressed collections, GPX tracks, chunks, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.functions.geometry import haversine, round_half_up
from trailframe.operators.lines import without_repeats

#: Fixed value: the mean radius that track lengths are measured with.
TRACK_RADIUS_M = 6_371_008.8
_FEATURE = "type: STRING, properties: MAP<STRING, STRING>, geometry: STRING"
_POINT = "STRUCT<_lat: STRING, _lon: STRING, ele: STRING, time: STRING>"
_GPX = f"trk ARRAY<STRUCT<name: STRING, trkseg: ARRAY<STRUCT<trkpt: ARRAY<{_POINT}>>>>>, rte ARRAY<STRUCT<name: STRING, rtept: ARRAY<{_POINT}>>>"


def read_sequence(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, properties, geometry, reason) of a GeoJSON sequence: a feature on each line, or after each `separator`.

    Record separators before a feature and blank records are skipped; what isn't JSON has the reason `invalid_json`."""
    lines = (spark.read.option("lineSep", separator) if separator else spark.read).text(path)
    text = F.trim(F.regexp_replace("value", "[\\x1e\\r\\n]", ""))
    parsed = lines.select(F.col("_metadata.file_path").alias("file"), text.alias("text")).where("text <> ''").select("file", F.from_json("text", f"STRUCT<{_FEATURE}, _bad: STRING>", {"columnNameOfCorruptRecord": "_bad"}).alias("f"))
    return parsed.select("file", "f.properties", "f.geometry", F.when(F.col("f._bad").isNotNull() | F.col("f.type").isNull(), "invalid_json").alias("reason"))


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, properties, geometry) of all features of a folder of (compressed) feature collections."""
    files = spark.read.schema(f"features ARRAY<STRUCT<{_FEATURE}>>").json(path, multiLine=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("position", "f")).select("file", "position", "f.properties", "f.geometry")


def normal_line(points: Column) -> Column:
    """Points [lon, lat] rounded to 5 places, without those that aren't numbers and those that repeat the one before."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rounded = F.transform(F.filter(points, lambda p: fine(F.get(p, 0)) & fine(F.get(p, 1))), lambda p: F.array(round_half_up(p[0], 5), round_half_up(p[1], 5)))
    return without_repeats(rounded)


def line_parts(features: DataFrame) -> DataFrame:
    """The features with a row for each line of at least two points, as `part` and `line`; other geometries have none."""
    kind = F.get_json_object("geometry", "$.type")
    at = F.get_json_object("geometry", "$.coordinates")
    lines = F.when(kind == "LineString", F.array(F.from_json(at, "array<array<double>>"))).when(kind == "MultiLineString", F.from_json(at, "array<array<array<double>>>"))
    split = features.select("*", F.posexplode(lines).alias("part", "_line"))
    return split.withColumn("line", normal_line(F.col("_line"))).drop("_line").where(F.size("line") >= 2)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(file, track, segment, i, lat, lon, ele, time) of GPX files: tracks, or routes where no track has a segment.

    Points outside the globe or without numbers go; segments need two points."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_xml("value", _GPX).alias("g"))

    def points(of: Column) -> Column:
        real = F.transform(of, lambda p: F.struct(p["_lat"].try_cast("double").alias("lat"), p["_lon"].try_cast("double").alias("lon"), p["ele"].try_cast("double").alias("ele"), F.trim(p["time"]).alias("time")))
        return F.filter(real, lambda p: F.coalesce((F.abs(p["lat"]) <= 90) & (F.abs(p["lon"]) <= 180), F.lit(False)))

    long_enough = lambda segments: F.filter(segments, lambda s: F.size(s) >= 2)
    tracks = F.transform("g.trk", lambda t: long_enough(F.transform(F.coalesce(t["trkseg"], F.array()), lambda s: points(s["trkpt"]))))
    routes = F.transform("g.rte", lambda r: long_enough(F.array(points(r["rtept"]))))
    both = docs.select("file", F.filter(tracks, lambda t: F.size(t) > 0).alias("tracks"), F.filter(routes, lambda t: F.size(t) > 0).alias("routes"))
    lines = both.select("file", F.posexplode(F.when(F.size("tracks") > 0, F.col("tracks")).otherwise(F.col("routes"))).alias("track", "t"))
    return lines.select("file", "track", F.posexplode("t").alias("segment", "s")).select("file", "track", "segment", F.posexplode("s").alias("i", "p")).select("file", "track", "segment", "i", "p.*")


def track_summary(points: DataFrame) -> DataFrame:
    """Points, metres and box by file; no leg joins two segments."""
    w = Window.partitionBy("file", "track", "segment").orderBy("i")
    leg = haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"), TRACK_RADIUS_M)
    legs = points.withColumn("leg", leg)
    return legs.groupBy("file").agg(F.count("*").alias("points"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("meters"), *(f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))))


def write_chunks(lines: DataFrame, folder: str, degrees: float, vertex: str = "first", rows: int = 50_000) -> None:
    """Rows with a column `line` as compressed JSON, by grid cell of their first or middle vertex.

    Cells are rebalanced rather than hashed, so that a crowded one is written by several tasks."""
    p = F.get("line", F.lit(0) if vertex == "first" else F.floor(F.size("line") / 2).cast("int"))
    at = lambda k: F.floor(F.get(p, k) / degrees).cast("string")
    cells = lines.withColumn("chunk_id", F.concat_ws("_", at(0), at(1)))
    cells.hint("rebalance", "chunk_id").write.option("maxRecordsPerFile", rows).option("compression", "gzip").partitionBy("chunk_id").mode("errorifexists").json(folder)


def write_audit(classified: DataFrame, folder: str) -> None:
    """All classified rows, kept or not, as compressed JSON lines."""
    classified.write.option("compression", "gzip").mode("errorifexists").json(folder)
