"""Packs of points of interest: categories, chunks of half a degree with tight boxes, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.functions.classify import category
from trailframe.functions.geometry import round_half_up

#: Fixed value: degrees of a chunk.
CHUNK = 0.5


def categorized(points: DataFrame) -> DataFrame:
    """Points (id, amenity, shop, tourism, lon, lat) with a category (null: not a point of interest) and their chunk's id."""
    rows = points.withColumns({"lon": round_half_up(F.col("lon"), 6), "lat": round_half_up(F.col("lat"), 6), "category": category(F.col("amenity"), F.col("shop"), F.col("tourism"))})
    at = lambda c: F.floor(F.col(c) / CHUNK).cast("string")
    return rows.withColumn("chunk", F.concat(at("lon"), F.lit("_"), at("lat")))


def poi_chunks(points: DataFrame) -> DataFrame:
    """(id, n, west, south, east, north) of each chunk; the box is that of its points."""
    box = [F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")]
    return points.where("category IS NOT NULL").groupBy(F.col("chunk").alias("id")).agg(F.count("*").alias("n"), *box)


def poi_counts(points: DataFrame) -> DataFrame:
    """(category, n, chunks); rows of no category are `skipped`."""
    return points.groupBy(F.coalesce("category", F.lit("skipped")).alias("category")).agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("category").isNotNull(), F.col("chunk"))).alias("chunks"))


def write_poi_chunks(points: DataFrame, folder: str, rows: int = 50_000) -> None:
    """The points of interest as compressed JSON by chunk; a crowded chunk is written by several tasks."""
    kept = points.where("category IS NOT NULL").withColumn("chunk_id", F.col("chunk")).drop("chunk")
    kept.hint("rebalance", "chunk_id").write.option("maxRecordsPerFile", rows).option("compression", "gzip").partitionBy("chunk_id").mode("errorifexists").json(folder)
