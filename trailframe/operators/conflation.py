"""Conflation of a supplement with a backbone: near-duplicate lines by grid cells, then an anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.functions.geometry import bearing_rough, cell, folded_difference, haversine
from trailframe.operators.components import checkpointed
from trailframe.operators.regional import settle

#: Cell of the grid (1e-5 degrees), distance in metres and folded bearing difference up to which lines are one.
CELL_E5, NEAR_M, NEAR_DEG = 200, 28.0, 28.0


def _line(rows: DataFrame, tag: str) -> DataFrame:
    """key, middle vertex and direction of two-vertex lines (x1, y1, x2, y2 in 1e-5 degrees)."""
    d = lambda c: F.col(c) / 1e5
    return rows.select(F.col("key").alias(f"{tag}_key"), F.col("x2").alias(f"{tag}_x"), F.col("y2").alias(f"{tag}_y"), bearing_rough(d("x1"), d("y1"), d("x2"), d("y2")).alias(f"{tag}_dir"))


def by_middles(rows: DataFrame) -> DataFrame:
    """Lines (key, points: (lon, lat) in degrees) as two-vertex lines that end in the middle vertex and have the direction from end to end."""
    e5 = lambda p, c: F.floor(p[c] * 1e5 + 0.5).cast("long")
    first, middle, last = F.get("points", F.lit(0)), F.get("points", F.floor(F.size("points") / 2).cast("int")), F.try_element_at("points", F.lit(-1))
    at = {"x1": e5(middle, "lon") - (e5(last, "lon") - e5(first, "lon")), "y1": e5(middle, "lat") - (e5(last, "lat") - e5(first, "lat")), "x2": e5(middle, "lon"), "y2": e5(middle, "lat")}
    return rows.where(F.size("points") >= 2).select("*", *(v.alias(k) for k, v in at.items())).drop("points")


def duplicate_pairs(backbone: DataFrame, supplement: DataFrame) -> DataFrame:
    """(base_key, sup_key, meters) of lines whose middle vertices and directions agree; an equi-join on 3 x 3 cells."""
    base = _line(backbone, "base").withColumns({"cx": cell(F.col("base_x"), CELL_E5), "cy": cell(F.col("base_y"), CELL_E5)})
    around = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    sup = _line(supplement, "sup").select("*", F.explode(around).alias("d")).select("*", (cell(F.col("sup_x"), CELL_E5) + F.col("d.dx")).alias("cx"), (cell(F.col("sup_y"), CELL_E5) + F.col("d.dy")).alias("cy"))
    meters = haversine(F.col("sup_x") / 1e5, F.col("sup_y") / 1e5, F.col("base_x") / 1e5, F.col("base_y") / 1e5)
    both = sup.join(base, ["cx", "cy"]).withColumn("meters", meters)
    return both.where((F.col("meters") <= NEAR_M) & (folded_difference(F.col("sup_dir"), F.col("base_dir")) <= NEAR_DEG)).select("base_key", "sup_key", "meters")


def conflate(backbone: DataFrame, supplement: DataFrame) -> DataFrame:
    """(key, role): the backbone, and the lines of the supplement that repeat none of it."""
    pairs = duplicate_pairs(backbone, supplement).select(F.col("sup_key").alias("key")).distinct()
    return backbone.select("key", F.lit("backbone").alias("role")).unionByName(supplement.join(pairs, "key", "left_anti").select("key", F.lit("supplement").alias("role")))


def resolved(backbone: DataFrame, supplement: DataFrame) -> DataFrame:
    """(key, role, surface, enriched_by, duplicate_of) of all lines (key, x1, y1, x2, y2, surface), in the order of their keys.

    A line of the supplement repeats the first line of the backbone near it, or else the first accepted one of the
    supplement before it; otherwise it is accepted. An unknown surface takes that of the first line that repeats it and has
    a paved, gravel or resource one. Each round decides the lines whose earlier neighbours are decided."""
    first = duplicate_pairs(backbone, supplement).groupBy(F.col("sup_key").alias("key")).agg(F.min("base_key").alias("duplicate_of"))
    known = checkpointed(first.select("key", "duplicate_of", F.lit("backbone").alias("of")))
    rest = checkpointed(supplement.join(known, "key", "left_anti").select("key", "x1", "y1", "x2", "y2"))
    pairs = duplicate_pairs(rest, rest).where("base_key < sup_key").select(F.col("sup_key").alias("place"), F.col("base_key").alias("other"), F.lit(0.0).alias("meters"))
    own = settle(rest.select(F.col("key").alias("place")), pairs)  # of equal distances the earliest
    found = known.unionByName(own.where("owner <> place").select(F.col("place").alias("key"), F.col("owner").alias("duplicate_of"), F.lit("supplement").alias("of")))
    better = supplement.where(F.col("surface").isin("paved", "gravel", "resource")).join(found, "key").groupBy("duplicate_of", "of").agg(F.min(F.struct("key", "surface")).alias("best"))
    lines = backbone.select("key", F.lit("backbone").alias("role"), "surface").unionByName(supplement.select("key", F.lit("supplement").alias("role"), "surface"))
    joined = lines.join(better.select(F.col("duplicate_of").alias("key"), F.col("of").alias("role"), "best"), ["key", "role"], "left").join(found.select("key", F.lit("supplement").alias("role"), "duplicate_of"), ["key", "role"], "left")
    fits = (F.coalesce("surface", F.lit("unknown")) == "unknown") & F.col("best").isNotNull()
    role = F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise(F.col("role"))
    return joined.select("key", role.alias("role"), F.when(fits, F.col("best.surface")).otherwise(F.col("surface")).alias("surface"), F.when(fits, F.col("best.key")).alias("enriched_by"), "duplicate_of")


def statistics(resolved_lines: DataFrame) -> DataFrame:
    """One row: lines of the backbone kept, of the supplement added and skipped, and surfaces that were found."""
    role = F.col("role")
    return resolved_lines.agg(F.count_if(role == "backbone").alias("kept"), F.count_if(role == "supplement").alias("added"), F.count_if(role == "duplicate").alias("skipped"), F.count("enriched_by").alias("enriched"))
