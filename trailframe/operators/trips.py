"""Roll-ups of trips from the routes of their stages, by sums of metres: breakdowns, shares, gaps and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.labels import same_point

# Surfaces and access classes that metres are kept for, those of adventure; surplus of elapsed over moving time.
SURFACES = ("paved", "gravel", "access", "resource", "track", "double_track", "single", "unknown")
ACCESSES = ("motorized_verified", "motorized_permissive", "motorized_unknown")
ADVENTURE, SURPLUS = ("gravel", "access", "resource", "track", "double_track", "single", "unknown"), 1.15
#: What a route's percentages are listed for.
SHARED = {"paved": "paved", "gravel": "gravel", "access": "access", "track": "track", "unknown": "unknown_surface", "motorized_verified": "verified_access", "motorized_permissive": "permissive_access", "motorized_unknown": "unknown_access"}


def percent(part: Column, total: Column) -> Column:
    """A share in whole per cent, halves up; 0 without a total."""
    return F.when(total > 0, F.floor(part / total * 100 + 0.5)).otherwise(0).cast("long")


def breakdown(routes: DataFrame) -> DataFrame:
    """Adds metres by surface and access, `dirt_m` and `elapsed` to routes (distance, moving, elapsed, segments, percents).

    Metres come from the segments (meters, surface, access; null classes are unknown); a route without any takes its
    percentages (a map by the names of SHARED) of its distance."""
    metres = lambda test: F.aggregate(F.filter("segments", test), F.lit(0.0), lambda acc, s: acc + F.coalesce(s["meters"], F.lit(0.0)))
    has = F.coalesce(F.size("segments") > 0, F.lit(False))

    def of(name: str, field: str, default: str) -> Column:
        listed = F.coalesce(F.try_element_at("percents", F.lit(SHARED.get(name, ""))), F.lit(0.0)) / 100 * F.col("distance")
        return F.when(has, metres(lambda s: F.coalesce(s[field], F.lit(default)) == name)).when(F.col("distance") > 0, listed).otherwise(0.0)

    rows = routes.withColumns({f"{n}_m": of(n, "surface", "unknown") for n in SURFACES} | {f"{n}_m": of(n, "access", "motorized_unknown") for n in ACCESSES})
    dirt = sum((F.col(f"{n}_m") for n in ADVENTURE), F.lit(0.0))
    return rows.withColumns({"dirt_m": dirt, "elapsed": F.coalesce("elapsed", F.col("moving") * SURPLUS)})


def gaps(stages: DataFrame) -> DataFrame:
    """(trip, from_stage, to_stage, position) of complete stages that don't end where the next, complete too, starts."""
    w = Window.partitionBy("trip").orderBy("position")
    after = lambda c: F.lead(c).over(w).alias(f"next_{c}")
    pairs = stages.select("*", *(after(c) for c in ("stage", "complete", "start_lng", "start_lat")))
    apart = pairs.where(F.col("complete") & F.col("next_complete") & ~same_point(F.col("end_lng"), F.col("end_lat"), F.col("next_start_lng"), F.col("next_start_lat")))
    return apart.select("trip", F.col("stage").alias("from_stage"), F.col("next_stage").alias("to_stage"), "position")


def aggregate(stages: DataFrame) -> DataFrame:
    """A row for each trip of stages (trip, stage, position, start and end points, complete, and a route's columns)."""
    counted = stages.groupBy("trip").agg(
        F.count("*").alias("stages"), F.count_if("complete").alias("completed"), F.min("complete").alias("all_complete"),
        F.count_if(F.col("start_lng").isNotNull() & F.col("end_lng").isNotNull()).alias("required"))
    total = lambda c: F.sum(c).alias(c)
    sums = breakdown(stages.where("complete")).groupBy("trip").agg(*(total(c) for c in ("distance", "moving", "elapsed", "dirt_m", *(f"{n}_m" for n in (*SURFACES, *ACCESSES)))))
    apart = gaps(stages).groupBy("trip").agg(F.count("*").alias("gaps"))
    rows = counted.join(sums, "trip", "left").join(apart, "trip", "left")
    rounded = lambda c: F.floor(F.coalesce(c, F.lit(0.0)) + 0.5).cast("long").alias(c)
    share = lambda c, name: percent(F.coalesce(c, F.lit(0.0)), F.coalesce("distance", F.lit(0.0))).alias(name)
    shares = [share("dirt_m", "dirt_percent"), *(share(f"{n}_m", f"{name}_percent") for n, name in SHARED.items())]
    return rows.select("trip", "stages", "completed", "required", "all_complete", F.coalesce("gaps", F.lit(0)).alias("gaps"), *(rounded(c) for c in ("distance", "moving", "elapsed", "dirt_m")), *shares)


def warnings(stages: DataFrame) -> DataFrame:
    """(trip, code, message): the first warning of each code, in the order of stages; one for gaps comes last."""
    own = stages.where("complete").select("trip", "position", F.posexplode("warnings").alias("i", "w")).select("trip", F.struct(F.lit(0).alias("late"), "position", "i").alias("at"), "w.code", "w.message")
    text = F.concat(F.lit("Stage "), F.col("position").cast("string"), F.lit(" does not end where stage "), (F.col("position") + 1).cast("string"), F.lit(" starts."))
    apart = gaps(stages).select("trip", F.struct(F.lit(1).alias("late"), "position", F.lit(0).alias("i")).alias("at"), F.lit("stage_gap").alias("code"), text.alias("message"))
    return own.unionByName(apart).groupBy("trip", F.coalesce("code", "message", F.lit("")).alias("code")).agg(F.min_by("message", "at").alias("message"))


def saved(stages: DataFrame, version: int = 1) -> DataFrame:
    """(trip, document): trips as versioned JSON, stages in their order."""
    fields = ["position", "stage", "start_lng", "start_lat", "end_lng", "end_lat", "complete", "distance", "moving"]
    each = stages.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("stages"))
    return each.select("trip", F.to_json(F.struct(F.lit(version).alias("schemaVersion"), "trip", "stages")).alias("document"))


def restored(documents: DataFrame, version: int = 1) -> DataFrame:
    """The stages of saved trips; documents that aren't JSON or have another version have an `error` and no stage."""
    schema = "schemaVersion INT, trip LONG, stages ARRAY<STRUCT<position: LONG, stage: LONG, start_lng: DOUBLE, start_lat: DOUBLE, end_lng: DOUBLE, end_lat: DOUBLE, complete: BOOLEAN, distance: DOUBLE, moving: DOUBLE>>"
    read = documents.select(F.from_json("document", schema).alias("d"))
    error = F.when(F.col("d.schemaVersion").isNull(), "invalid").when(F.col("d.schemaVersion") != version, "unsupported_version")
    rows = read.select(error.alias("error"), F.col("d.trip").alias("trip"), F.explode_outer(F.when(error.isNull(), F.col("d.stages"))).alias("s"))
    return rows.select("error", "trip", "s.*")
