"""State of trip stages from their events, by aggregates that combine before the shuffle instead of a fold in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Events of a stage.
CLEARING = ("set-start", "set-end", "set-points", "invalidate", "route-failed")
KINDS = (*CLEARING, "route-start", "route-success")


def stage_states(events: DataFrame) -> DataFrame:
    """(stage, status, start_point, end_point, route) from rows (stage, seq, kind, start_point, end_point, route).

    `seq` orders a stage's events and is unique there. The newest setting of a point holds, null too; `set-points`
    sets what it carries. A route stays until an event that clears. Without both points a stage is a draft;
    else the newest event tells whether it is loading or failed, and a route makes it complete. Other kinds
    change nothing."""
    known = events.where(F.col("kind").isin(*KINDS))
    when = lambda test: F.when(test, F.col("seq"))
    kind = F.col("kind")
    sets = lambda end: (kind == f"set-{end}") | ((kind == "set-points") & F.col(f"{end}_point").isNotNull())
    found = (kind == "route-success") & F.col("route").isNotNull()
    last = known.groupBy("stage").agg(
        F.max_by("kind", "seq").alias("kind"), F.max_by("start_point", when(sets("start"))).alias("start_point"), F.max_by("end_point", when(sets("end"))).alias("end_point"),
        F.max(when(kind.isin(*CLEARING))).alias("cleared"), F.max(when(found)).alias("found"), F.max_by("route", when(found)).alias("route"))
    route = F.when(F.col("found") > F.coalesce("cleared", F.lit(-(2**63)).cast("long")), F.col("route"))
    status = (F.when(F.col("start_point").isNull() | F.col("end_point").isNull(), "draft").when(kind == "route-start", "loading").when(kind == "route-failed", "failed")
              .when(route.isNotNull(), "complete").otherwise("ready"))
    return last.select("stage", status.alias("status"), "start_point", "end_point", route.alias("route"))
