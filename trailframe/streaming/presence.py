"""Last known positions: the batch form, and the same state over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presence_rows(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "breakdown").when(F.col("event_type") == "signup", "stuck").otherwise("available")
    lng = F.when(F.col("event_id") % 7 != 0, F.lit(-6_600_000) + F.floor("value") % 1000)
    return events.select("user_id", "ts", "event_id", status.alias("status"), lng.alias("lng_e5"))


def last_known(rows: DataFrame) -> DataFrame:
    """Per user the last status and the last position that isn't null; partial aggregates, no sort and no window."""
    order = F.struct("ts", "event_id")
    return rows.groupBy("user_id").agg(F.max_by("status", order).alias("status"), F.max_by("lng_e5", F.when(F.col("lng_e5").isNotNull(), order)).alias("lng_e5"), F.max("ts").alias("last_seen"))


def live(known: DataFrame, now, seconds: int = 120) -> DataFrame:
    """Users seen less than `seconds` ago, and those never stamped."""
    return known.where(F.col("last_seen").isNull() | (F.col("last_seen") > now - F.make_dt_interval(secs=F.lit(seconds))))


def rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events for each user and window; on a stream, windows close when the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "n")
