"""Riders' last known state over a stream of updates, kept by user; and the same over a finished log.

Updates are (user_id, ts, event_id, kind, lng, lat, heading, status, name, group_id, sharing); kinds are `presence` (who is
there), `location`, `database` (a row of the table) and `off` (a rider stops sharing). A rider is never forgotten for not
being heard of: only by stopping to share, by a row that says so, or by presence without a place."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailframe.functions.labels import rider_label

_FIELDS = ("lng", "lat", "heading", "status", "name", "group_id")
_STATE = "lng double, lat double, heading double, status string, name string, group_id string"
_OUT = f"user_id long, known boolean, {_STATE}"
_UPDATE = ("ts", "event_id", "kind", *_FIELDS, "sharing")


def _number(x) -> float | None:
    return None if x is None or isinstance(x, float) and not math.isfinite(x) else float(x)


def applied(old: dict | None, new: dict) -> dict | None:
    """A rider's state after an update: None if nothing is known of them."""
    kind, was = new["kind"], old or {}
    if kind == "off":
        return None
    if kind == "database" and new["sharing"] is not True:
        other = old and new["group_id"] and was["group_id"] and was["group_id"] != new["group_id"]
        return old if other else None
    lng, lat = _number(new["lng"]), _number(new["lat"])
    if kind == "presence":  # a place may be left out
        lng, lat = (was.get(c) if x is None else x for c, x in (("lng", lng), ("lat", lat)))
        if lng is None or lat is None:
            return None
    elif lng is None or lat is None:
        return old
    heading = _number(new["heading"])
    name = new["name"] or was.get("name") or "Rider"
    return {"lng": lng, "lat": lat, "heading": was.get("heading") if heading is None else heading % 360, "status": new["status"] or was.get("status") or "available", "name": name, "group_id": new["group_id"] or was.get("group_id")}


def _prepared(updates: DataFrame, own_id: Column | None) -> DataFrame:
    """What a rider says of themselves is not taken in, unless they stop sharing."""
    rows = updates.where("user_id IS NOT NULL").select("user_id", *_UPDATE)
    return rows if own_id is None else rows.where((F.col("kind") == "off") | (F.col("user_id") != own_id))


def _replayed(state: dict | None, rows: pd.DataFrame) -> dict | None:
    for row in rows.sort_values(["ts", "event_id"]).astype(object).where(rows.notna(), None).to_dict("records"):
        state = applied(state, row)
    return state


def _frame(user_id: int, state: dict | None) -> pd.DataFrame:
    return pd.DataFrame([{"user_id": user_id, "known": state is not None, **{c: (state or {}).get(c) for c in _FIELDS}}]).astype({"lng": float, "lat": float, "heading": float})


def riders_stream(updates: DataFrame, own_id: Column | None = None) -> DataFrame:
    """A row for each rider and micro-batch with updates: their state, `known` being false for those forgotten. Updates of a
    micro-batch are taken in the order of (ts, event_id); nothing times out."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = dict(zip(_FIELDS, state.get)) if state.exists else None
        new = _replayed(old, pd.concat(list(frames)))
        if new is not None:
            state.update(tuple(new[c] for c in _FIELDS))
        elif state.exists:
            state.remove()
        yield _frame(int(key[0]), new)

    return _prepared(updates, own_id).groupBy("user_id").applyInPandasWithState(run, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def riders_known(updates: DataFrame, own_id: Column | None = None) -> DataFrame:
    """The state of all riders known at the end of a finished log, with their labels. One rider's log is one group, since its order matters."""
    done = _prepared(updates, own_id).groupBy("user_id").applyInPandas(lambda key, rows: _frame(int(key[0]), _replayed(None, rows)), _OUT)
    return done.where("known").drop("known").withColumn("label", rider_label(F.col("name"), F.col("status")))


def alerts(updates: DataFrame) -> DataFrame:
    """(alert_id, user_id, status, lng, lat, created, updated): distress with a place, one alert for each user and status, with the
    id and time of the first and the place of the last."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    rows = updates.where(F.lower("status").isin("breakdown", "injured", "stuck") & fine("lng") & fine("lat")).withColumn("status", F.lower("status"))
    at = F.struct("ts", "event_id")
    each = rows.groupBy("user_id", "status").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max_by("lng", at).alias("lng"), F.max_by("lat", at).alias("lat"))
    name = F.concat_ws(":", F.col("user_id").cast("string"), "status", F.col("first.event_id").cast("string"))
    return each.select(name.alias("alert_id"), "user_id", "status", "lng", "lat", F.col("first.ts").alias("created"), F.col("last.ts").alias("updated"))


def dismissed(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Alerts without those whose `alert_id` is dismissed."""
    return found.join(ids.select("alert_id").distinct(), "alert_id", "left_anti")
