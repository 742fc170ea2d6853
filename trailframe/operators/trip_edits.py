"""Edits of a trip's stages, replayed from a log: stages added, removed, moved and set, with neighbouring ends kept together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions.labels import same_point

_POINT = "struct<lng: double, lat: double>"
_STAGE = f"struct<id: string, profile: string, start: {_POINT}, end: {_POINT}, route: string>"
# The profile of a stage that names none, and the stage that a trip begins with.
USUAL, FIRST = "balanced", "first"


def _let(value: Column, body) -> Column:
    """`body` with a value that is computed once."""
    return F.aggregate(F.array(), value, lambda acc, _: acc, body)


def _stage(id_: Column, profile: Column, start: Column, end: Column, route: Column) -> Column:
    return F.struct(id_.alias("id"), profile.alias("profile"), start.cast(_POINT).alias("start"), end.cast(_POINT).alias("end"), route.cast("string").alias("route"))


def _from_start(s: Column, start: Column) -> Column:
    """A stage that begins elsewhere; its route is void."""
    return _stage(s["id"], s["profile"], start, s["end"], F.lit(None))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(same_point(a["lng"], a["lat"], b["lng"], b["lat"]), F.lit(False))


def _has_ends(s: Column) -> Column:
    return s["start"].isNotNull() & s["end"].isNotNull()


def _added(stages: Column, id_: Column, profile: Column, start: Column, end: Column) -> Column:
    """Stages and a new one, which begins where the last one ends unless told otherwise."""
    return F.concat(stages, F.array(_stage(id_, F.coalesce(profile, F.lit(USUAL)), F.coalesce(start, F.try_element_at(stages, F.lit(-1))["end"]), end, F.lit(None))))


def _without(stages: Column, at: Column) -> Column:
    return F.filter(stages, lambda s, i: i != at)


def _set(stages: Column, at: Column, e: Column) -> Column:
    kind = e["kind"]
    new = lambda s: (F.when(kind == "set-start", _from_start(s, e["start"])).when(kind == "set-end", _stage(s["id"], s["profile"], s["start"], e["end"], F.lit(None)))
                     .when(kind == "route-success", _stage(s["id"], s["profile"], s["start"], s["end"], F.coalesce(e["route"], s["route"]))).otherwise(_stage(s["id"], s["profile"], s["start"], s["end"], F.lit(None))))
    return F.transform(stages, lambda s, i: F.when(i == at, new(s)).otherwise(s))


def _without_waypoint(stages: Column, at: Column, e: Column) -> Column:
    """Stages without the one at `at`: the next one begins where it began, later ones where the one before them ends; a chain
    that ends in a whole stage gets a new draft."""
    began = F.get(stages, at)["start"]
    left = _without(F.transform(stages, lambda s, i: F.when(i == at + 1, _from_start(s, began)).otherwise(s)), at)

    def repaired(rest: Column) -> Column:
        before = lambda i: F.get(rest, i - 1)["end"]
        wrong = lambda s, i: (i >= F.greatest(F.lit(1), at)) & before(i).isNotNull() & ~_same(s["start"], before(i))
        return F.transform(rest, lambda s, i: F.when(wrong(s, i), _from_start(s, before(i))).otherwise(s))

    draft = F.concat(F.lit("draft-"), e["seq"].cast("string"))
    return _let(_let(left, repaired), lambda rest: F.when(_has_ends(F.element_at(rest, -1)), _added(rest, draft, F.element_at(rest, -1)["profile"], F.lit(None).cast(_POINT), F.lit(None).cast(_POINT))).otherwise(rest))


def _moved(stages: Column, e: Column) -> Column:
    rest = _without(stages, e["from"])
    return F.concat(F.slice(rest, F.lit(1), e["to"]), F.array(F.get(stages, e["from"])), F.slice(rest, e["to"] + 1, F.size(stages)))


def _edited(stages: Column, e: Column) -> Column:
    n, kind = F.size(stages), e["kind"]
    at = (F.array_position(F.transform(stages, lambda s: s["id"]), F.coalesce(e["stage"], F.lit(""))) - 1).cast("int")
    inside = lambda k: F.coalesce((k >= 0) & (k < n), F.lit(False))
    return _let(at, lambda k: (
        F.when(kind == "add", _added(stages, e["stage"], e["profile"], e["start"], e["end"]))
        .when((kind == "move") & inside(e["from"]) & inside(e["to"]) & (e["from"] != e["to"]), _moved(stages, e))
        .when((k < 0) | (kind == "move"), stages)
        .when(kind == "remove", F.when(n > 1, _without(stages, k)).otherwise(stages))
        .when(kind == "remove-waypoint", F.when((n > 1) & _has_ends(F.get(stages, k)), _without_waypoint(stages, k, e)).otherwise(stages))
        .when(kind.isin("set-start", "set-end", "route-success", "invalidate"), _set(stages, k, e)).otherwise(stages)))


def replayed(log: DataFrame) -> DataFrame:
    """(trip, place, stage, profile, start, end, route, status) of every trip's stages after its log (trip, seq, kind, stage, profile,
    start, end, route, from, to), in order of `seq`, which is unique in a trip.

    A trip begins with one draft. `add` appends a stage; `remove` and `remove-waypoint` take one away, but never the last one
    left, the latter joining its neighbours, and only if the stage has both ends; `move` takes places from 0; a stage that
    isn't there, places outside and other kinds change nothing. Of stages that share an id the first is meant. A trip's log
    is folded by one task, as its result is one row: an edit depends on the stages that those before it left."""
    fields = ["seq", "kind", "stage", "profile", F.col("start").cast(_POINT).alias("start"), F.col("end").cast(_POINT).alias("end"), "route", F.col("from").cast("int").alias("from"), F.col("to").cast("int").alias("to")]
    logs = log.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("log"))
    none = F.lit(None)
    first = F.array(_stage(F.lit(FIRST), F.lit(USUAL), none, none, none)).cast(f"array<{_STAGE}>")
    stages = F.aggregate("log", first, lambda acc, e: _edited(acc, e).cast(f"array<{_STAGE}>"))
    rows = logs.select("trip", F.posexplode(stages).alias("place", "s")).select("trip", "place", "s.*")
    status = F.when(F.col("start").isNull() | F.col("end").isNull(), "draft").when(F.col("route").isNotNull(), "complete").otherwise("ready")
    return rows.select("trip", "place", F.col("id").alias("stage"), "profile", "start", "end", "route", status.alias("status"))
