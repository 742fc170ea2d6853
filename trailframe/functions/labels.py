"""Texts and fields of riders, trips, cues and points of interest, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.functions.geometry import round_half_up

# Labels of a rider's status, those that mean distress; milliseconds between positions; nearness of equal points.
STATUS = {"available": "Available", "breakdown": "Breakdown", "injured": "Injured", "stuck": "Stuck"}
DISTRESS, DISTRESS_MS, USUAL_MS, SAME_POINT = ("breakdown", "injured", "stuck"), 5000, 15000, 1e-7


def cleaned(text: Column) -> Column:
    """A trimmed text; null if nothing is left."""
    return F.nullif(F.trim(text.cast("string")), F.lit(""))


def address(number: Column, street: Column, city: Column, province: Column, postcode: Column) -> Column:
    """House and street, city, province and postcode, as far as they are there, with commas between; null if none is."""
    line = F.concat_ws(" ", F.nullif(number, F.lit("")), F.nullif(street, F.lit("")))
    return F.nullif(F.concat_ws(", ", *(cleaned(x) for x in (line, city, province, postcode))), F.lit(""))


def updated_at(seconds: Column) -> Column:
    """Seconds since 1970 as an ISO text in UTC; other texts as they are, trimmed."""
    number = seconds.try_cast("double")
    return F.coalesce(F.date_format(F.timestamp_seconds(number), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), cleaned(seconds))


def number_or_null(value: Column) -> Column:
    """A finite number from a number or a text; null otherwise."""
    x = F.trim(value.cast("string")).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def status_label(status: Column) -> Column:
    key = F.lower(F.coalesce(F.nullif(status, F.lit("")), F.lit("available")))
    return reduce(lambda acc, kv: acc.when(key == kv[0], kv[1]), STATUS.items(), F.when(F.lit(False), "")).otherwise(STATUS["available"])


def is_distress(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin(*DISTRESS), F.lit(False))


def publish_interval_ms(status: Column) -> Column:
    return F.when(is_distress(status), DISTRESS_MS).otherwise(USUAL_MS)


def rider_label(name: Column, status: Column) -> Column:
    return F.concat(F.coalesce(cleaned(name), F.lit("Rider")), F.lit(" - "), status_label(status))


def fixed(x: Column, places: int) -> Column:
    """A number from 1 to 10 ** 12 with one or two decimals, as text: the nearest to the double's exact value, the larger of two as near.

    The fraction of such a double is a whole number of 2 ** -52, so that integers tell exactly on which side of a half it lies."""
    tens = 10**places
    steps = ((x - F.floor(x)) * 2.0**52).cast("long")
    units = F.floor(x) * tens + F.shiftright(steps * tens + F.lit(2**51), 52)
    return F.concat(F.floor(units / tens).cast("string"), F.lit("."), F.lpad((units % tens).cast("string"), places, "0"))


def km_label(meters: Column) -> Column:
    """Metres below one kilometre, else kilometres with two places, from ten on with one."""
    km = F.coalesce(meters, F.lit(0.0)) / 1000
    return F.when(km < 1, F.concat(F.floor(km * 1000 + 0.5).cast("string"), F.lit(" m"))).when(km >= 10, F.concat(fixed(km, 1), F.lit(" km"))).otherwise(F.concat(fixed(km, 2), F.lit(" km")))


def time_label(seconds: Column) -> Column:
    """Minutes, or hours and the minutes left; a dash for no time."""
    s = F.coalesce(seconds, F.lit(0.0))
    minutes = F.floor(s / 60 + 0.5)
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"), F.when(minutes % 60 > 0, F.concat(F.lit(" "), (minutes % 60).cast("string"), F.lit(" min"))).otherwise(""))
    return F.when(s <= 0, "—").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(hours)


def same_point(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """False where a coordinate is missing."""
    return F.coalesce((F.abs(lng1 - lng2) < SAME_POINT) & (F.abs(lat1 - lat2) < SAME_POINT), F.lit(False))


def curve_words(side: Column, number: Column) -> Column:
    """Struct (text, spoken, key) of a numbered curve; a right or left one of number 1 is a hairpin."""
    tight = F.when(number == 1, " hairpin").otherwise("")
    n = number.cast("string")
    return F.struct(F.concat(F.initcap(side), F.lit(" "), n, tight).alias("text"), F.concat(side, F.lit(" "), n, tight).alias("spoken"),
                    F.concat(n, F.lit("-"), side, F.when(number == 1, "-hairpin").otherwise("")).alias("key"))


def junction_words(side: Column) -> Column:
    """Struct (text, here, spoken, key) of a turn, which has no number; of none, straight on."""
    turn = F.concat(F.initcap(side), F.lit(" turn"))
    text = F.struct(turn.alias("text"), F.concat(turn, F.lit(" here")).alias("here"), F.concat(side, F.lit(" turn")).alias("spoken"), F.concat(F.lit("jct-"), side).alias("key"))
    none = F.struct(F.lit("Straight").alias("text"), F.lit(None).cast("string").alias("here"), F.lit("straight").alias("spoken"), F.lit("straight").alias("key"))
    return F.when(F.coalesce(side == "straight", F.lit(True)), none).otherwise(text)


def representative_point(kind: Column, rings: Column) -> Column:
    """(lon, lat), to 6 places, of a geometry given as lists of [lon, lat]: a point itself, else the mean of a line, of all
    lines, of the outer ring, or of the outer ring with most points (the first of equal ones). Null without points.

    `rings`: for a polygon its rings, for several polygons their outer rings, else the lines."""
    whole = F.when(kind.isin("MultiLineString", "Point", "LineString"), F.flatten(rings)).when(kind == "Polygon", F.get(rings, F.lit(0)))
    longest = F.array_max(F.transform(rings, lambda r, i: F.struct(F.size(r).alias("n"), (-i).alias("i"), r.alias("r"))))["r"]
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    points = F.filter(F.when(kind == "MultiPolygon", longest).otherwise(whole), lambda p: fine(F.get(p, 0)) & fine(F.get(p, 1)))
    mean = lambda k: round_half_up(F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k]) / F.size(points), 6)
    return F.when(F.size(points) > 0, F.struct(mean(0).alias("lon"), mean(1).alias("lat")))
