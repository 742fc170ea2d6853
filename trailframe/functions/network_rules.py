"""Rules on canonical edges as column expressions: policies, spine membership, packing, regions, texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Buckets of access classes for the policy; boxes of regions (west, south, east, north); neighbours of regions; main classes; km/h by surface code.
ACCESS_BUCKET = {
    "motorized_verified": "motorized_permissive", "motorized_permissive": "motorized_permissive", "motorized_restricted": "motorized_restricted",
    "restricted": "motorized_restricted", "motorized_excluded": "motorized_excluded", "excluded": "motorized_excluded",
}
REGION_BOXES = {
    "ns": (-66.6, 43.3, -59.5, 47.2), "pe": (-64.6, 45.8, -61.9, 47.2), "nb": (-69.3, 44.5, -63.8, 48.2), "nl": (-67.9, 46.5, -52.5, 60.5),
    "qc": (-79.8, 44.9, -57.0, 62.7), "on": (-95.2, 41.6, -74.3, 56.9), "mb": (-102.1, 48.9, -95.0, 60.1), "sk": (-110.1, 48.9, -101.3, 60.1),
    "ab": (-120.1, 48.9, -109.9, 60.1), "bc": (-139.1, 48.2, -114.0, 60.1), "yt": (-141.1, 59.8, -123.8, 69.7), "nt": (-136.5, 60.0, -102.0, 78.8), "nu": (-120.9, 51.6, -60.9, 83.2),
}
REGION_NEIGHBOURS = {
    "bc": ("ab", "yt", "nt"), "ab": ("bc", "sk", "nt"), "sk": ("ab", "mb", "nt"), "mb": ("sk", "on", "nu"), "on": ("mb", "qc"), "qc": ("on", "nb", "nl"),
    "nb": ("qc", "ns", "pe"), "ns": ("nb",), "pe": ("nb",), "nl": ("qc",), "yt": ("bc", "nt"), "nt": ("yt", "bc", "ab", "sk", "nu"), "nu": ("nt", "mb"),
}
#: Meridians and parallels that part regions whose boxes overlap; banks of a border river by longitude (from, least latitude of the north bank).
WEST_EAST = (("on", "mb", -95.15, "mb", "on"), ("mb", "sk", -101.36, "sk", "mb"), ("sk", "ab", -110.0, "ab", "sk"))
NORTH_BANK = ((-75.55, 45.475), (-75.75, 45.44), (-75.95, 45.4), (-76.5, 45.38))
SPINE_CLASSES = ("freeway", "arterial", "collector")
SPEEDS_KMH = (70, 45, 35, 25, 30)


def access_for_policy(access: Column) -> Column:
    """The policy's bucket of an access class; what isn't listed is unknown."""
    named = F.create_map(*(F.lit(x) for kv in ACCESS_BUCKET.items() for x in kv))
    return F.coalesce(F.try_element_at(named, access), F.lit("motorized_unknown"))


def normalized_policy(permissive: Column, unknown: Column, profile: Column) -> Column:
    """Struct (permissive, unknown): permissive unless told otherwise, unknown only if asked for and never for the clean profile."""
    return F.struct(F.coalesce(permissive, F.lit(True)).alias("permissive"), (F.coalesce(unknown, F.lit(False)) & ~profile.eqNullSafe(F.lit("cleanest"))).alias("unknown"))


def is_spine(road_class: Column, surface: Column, meters: Column, at_border: Column) -> Column:
    """Main roads; at the border roads of a good surface or of some length; long paved or gravel roads."""
    return road_class.isin(*SPINE_CLASSES) | (at_border & ((surface <= 2) | (meters >= 200))) | ((surface <= 1) & (meters >= 800))


def packed(surface: Column, access: Column, seasonal: Column) -> Column:
    """Three attributes in one integer: 4 bits of surface, 4 of access, 1 of season."""
    return F.shiftleft(seasonal.cast("int"), 8).bitwiseOR(F.shiftleft(access.cast("int"), 4)).bitwiseOR(surface.cast("int"))


def unpacked(bits: Column) -> Column:
    low = lambda c: c.bitwiseAND(F.lit(15))
    return F.struct(low(bits).alias("surface"), low(F.shiftright(bits, 4)).alias("access"), (F.shiftright(bits, 8) == 1).alias("seasonal"))


def regions_by_area() -> list[tuple[str, tuple]]:
    return sorted(REGION_BOXES.items(), key=lambda kv: ((kv[1][2] - kv[1][0]) * (kv[1][3] - kv[1][1]), kv[0]))


def smallest_region(lon: Column, lat: Column) -> Column:
    """The region with the smallest box around a point; null outside all of them."""
    inside = lambda w, s, e, n: lon.between(w, e) & lat.between(s, n)
    (name, box), *rest = regions_by_area()
    return reduce(lambda acc, kv: acc.when(inside(*kv[1]), kv[0]), rest, F.when(inside(*box), name))


def primary_region(lon: Column, lat: Column) -> Column:
    """The region of a point: that of the smallest box, unless a rule parts the regions whose boxes it lies in. Null outside."""
    inside = {name: lon.between(w, e) & lat.between(s, n) for name, (w, s, e, n) in REGION_BOXES.items()}
    both = lambda *names: reduce(lambda a, b: a & b, (inside[n] for n in names))
    bank = reduce(lambda acc, b: acc.when(lon >= b[0], lat >= b[1]), NORTH_BANK, F.when((lon < -76.5) | (lon > -74.5), False)).otherwise(False)
    rule = F.when(both("ab", "bc"), F.when(F.when(lat >= 54, lon < -120).otherwise(lon < -116.4), "bc").otherwise("ab"))
    for a, b, meridian, west, east in WEST_EAST:
        rule = rule.when(both(a, b), F.when(lon < meridian, west).otherwise(east))
    rule = rule.when(both("on", "qc"), F.when((lon >= -74.5) | ((lat >= 45.9) & (lon >= -76.0)) | bank, "qc").otherwise("on"))
    bridge = F.when(lat < 46.0, "nb").when(lon >= -63.75, "pe").otherwise("nb")
    isthmus = F.when(lon >= -64.27, "ns").otherwise("nb")
    rule = rule.when(both("ns", "nb", "pe"), F.when(lat < 46.0, isthmus).when(lon >= -63.75, "pe").otherwise("nb"))
    rule = rule.when(both("ns", "pe"), "pe").when(both("ns", "nb"), isthmus).when(both("nb", "pe"), bridge)
    valley = F.when((lon <= -68.45) | ((lat >= 47.7) & (lon <= -68.2)), "qc").when((lon <= -67.2) & (lat >= 47.0), "nb")
    return F.coalesce(rule.when(both("nb", "qc"), valley), smallest_region(lon, lat))


def region_family(region: Column) -> Column:
    """Regions of one province: those named after it."""
    low = F.lower(region)
    return F.when((low == "qc") | low.startswith("qc-"), "qc").otherwise(low)


def heading(degrees: Column) -> Column:
    """A compass direction in [0, 360); null for what isn't a number."""
    value = degrees.cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value), F.pmod(value, F.lit(360.0)))


def escaped_xml(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)
