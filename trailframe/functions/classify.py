"""Classification of road attributes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the surface and access codes, and per cent costs of the balanced profile used by the road-network queries.
SURFACES = ("paved", "gravel", "access", "track", "unknown")
ACCESSES = ("motorized_verified", "motorized_permissive", "motorized_unknown", "motorized_restricted", "motorized_excluded")


def first_known(*values: Column) -> Column:
    """The first value that isn't blank, `unknown` or `none`, else the empty string."""
    clean = [F.trim(v) for v in values]
    return F.coalesce(*(F.when(~F.lower(v).isin("", "unknown", "none"), v) for v in clean), F.lit(""))


def surface_for_costing(surface: Column) -> Column:
    """The surface that costs are listed for; what isn't a known surface is unknown."""
    known = F.when(surface == "resource", "access").when(surface == "double_track", "track").when(surface.isin(*SURFACES), surface)
    return F.coalesce(known, F.lit("unknown"))


def code_name(code: Column, names: tuple[str, ...], default: str = "unknown") -> Column:
    return F.coalesce(F.get(F.array(*(F.lit(n) for n in names)), code), F.lit(default))


def access_allowed(access: Column, permissive: Column | bool = True, unknown: Column | bool = False, source: Column | None = None) -> Column:
    """Verified always; permissive and unknown access by the policy; restricted and excluded never.

    Roads of the open street map (column `source`, if there) are open whenever permissive ones are, whatever their access."""
    p, u = (x if isinstance(x, Column) else F.lit(x) for x in (permissive, unknown))
    by_access = F.when(access == "motorized_verified", True).when(access == "motorized_permissive", p).when(access == "motorized_unknown", u).otherwise(False)
    return by_access if source is None else F.when(F.coalesce(source, F.lit("")).rlike("(?i)openstreetmap"), p).otherwise(by_access)


def category(amenity: Column, shop: Column, tourism: Column) -> Column:
    """Kind of a point of interest; fuel goes before shops, those before lodging and camping."""
    return F.when(amenity == "fuel", "fuel").when(shop == "alcohol", "liquor").when(tourism.isin("hotel", "motel", "hostel", "guest_house", "chalet"), "lodging").when(tourism.isin("camp_site", "caravan_site"), "campground")


def edge_id(prefix: str, *seed: Column) -> Column:
    """Prefix and the first 12 digits of the SHA-1 of the seed's parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *seed)), 1, 12))
