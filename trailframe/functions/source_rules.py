"""Classification of source features (road inventories, descriptions, way tags) as column expressions.

Rules are tables of patterns, tried in order; the first that matches decides. Nulls count as empty texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.functions.classify import edge_id

# Patterns (case is ignored) and what they stand for.
INVENTORY_EXCLUDED = (("Abandoned", "abandoned"), ("Ferry", "ferry_as_roadseg"))
INVENTORY_STRUCTURES = (("Bridge", "bridge"), ("Tunnel", "tunnel"), ("Barrier|Blocked", "blocked_passage"))
INVENTORY_CLASSES = (
    ("Freeway|Expressway", "freeway"), ("Arterial", "arterial"), ("Collector", "collector"), ("Local|Alley|Street", "local"),
    ("Resource", "resource"), ("Recreation", "recreation"), ("Ramp", "ramp"), ("Service", "service"),
)
INVENTORY_DIRECTIONS = (("Same direction|One direction|Positive", "forward"), ("Opposite|Negative", "reverse"))
DESCRIPTION_EXCLUDED = (
    ("No Vehicular Traffic", "no_vehicular_traffic"), (r"\bTRAIL\b", "non_motorized_trail"), ("Railroad|Railway", "railway"), ("Ferry", "ferry"),
    ("Driveway", "driveway"), ("Median Crossover", "median_crossover"), ("Service Lane", "service_lane"), (r"\bDam\b", "dam"),
    ("Pedestrian|Footpath|Sidewalk", "pedestrian_only"), ("Bicycle|Cycleway", "bicycle_only"),
)
DESCRIPTION_STRUCTURES = ((r"\bBRIDGE\b", "bridge"), (r"\bTUNNEL\b", "tunnel"), (r"\bFord\b", "ford"))
WAY_HIGHWAYS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link",
    "unclassified", "residential", "living_street", "road", "service", "track",
)
WAY_CLASSES = {
    "motorway": "freeway", "trunk": "arterial", "primary": "arterial", "secondary": "collector", "tertiary": "local", "unclassified": "local",
    "road": "local", "track": "track", "service": "service", "residential": "service", "living_street": "service",
}
WAY_ON_FOOT = ("footway", "cycleway", "path", "pedestrian", "steps")
SURFACE_TAGS = {
    "paved": ("paved", "asphalt", "concrete", "concrete:plates", "concrete:lanes", "paving_stones", "sett", "cobblestone", "metal", "wood"),
    "gravel": ("gravel", "fine_gravel", "compacted", "pebblestone", "stone", "chipseal"),
    "resource": ("dirt", "ground", "earth", "mud", "sand", "grass", "unpaved", "woodchips"),
}


def clean(text: Column) -> Column:
    return F.trim(F.coalesce(text.cast("string"), F.lit("")))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def first_match(text: Column, rules: tuple[tuple[str, str], ...], default: str | None = None) -> Column:
    """The name of the first pattern found in `text`."""
    (pattern, name), *rest = rules
    found = reduce(lambda acc, r: acc.when(has(text, r[0]), r[1]), rest, F.when(has(text, pattern), name))
    return found if default is None else found.otherwise(default)


def inventory_road(props) -> Column:
    """Struct (reason, surface, confidence, road_class, access, structure, direction) of a national inventory's row.

    `props(name)` gives an attribute. With a reason the row is out, and its other fields mean nothing."""
    get = lambda name: clean(props(name))
    kind, status, unpaved = get("ROADCLASS"), get("PAVSTATUS"), get("UNPAVSURF")
    gravel = has(status, "Unpaved") | has(unpaved, "gravel|earth|dirt|unpaved")
    paved = has(status, r"\bPaved\b") | has(get("PAVSURF"), "asphalt|concrete|^paved$")
    bush = has(kind, "Resource|Recreation")
    return F.struct(
        first_match(kind, INVENTORY_EXCLUDED).alias("reason"),
        F.when(gravel, "gravel").when(paved, "paved").when(bush, "resource").otherwise("unknown").alias("surface"),
        F.when(gravel | paved, "high").when(bush, "medium").otherwise("low").alias("confidence"),
        first_match(kind, INVENTORY_CLASSES, "unknown").alias("road_class"),
        F.when(bush & ~gravel & ~paved, "motorized_unknown").otherwise("motorized_permissive").alias("access"),
        first_match(get("STRUCTTYPE"), INVENTORY_STRUCTURES, "none").alias("structure"),
        first_match(get("TRAFFICDIR"), INVENTORY_DIRECTIONS, "both").alias("direction"))


def described_road(description: Column, resource: str = "resource") -> Column:
    """Struct (reason, surface, road_class, structure, access, confidence, seasonal) of a topographic description; `resource` names that surface."""
    d = clean(description)
    structure = first_match(d, DESCRIPTION_STRUCTURES, "none")
    unpaved = has(d, r"\bUnpaved\b")
    surface = (F.when(has(d, r"\bPaved\b") & ~unpaved, "paved").when(has(d, "Resource Access"), resource).when(has(d, r"\bTRACK\b"), "track")
               .when(has(d, "Unpaved"), "gravel").when(structure != "none", "unknown"))
    abandoned, track = has(d, "Abandoned"), surface == "track"
    vague = has(d, "Indefinite|Approximate")
    solid = surface.isin("paved", "gravel", resource)
    return F.struct(
        F.when(d == "", "missing_feat_desc").otherwise(F.coalesce(first_match(d, DESCRIPTION_EXCLUDED), F.when(surface.isNull(), "unclassified_description"))).alias("reason"),
        surface.alias("surface"),
        F.when(surface == "paved", F.when(has(d, r"\bRAMP\b"), "ramp").otherwise("local")).when(surface == resource, "resource").when(track, "track").when(surface == "gravel", "local").otherwise("unknown").alias("road_class"),
        structure.alias("structure"),
        F.when(abandoned, "motorized_restricted").when(solid, "motorized_permissive").otherwise("motorized_unknown").alias("access"),
        F.when(abandoned | (track & vague), "low").when(solid & ~((surface == resource) & has(d, "Dry Weather")), "high").otherwise("medium").alias("confidence"),
        has(d, "Dry Weather|Seasonal|Winter").alias("seasonal"))


def tagged_way(props) -> Column:
    """Struct (reason, surface, road_class, structure) of a way's tags; `props(name)` gives a tag.

    Links of main roads are ramps. Ways without a surface tag: tracks and service roads are resource, main roads paved."""
    tag = lambda name: F.lower(clean(props(name)))
    highway, surface_tag = tag("highway"), tag("surface")
    motor = F.coalesce(*(F.nullif(tag(n), F.lit("")) for n in ("motor_vehicle", "motorcar", "motorcycle")), F.lit(""))
    closed = reduce(lambda a, b: a | b, (v.isin("no", "private") for v in (tag("access"), motor, tag("vehicle"))))
    gone = (tag("abandoned") == "yes") | (tag("disused") == "yes") | (highway == "abandoned")
    may_ride = motor.rlike("yes|designated|permissive|destination") | tag("motorcycle").rlike("yes|designated|permissive")
    main = F.regexp_replace(highway, "_link$", "")
    classes = F.create_map(*(F.lit(x) for kv in WAY_CLASSES.items() for x in kv))
    road_class = F.when(highway.endswith("_link"), "ramp").otherwise(F.coalesce(F.element_at(classes, main), F.lit("local")))
    tagged = reduce(lambda acc, kv: acc.when(surface_tag.isin(*kv[1]), kv[0]), list(SURFACE_TAGS.items())[1:], F.when(surface_tag.isin(*SURFACE_TAGS["paved"]), "paved"))
    untagged = F.when(highway.isin("track", "service"), "resource").when(main.isin("motorway", "trunk", "primary"), "paved").otherwise("unknown")
    return F.struct(
        F.when(closed, "access_denied").when(gone, "abandoned").when(highway.isin(*WAY_ON_FOOT) & ~may_ride, "foot_bike_only").when(~highway.isin(*WAY_HIGHWAYS), "highway_excluded").alias("reason"),
        F.coalesce(tagged, untagged).alias("surface"),
        F.when((tagged == "resource") & (road_class == "local"), "resource").otherwise(road_class).alias("road_class"),
        F.when(tag("bridge") == "yes", "bridge").when(tag("tunnel") == "yes", "tunnel").otherwise("none").alias("structure"))


# Road classes of packed surfaces; prefixes of ids that stay, of those that are renamed, and of new ones.
PACKED_CLASSES = {"resource": "resource", "track": "track", "paved": "local", "gravel": "local"}
PACKED_ID, OLD_ID, NEW_ID = "ns-", "ns-gov-", "ns-nstdb-"


def packed_feature(props, first: Column, last: Column) -> Column:
    """Struct (reason, edge_id, record, surface, road_class, access, structure, confidence, seasonal) of a feature of a government pack.

    Classes that are there already hold; without a surface or an access the description decides. `props(name)` gives an
    attribute, `first` and `last` are the line's ends as texts, null without a line. Ids of the province stay; others are made of record and ends."""
    get = lambda name: F.nullif(props(name), F.lit(""))
    text = F.coalesce(get("sourceDescription"), get("feat_desc"), F.lit(""))
    by_text = described_road(text)
    there = F.coalesce(get("surfaceClass"), get("trackClass"))
    surface, access = F.when(there == "access", "resource").otherwise(there), get("accessClass")
    packed = surface.isNotNull() & access.isNotNull()
    of = lambda own, name: F.when(packed, own).otherwise(by_text[name])
    (kind, road), *rest = PACKED_CLASSES.items()
    road_class = reduce(lambda acc, kv: acc.when(surface == kv[0], kv[1]), rest, F.when(surface == kind, road)).otherwise("unknown")
    record, given = F.coalesce(get("sourceRecordId"), get("edgeId"), F.lit("unknown")), get("edgeId")
    own_id = F.when(given.startswith(PACKED_ID), F.regexp_replace(given, f"^{OLD_ID}", NEW_ID)).otherwise(edge_id(NEW_ID, record, F.lit("0"), first, last))
    out_access = of(access, "access")
    reason = F.when(first.isNull(), "no_usable_geometry").otherwise(F.coalesce(F.when(~packed, by_text["reason"]), F.when(out_access == "motorized_excluded", "motorized_excluded")))
    return F.struct(
        reason.alias("reason"), own_id.alias("edge_id"), record.alias("record"), of(surface, "surface").alias("surface"), of(road_class, "road_class").alias("road_class"), out_access.alias("access"),
        of(F.coalesce(get("structureType"), F.lit("none")), "structure").alias("structure"), of(F.coalesce(get("confidence"), F.lit("medium")), "confidence").alias("confidence"),
        of(F.coalesce(props("seasonal") == "true", F.lit(False)), "seasonal").alias("seasonal"))
