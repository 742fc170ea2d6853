"""Classification of provincial and forest roads, display overlays and trails, as column expressions.

Nulls count as empty texts. A reason means that the row is out; its other fields then mean nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.functions.source_rules import first_match, has

# Patterns (case is ignored), names, the longest note that is about one road, keys of access tags.
ATTRIBUTES_EXCLUDED = (("closed|decommission|abandoned|private|restricted|no.?motor", "restricted_or_closed"), ("cutline|cut.?line|seismic", "cutline_not_routable"))
ATTRIBUTES_SURFACES = (("paved|asphalt|concrete", "paved"), ("gravel|unpaved|dirt|earth", "gravel"), ("track|trail", "track"))
SHUT_FRENCH, SHORT_NOTE = "fermé|ferme|closed|abandon|interdit", 160
FRENCH_SURFACES = (("pav[eé]|asphalte|b[eé]ton", "paved"), ("gravier|gravel|non.?pav", "gravel"), ("sentier|piste|track", "track"))
ENDED, NOT_YET = ("RETIRED", "DEACTIVATED", "CANCELLED"), ("PENDING", "PROPOSED", "APPLICATION")
OPEN_KEYS = ("motorcycle", "atv", "motor_vehicle", "vehicle")
OPEN, SHUT = "^(yes|designated|permissive|destination)$", "^(no|private)$"
GRADES = {"grade1": "g2", "grade2": "g2", "grade3": "g3", "grade4": "g4", "grade5": "g5"}

Attributes = Callable[[str], Column]


def _text(props: Attributes) -> Attributes:
    return lambda name: F.coalesce(props(name).cast("string"), F.lit(""))


def free_attributes(row: Column) -> Column:
    """Struct (reason, surface) of a row whose attributes aren't named: rules read the whole struct as JSON."""
    text = F.to_json(row)
    return F.struct(first_match(text, ATTRIBUTES_EXCLUDED).alias("reason"), first_match(text, ATTRIBUTES_SURFACES, "resource").alias("surface"))


def resource_road(props: Attributes) -> Column:
    """Struct (reason, surface): resource roads are gravel; roads of conventional classes are left to other sources."""
    get = _text(props)
    kind = F.lower(get("NATIONAL_ROAD_CLASS"))
    bush = kind.rlike("resource|recreation")
    closed = (F.trim(get("YEAR_DECOMMISSIONED")) != "") | has(get("CLOSED_STATE"), "closed|decommission|abandon") | F.lower(get("PRIVATE_ROAD_IND")).isin("yes", "y", "true")
    usual = kind.rlike("freeway|expressway|arterial|collector|^local$|local.?road")
    gravel = kind.rlike("gravel|unpaved|unknown|other|access") | (kind == "")
    return F.struct(F.when(closed, "restricted_or_closed").when(~bush & (usual | ~gravel), "orn_or_conventional_skip").alias("reason"), F.lit("gravel").alias("surface"))


def multi_use_road(props: Attributes) -> Column:
    """Struct (reason, surface, road_class); long notes are legal notices and say nothing about the road."""
    get = _text(props)
    notes = F.when(F.length(get("Notes")) < SHORT_NOTE, get("Notes")).otherwise("")
    kind = F.coalesce(*(F.nullif(get(n), F.lit("")) for n in ("CaractRte", "Cls_CheFor", "ClsRte", "Che_Multi")), F.lit(""))
    surface = first_match(F.lower(kind), FRENCH_SURFACES, "resource")
    shut = F.lower(F.concat_ws(" ", get("Gestion"), get("Stat_Pont"), notes)).rlike(SHUT_FRENCH)
    return F.struct(F.when(shut, "restricted_or_closed").alias("reason"), surface.alias("surface"), F.when(surface == "paved", "local").when(surface == "track", "track").otherwise("resource").alias("road_class"))


def tenure_reason(props: Attributes) -> Column:
    """Why a tenure's road is out, by its life cycle; null if it is active."""
    get = _text(props)
    life = F.upper(F.coalesce(F.nullif(get("LIFE_CYCLE_STATUS_CODE"), F.lit("")), get("FILE_STATUS_CODE")))
    return F.when(life.isin(*NOT_YET), "pending_or_proposed").when(life.isin(*ENDED) | (get("RETIREMENT_DATE") != ""), "deactivated_or_closed")


def display_class(props: Attributes) -> Column:
    """Struct (track_class, confidence) of an inventory's row on the map: two classes only."""
    get = _text(props)
    gravel = has(F.concat_ws(" ", get("PAVSTATUS"), get("UNPAVSURF")), "unpaved|gravel|earth|dirt")
    told = gravel | has(F.concat_ws(" ", get("PAVSTATUS"), get("PAVSURF")), "paved|asphalt|concrete")
    bush = has(get("ROADCLASS"), "resource|recreation")
    return F.struct(F.when(gravel | (~told & bush), "gravel").otherwise("paved").alias("track_class"), F.when(told, "pavement-field").otherwise("roadclass-inferred").alias("confidence"))


def trail(props: Attributes) -> Column:
    """Struct (kind, keep, status, detail) of a way of a trail overlay; the first key that decides is the detail."""
    get = _text(props)
    highway, grade = get("highway"), F.lower(get("tracktype"))
    first = lambda keys, pattern: F.coalesce(*(F.when(has(get(k), pattern), F.concat(F.lit(f"{k}="), get(k))) for k in keys))
    yes, no = first(OPEN_KEYS, OPEN), first((*OPEN_KEYS, "access"), SHUT)
    kind = (F.when(has(get("motorcycle"), OPEN) & (highway == "path"), "single").when(has(get("atv"), OPEN) | grade.isin("grade4", "grade5"), "atv").when(highway.isin("path", "bridleway"), "single")
            .when(has(get("surface"), "^(paved|asphalt|concrete|paving_stones|sett|cobblestone)$") | (grade == "grade1"), "paved").otherwise("gravel"))
    return F.struct(kind.alias("kind"), (highway.isin("track", "path", "bridleway") & (kind != "paved")).alias("keep"),
                    F.when(yes.isNotNull(), "allowed").when(no.isNotNull(), "restricted").otherwise("unknown").alias("status"), F.coalesce(yes, no, F.lit("no OSM motor access tag")).alias("detail"))


def grade_class(props: Attributes) -> Column:
    """Difficulty of a way by its grade; paths are single."""
    get = _text(props)
    grades = F.create_map(*(F.lit(x) for kv in GRADES.items() for x in kv))
    return F.when(get("highway").isin("path", "bridleway"), "single").otherwise(F.coalesce(F.when(get("highway") == "track", F.element_at(grades, get("tracktype"))), F.lit("unknown")))
