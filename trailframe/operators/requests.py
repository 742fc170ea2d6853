"""Requests for routes: what is asked for checked, the regions between its ends, and what is said about a route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import network_rules as rules
from trailframe.operators.components import checkpointed

# Profiles, metres of a match by default, with permissive access only, and at most; codes of failures with their HTTP status.
PROFILES, MATCH_M, MOST_MATCH_M = ("direct", "balanced", "dirt", "cleanest"), 250.0, 750.0
STATUS = {"invalid_profile": 400, "invalid_locations": 400, "match_limit_too_large": 400, "region_unknown": 422, "match_failed": 422, "disconnected_components": 422, "no_route": 422, "chain_hop_failed": 422,
          "graph_memory_pressure": 503, "graph_load_failed": 503}


def checked(requests: DataFrame) -> DataFrame:
    """Requests (profile, locations: array of (lon, lat), match_m, permissive, unknown) with `error` (the first thing that is wrong), `match_m` and the policy in effect.

    Other profiles than those known, fewer than two places with numbers and more than 750 metres are errors; 250 metres are taken if none are given."""
    fine = lambda p: p["lon"].isNotNull() & p["lat"].isNotNull() & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"])
    places = F.coalesce(F.size("locations") >= 2, F.lit(False)) & F.forall("locations", fine)
    error = F.when(~F.coalesce(F.col("profile").isin(*PROFILES), F.lit(False)), "invalid_profile").when(~F.coalesce(places, F.lit(False)), "invalid_locations").when(F.col("match_m") > MOST_MATCH_M, "match_limit_too_large")
    policy = rules.normalized_policy(F.col("permissive"), F.col("unknown"), F.col("profile"))
    return requests.withColumns({"error": error, "match_m": F.coalesce("match_m", F.lit(MATCH_M)), "policy": policy})


def http_status(error: Column) -> Column:
    """200 without an error, the error's own status, 500 for others."""
    known = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    return F.when(error.isNull(), 200).otherwise(F.coalesce(F.try_element_at(known, error), F.lit(500)))


def route_warnings(unknown_allowed: Column, profile: Column, unknown_m: Column, paved_m: Column, legs: Column, avoided: Column) -> Column:
    """The codes of what a rider should know: unknown access allowed and used, pavement on a dirt route, access legs, edges avoided."""
    say = lambda test, code: F.when(F.coalesce(test, F.lit(False)), F.lit(code))
    return F.array_compact(F.array(
        say(unknown_allowed, "unknown_access_enabled"), say(unknown_m > 0, "unknown_access_used"), say((profile == "dirt") & (paved_m > 0), "unavoidable_pavement"), say(legs > 0, "access_legs"), say(avoided > 0, "avoided_edges")))


def region_paths(pairs: DataFrame, most: int = 12) -> DataFrame:
    """(start, goal, path) of the shortest ways over neighbouring regions; of equal ones the first in the order of the neighbours.

    All pairs (start, goal) are searched in the same rounds, with one path kept for each start and region."""
    spark = pairs.sparkSession
    near = spark.createDataFrame([(a, b, k) for a, bs in rules.REGION_NEIGHBOURS.items() for k, b in enumerate(bs)], "at string, next string, k int")
    known = pairs.select("start").distinct().select("start", F.col("start").alias("at"), F.array("start").alias("path"), F.array().cast("array<int>").alias("ranks"))
    frontier = known
    for _ in range(most):
        ahead = frontier.join(F.broadcast(near), "at").select("start", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"), F.concat("ranks", F.array("k")).alias("ranks"))  # a row for each border
        new = ahead.join(known.select("start", "at"), ["start", "at"], "left_anti").groupBy("start", "at").agg(F.min(F.struct("ranks", "path")).alias("first")).select("start", "at", "first.path", "first.ranks")
        frontier = checkpointed(new)
        known = checkpointed(known.unionByName(frontier))
        if frontier.isEmpty():
            break
    return pairs.join(known.select("start", F.col("at").alias("goal"), "path"), ["start", "goal"], "left")


def corridor(requests: DataFrame) -> DataFrame:
    """(query, regions): the regions of each request (query, region) and all on the shortest ways between any two of them, sorted."""
    own = requests.select("query", "region").distinct()
    pairs = own.select("query", F.col("region").alias("start")).join(own.select("query", F.col("region").alias("goal")), "query").where("start < goal")  # few regions a request
    paths = region_paths(pairs.select("start", "goal").distinct())
    between = pairs.join(paths, ["start", "goal"]).select("query", F.explode("path").alias("region"))
    return own.unionByName(between).groupBy("query").agg(F.array_sort(F.collect_set("region")).alias("regions"))


def planned(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """(query, mode, regions, missing, error): which graphs a request loads, and how.

    Requests are (query, region, places: points (lon, lat), prefer_longhaul, no_chain, no_longhaul, server, legacy); flags that are null
    count as unset. `packs` (region, longhaul) are those at hand, "canada" being the long-haul pack of the whole country.
    A region that is named goes before the places; `missing` are the regions on the way whose pack isn't there."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    longhaul = flag("prefer_longhaul") | flag("server")
    places = requests.select("query", F.explode("places").alias("p")).select("query", rules.primary_region(F.col("p.lon"), F.col("p.lat")).alias("region")).where("region IS NOT NULL").distinct()
    own = checkpointed(places.groupBy("query").agg(F.array_sort(F.collect_set("region")).alias("hit"), F.count_distinct(rules.region_family(F.col("region"))).alias("families")))  # a few places each
    ways = corridor(own.select("query", F.explode("hit").alias("region"))).withColumnRenamed("regions", "way")
    at_hand = packs.groupBy("longhaul").agg(F.collect_set("region").alias("there"))  # two rows of region names
    there = lambda kind: F.coalesce(at_hand.where(F.col("longhaul") == kind).select("there").scalar(), F.array().cast("array<string>"))
    rows = requests.join(own, "query", "left").join(ways, "query", "left").withColumns({"_long": there(True), "_full": there(False)})
    rows = rows.withColumn("_there", F.when(longhaul, F.col("_long")).otherwise(F.col("_full")))
    gone, n, named = F.array_except("way", "_there"), F.size("way"), F.col("region").isNotNull()
    across = ~flag("server") & (n >= 4) & F.array_contains("_long", "canada") & ~flag("no_longhaul") & F.array_contains("way", "ns") & F.array_contains("way", "bc")
    chain = ~flag("no_chain") & (F.col("families") != 1) & (n >= 2) & (flag("server") | (n >= 4))
    kind = F.when(longhaul, "longhaul").otherwise("regional")
    mode = (F.when(named, F.when(longhaul, "explicit-longhaul").otherwise("explicit")).when(F.col("hit").isNull(), None)
            .when(flag("legacy") & (F.array_join("hit", ",") == "ns"), "legacy-production").when(across, "canada-longhaul-local").when(chain, "canada-chain")
            .otherwise(F.concat(F.when(n > 1, "multi-").otherwise(""), kind, F.when(F.size(gone) > 0, "-remote").otherwise("-local"))))
    regions = F.when(named, F.array(F.lower("region"))).when(mode == "legacy-production", F.col("hit")).otherwise(F.col("way"))
    missing = F.when(mode.startswith("multi-"), gone)
    return rows.select("query", mode.alias("mode"), regions.alias("regions"), missing.alias("missing"), F.when(~named & F.col("hit").isNull(), "region_unknown").alias("error"))
