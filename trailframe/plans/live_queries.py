"""Queries of riders, alerts and groups, with the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.operators import groups as rider_groups
from trailframe.plans.rule_text_queries import _dealt, _dealt_sql
from trailframe.streaming import riders

KINDS = ["location", "presence", "location", "database", "location", "off", "presence", "database", "location", "location", "database"]
STATES = ["available", None, "stuck", "breakdown", "available", None, "injured"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what riders send: kinds by id, some without a place."""
    k = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        "user_id", "ts", k, _dealt(k, KINDS).alias("kind"), F.when(k % 7 != 0, F.lit(-66.0) + k % 100 / 100.0).alias("lng"), F.when(k % 5 != 0, F.lit(44.0) + k % 90 / 100.0).alias("lat"), F.when(k % 3 == 0, (k % 900 - 300).cast("double")).alias("heading"),
        _dealt(k, STATES).alias("status"), F.when(k % 4 == 0, F.concat(F.lit("Rider "), F.col("user_id").cast("string"))).alias("name"), _dealt(k, ["g1", None, "g2"]).alias("group_id"), (k % 6 > 1).alias("sharing"))


def tpres_riders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of every rider at the end of the log; rider 7 is who asks."""
    return riders.riders_known(updates(spark, sf_dir), F.lit(7)).select("user_id", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "heading", "status", "name", "group_id", "label")


def talrt_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return riders.alerts(updates(spark, sf_dir)).select("alert_id", "user_id", "status", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created", "updated")))


def tdism_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that are left when those of every third user are dismissed."""
    found = riders.alerts(updates(spark, sf_dir))
    return riders.dismissed(found, found.where("user_id % 3 = 0")).select("alert_id", "user_id", "status")


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups from suppliers, members from customers (two groups each; a group's owner is in it), presence from events."""
    s, c = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "customer")
    n = s.agg(F.count("*")).scalar()
    key = F.col("s_suppkey")
    groups = s.select(key.alias("group_id"), F.col("s_name").alias("name"), (key * 3).alias("owner_id"), F.when(key % 7 == 0, F.timestamp_seconds(key)).alias("deleted_at"))
    two = F.explode(F.array((F.col("c_custkey") * 5) % n, (F.col("c_custkey") * 11 + 3) % n)).alias("group_id")
    joined = c.select(F.col("c_custkey").alias("user_id"), two).distinct()
    owners = groups.select(F.col("owner_id").alias("user_id"), "group_id", F.lit("owner").alias("role"))
    members = owners.unionByName(joined.join(owners.select("user_id", "group_id"), ["user_id", "group_id"], "left_anti").withColumn("role", F.lit("member")))
    presence = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen")).select("user_id", F.when(F.col("user_id") % 13 > 0, F.col("seen")).alias("last_seen"))
    return groups, members, presence


def q01_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "").when(k % 7 == 0, F.repeat(F.lit("x"), 81)).when(k % 11 > 0, F.col("p_name"))
    ok = rider_groups.valid_presence((k % 200 - 100).cast("double"), F.when(k % 3 > 0, (k % 400 - 200).cast("double")), _dealt(k, ["available", "lost", None, "stuck"]))
    return _table(spark, sf_dir, "part").select(k, rider_groups.valid_group(name).alias("group_ok"), ok.alias("presence_ok"))


def q02_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tries of customers on groups that are members', and owners' tries."""
    groups, members, _ = tables(spark, sf_dir)
    tries = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), (F.col("c_custkey") * 5 % groups.agg(F.count("*")).scalar()).alias("group_id"))
    mine = rider_groups.is_member(tries, members).select("uid", "group_id", F.lit("any").alias("role"))
    return mine.unionByName(rider_groups.is_member(tries, members, "owner").select("uid", "group_id", F.lit("owner").alias("role")))


def q03_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, members, _ = tables(spark, sf_dir)
    asked = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("uid"))  # who asks
    return rider_groups.visible_groups(groups, members, asked)


def q03_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, members, _ = tables(spark, sf_dir)
    k = F.col("user_id")
    tries = members.select(F.when(k % 3 == 0, k).otherwise(F.col("group_id") * 3).alias("uid"), "group_id", F.when(k % 2 == 0, k).otherwise(k + 1).alias("member_id"), _dealt(k, ["join", "leave", "rename", "delete", "steal"]).alias("action"))
    return rider_groups.may_change(groups, members, tries)


def q04_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    topic = F.when(k % 4 == 0, "group:").when(k % 4 == 1, F.concat(F.lit("group:"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("team:"), k.cast("string"))).otherwise(F.concat(F.lit("group:"), k.cast("string"), F.lit(":x")))
    return _table(spark, sf_dir, "part").select(k, rider_groups.topic_group(topic).alias("group_id"))


def q06_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups after owners (and others) delete every third, and members after some leave."""
    groups, members, _ = tables(spark, sf_dir)
    tries = groups.where("group_id % 3 = 0").select("group_id", F.when(F.col("group_id") % 2 == 0, F.col("owner_id")).otherwise(F.col("owner_id") + 1).alias("uid"))
    ended = rider_groups.soft_deleted(groups, tries, F.timestamp_seconds(F.lit(1_000_000)))
    stay = rider_groups.without_left(members, members.where("user_id % 4 = 0")).groupBy("group_id").agg(F.count("*").alias("members"))
    return ended.join(stay, "group_id", "left").select("group_id", F.unix_seconds("deleted_at").alias("deleted"), F.coalesce("members", F.lit(0)).alias("members"))


def q08_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select("s_suppkey", rider_groups.invite_code(F.col("s_name")).alias("code"))


def j17_group_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, members, presence = tables(spark, sf_dir)
    now = presence.agg(F.max("last_seen")).scalar()
    return rider_groups.group_list(groups, members, presence, now)


def j18_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with their profile's name; the owners may have none."""
    _, members, _ = tables(spark, sf_dir)
    names = _table(spark, sf_dir, "customer").where("c_custkey % 9 > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return members.join(names, "user_id", "left").select("user_id", "group_id", "role", F.coalesce("name", F.lit("Rider")).alias("name"))


QUERIES = {
    "TPRES_riders": tpres_riders, "TALRT_kept": talrt_kept, "TDISM_left": tdism_left, "Q01_valid": q01_valid, "Q02_members": q02_members, "Q03_visible": q03_visible, "Q03_changes": q03_changes, "Q04_topics": q04_topics,
    "Q06_endings": q06_endings, "Q08_codes": q08_codes, "J17_group_list": j17_group_list, "J18_names": j18_names,
}

_GROUPS = """WITH k AS (SELECT count(*) AS n FROM supplier), g AS (SELECT s_suppkey AS group_id, s_name AS name, s_suppkey * 3 AS owner_id, CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey END AS deleted FROM supplier),
j AS (SELECT c_custkey AS user_id, c_custkey * 5 % n AS group_id FROM customer, k UNION SELECT c_custkey, (c_custkey * 11 + 3) % n FROM customer, k),
m AS (SELECT owner_id AS user_id, group_id, 'owner' AS role FROM g UNION ALL SELECT user_id, group_id, 'member' FROM j WHERE (user_id, group_id) NOT IN (SELECT (owner_id, group_id) FROM g))"""
_ALERTS = f"WITH u AS (SELECT *, {_dealt_sql('event_id', STATES)} AS status FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0), f AS (SELECT *, -66.0::DOUBLE + event_id % 100 / 100.0::DOUBLE AS lng, 44.0::DOUBLE + event_id % 90 / 100.0::DOUBLE AS lat FROM u WHERE status IN ('breakdown', 'stuck', 'injured')), a AS (SELECT user_id, status, min((ts, event_id)) AS first, max((ts, event_id)) AS last, arg_max(lng, (ts, event_id)) AS lng, arg_max(lat, (ts, event_id)) AS lat FROM f GROUP BY 1, 2)"
_ID = "user_id || ':' || status || ':' || first[2] AS alert_id"
ORACLE_SQL = {
    "TALRT_kept": _ALERTS + f" SELECT {_ID}, user_id, status, round(lng, 6) AS lng, round(lat, 6) AS lat, strftime(first[1], '%Y-%m-%d %H:%M:%S') AS created, strftime(last[1], '%Y-%m-%d %H:%M:%S') AS updated FROM a",
    "TDISM_left": _ALERTS + f" SELECT {_ID}, user_id, status FROM a WHERE user_id % 3 <> 0",
    "Q01_valid": f"WITH p AS (SELECT *, {_dealt_sql('p_partkey', ['available', 'lost', None, 'stuck'])} AS s FROM part) SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 > 0 AND length(p_name) BETWEEN 1 AND 80 AS group_ok, p_partkey % 200 - 100 BETWEEN -90 AND 90 AND (p_partkey % 3 = 0 OR p_partkey % 400 - 200 BETWEEN -180 AND 180) AND coalesce(s IN ('available', 'stuck'), false) AS presence_ok FROM p",
    "Q02_members": _GROUPS + ", t AS (SELECT c_custkey AS uid, c_custkey * 5 % n AS group_id FROM customer, k) SELECT uid, t.group_id, 'any' AS role FROM t JOIN m ON uid = user_id AND t.group_id = m.group_id UNION ALL SELECT uid, t.group_id, 'owner' FROM t JOIN g ON uid = owner_id AND t.group_id = g.group_id",
    "Q03_visible": _GROUPS + " SELECT owner_id AS uid, group_id FROM g WHERE deleted IS NULL AND owner_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION SELECT user_id, group_id FROM m WHERE group_id IN (SELECT group_id FROM g WHERE deleted IS NULL) AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)",
    "Q03_changes": _GROUPS + f", t AS (SELECT CASE WHEN user_id % 3 = 0 THEN user_id ELSE group_id * 3 END AS uid, group_id, user_id + user_id % 2 AS member_id, {_dealt_sql('user_id', ['join', 'leave', 'rename', 'delete', 'steal'])} AS action FROM m) SELECT uid, t.group_id, member_id, action, CASE WHEN action IN ('join', 'leave') THEN uid = owner_id OR uid = member_id WHEN action IN ('rename', 'delete') THEN uid = owner_id ELSE false END AS allowed FROM t JOIN g USING (group_id)",
    "Q04_topics": "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 3) THEN CAST(p_partkey AS VARCHAR) END AS group_id FROM part",
    "Q06_endings": _GROUPS + ", s AS (SELECT group_id, count(*) AS members FROM m WHERE user_id % 4 <> 0 OR role = 'owner' GROUP BY 1) SELECT group_id, CASE WHEN deleted IS NOT NULL THEN deleted WHEN group_id % 6 = 0 THEN 1000000 END AS deleted, coalesce(members, 0) AS members FROM g LEFT JOIN s USING (group_id)",
    "Q08_codes": "SELECT s_suppkey, substr(sha1(s_name), 1, 6) AS code FROM supplier",
    "J17_group_list": _GROUPS + ", p AS (SELECT user_id, CASE WHEN user_id % 13 > 0 THEN max(ts) END AS seen FROM events GROUP BY 1), c AS (SELECT group_id, count(*) AS members, count(*) FILTER (p.user_id IS NOT NULL AND (seen IS NULL OR seen > (SELECT max(seen) FROM p) - INTERVAL 120 SECONDS)) AS live FROM m LEFT JOIN p USING (user_id) GROUP BY 1) SELECT group_id, name, coalesce(members, 0) AS members, coalesce(live, 0) AS live FROM g LEFT JOIN c USING (group_id) WHERE deleted IS NULL",
    "J18_names": _GROUPS + " SELECT user_id, group_id, role, coalesce(c_name, 'Rider') AS name FROM m LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 > 0) ON c_custkey = user_id",
}
