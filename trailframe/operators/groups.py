"""Groups of riders: valid rows, membership, who may see and change what, and how groups end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles, states, lengths of names; seconds for which a rider counts as live.
ROLES, STATES, NAME_CHARS, LIVE_S = ("owner", "member"), ("available", "breakdown", "injured", "stuck"), (1, 80), 120


def valid_group(name: Column) -> Column:
    return F.coalesce(F.char_length(name).between(*NAME_CHARS), F.lit(False))


def valid_presence(lat: Column, lon: Column, status: Column) -> Column:
    """Places on the globe, or none at all, and a known status."""
    place = F.coalesce(lat.between(-90, 90), F.lit(True)) & F.coalesce(lon.between(-180, 180), F.lit(True))
    return place & F.coalesce(status.isin(*STATES), F.lit(False))


def is_member(rows: DataFrame, members: DataFrame, role: str | None = None) -> DataFrame:
    """Rows (uid, group_id, ...) whose user is in the group, with a role if one is asked for: a semi-join, so that no row is doubled."""
    those = members if role is None else members.where(F.col("role") == role)
    keys = those.select(F.col("user_id").alias("_u"), F.col("group_id").alias("_g"))
    return rows.join(keys, (F.col("uid") == F.col("_u")) & (F.col("group_id") == F.col("_g")), "left_semi")


def visible_groups(groups: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """(uid, group_id) of the groups that users (uid) may see: those they own or are in, unless deleted."""
    alive = groups.where("deleted_at IS NULL")
    own = alive.select(F.col("owner_id").alias("uid"), "group_id")
    through = members.select(F.col("user_id").alias("uid"), "group_id").join(alive.select("group_id"), "group_id", "left_semi").select("uid", "group_id")
    return own.unionByName(through).join(asked, "uid", "left_semi").distinct()


def may_change(groups: DataFrame, members: DataFrame, tries: DataFrame) -> DataFrame:
    """Tries (uid, group_id, member_id, action), each with `allowed`: joining by oneself or by the owner, leaving by oneself or
    being removed by the owner, renaming and deleting by the owner."""
    owners = groups.select("group_id", "owner_id")
    own, self_ = F.col("uid") == F.col("owner_id"), F.col("uid") == F.col("member_id")
    rule = F.when(F.col("action").isin("join", "leave"), own | self_).when(F.col("action").isin("rename", "delete"), own).otherwise(False)
    return tries.join(owners, "group_id", "left").select("uid", "group_id", "member_id", "action", F.coalesce(rule, F.lit(False)).alias("allowed"))


def topic_group(topic: Column) -> Column:
    """The group that a private topic `group:<id>` is of; null for other topics."""
    return F.when(F.split_part(topic, F.lit(":"), F.lit(1)) == "group", F.nullif(F.split_part(topic, F.lit(":"), F.lit(2)), F.lit("")))


def soft_deleted(groups: DataFrame, deleted: DataFrame, now: Column) -> DataFrame:
    """`groups` with `deleted_at` set for those (group_id, uid) that their owners delete; the first deletion stays."""
    marks = deleted.select("group_id", F.col("uid").alias("owner_id"), F.lit(True).alias("_gone")).distinct()
    rows = groups.join(marks, ["group_id", "owner_id"], "left")
    return rows.withColumn("deleted_at", F.when(F.col("_gone"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).select(*groups.columns)


def without_left(members: DataFrame, left: DataFrame) -> DataFrame:
    """Members without those (user_id, group_id) that leave; owners stay."""
    gone = left.select("user_id", "group_id").distinct()
    stay = members.join(gone, ["user_id", "group_id"], "left_anti").unionByName(members.where("role = 'owner'").join(gone, ["user_id", "group_id"], "left_semi"))
    return stay.select(*members.columns)


def group_list(groups: DataFrame, members: DataFrame, presence: DataFrame, now: Column) -> DataFrame:
    """(group_id, name, members, live): riders seen in the last two minutes, or never stamped, are live."""
    joined = members.join(presence.select("user_id", "last_seen", F.lit(True).alias("_here")), "user_id", "left")
    live = F.col("_here") & (F.col("last_seen").isNull() | (F.col("last_seen") > now - F.make_dt_interval(secs=F.lit(LIVE_S))))
    counts = joined.groupBy("group_id").agg(F.count("*").alias("members"), F.count_if(F.coalesce(live, F.lit(False))).alias("live"))
    return groups.where("deleted_at IS NULL").join(counts, "group_id", "left").select("group_id", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("members", "live")))


def invite_code(seed: Column) -> Column:
    """Six letters and digits from a seed, such as uuid()."""
    return F.substring(F.sha1(seed), 1, 6)


def touched(rows: DataFrame, updates: DataFrame, key: str, now: Column) -> DataFrame:
    """`rows` (key, updated_at, ...) with what `updates` (key, and some of their columns) say, and `updated_at` as of now where they say anything.

    Of several updates of a row the columns are taken from one."""
    named = [c for c in updates.columns if c != key]
    one = updates.groupBy(key).agg(F.min(F.struct(*named)).alias("_new"))
    joined = rows.join(one, key, "left")
    changed = F.col("_new").isNotNull()
    value = lambda c: F.when(changed, F.col("_new").getField(c)).otherwise(F.col(c)) if c in named else F.col(c)
    return joined.select(*(F.when(changed, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else value(c).alias(c) for c in rows.columns))


def with_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Profiles (user_id, display_name) and one for each new user (user_id, meta: JSON), named as the JSON says or not at all; profiles
    that are there stay as they are."""
    name = F.coalesce(F.get_json_object("meta", "$.display_name"), F.lit(""))
    new = users.select("user_id", name.alias("display_name")).groupBy("user_id").agg(F.min("display_name").alias("display_name"))
    return profiles.select("user_id", "display_name").unionByName(new.join(profiles.select("user_id"), "user_id", "left_anti"))
