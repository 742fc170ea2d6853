"""The road network that the queries run on: nodes from `customer`, edges from `orders`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES_SQL = """SELECT c_custkey AS node_id, -6600000 + 1000 * (c_custkey % 30) AS lon_e5, 4400000 + 1000 * CAST(floor(c_custkey / 30.0) AS BIGINT) AS lat_e5 FROM customer"""
EDGES_SQL = """SELECT 'o-' || CAST(o_orderkey AS VARCHAR) AS edge_id, o_orderkey AS seq, o_custkey AS a,
  o_custkey + CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 30 ELSE 31 END AS b, 200 + CAST(floor(o_totalprice) AS BIGINT) % 2000 AS m,
  CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS s, CASE WHEN o_orderkey % 17 = 0 THEN 3 WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS ac,
  CASE o_orderkey % 5 WHEN 0 THEN 'arterial' WHEN 1 THEN 'collector' WHEN 2 THEN 'local' WHEN 3 THEN 'resource' ELSE 'track' END AS rt
FROM orders WHERE o_custkey + CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 30 ELSE 31 END IN (SELECT c_custkey FROM customer)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("node_id"), (F.lit(-6_600_000) + 1000 * (key % 30)).alias("lon_e5"), (F.lit(4_400_000) + 1000 * F.floor(key / 30)).alias("lat_e5"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    step = F.when(key % 3 == 0, 1).when(key % 3 == 1, 30).otherwise(31)
    kind = F.when(key % 5 == 0, "arterial").when(key % 5 == 1, "collector").when(key % 5 == 2, "local").when(key % 5 == 3, "resource").otherwise("track")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("o-"), key.cast("string")).alias("edge_id"), key.alias("seq"), F.col("o_custkey").alias("a"), (F.col("o_custkey") + step).alias("b"),
        (200 + F.floor("o_totalprice") % 2000).alias("m"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("s"),
        F.when(key % 17 == 0, 3).when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("ac"), kind.alias("rt"))
    return rows.join(nodes(spark, sf_dir).select(F.col("node_id").alias("b")), "b", "left_semi").select("edge_id", "seq", "a", "b", "m", "s", "ac", "rt")
