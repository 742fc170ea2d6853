"""Connected components by contraction."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of this machine only where the session runs on it alone, as in tests."""
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="trailframe-")


@cache
def _frames(spark: SparkSession, application: str) -> str:
    """The folder of an application's stored frames, which goes when the application ends."""
    folder = f"{shared_folder(spark)}/frames-{application}-{uuid.uuid4()}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(conf)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage: rows written as Parquet in the shared folder and read again.

    What is read knows nothing of the plan that made it. A frame of `df.checkpoint` keeps its plan's orderings and
    partitionings, which joins multiply, so that the driver's time would grow with every round of a loop."""
    path = f"{_frames(df.sparkSession, df.sparkSession.sparkContext.applicationId)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _roots(hook: DataFrame) -> DataFrame:
    """`hook` (node, up) with every `up` at the end of its chain: each pass takes four times the steps, so long chains take few."""
    jump = lambda rows: rows.join(rows.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"))
    while True:
        twice = jump(hook)
        ends = twice.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = checkpointed(twice.join(ends, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        hook = jumped.select("node", "up")
        if jumped.where("moved").isEmpty():
            return hook


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges`; a component is named by its smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends and contracts the
    edges, so that chains in order of the names vanish in one round; the hooks are then followed back. Both are joins and partial aggregates: no component is gathered.
    Null ends and self loops link nothing."""
    left = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    left = checkpointed(left)
    hooks = []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = _roots(checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))))
        hooks.append(hook)
        ups = lambda end, to: hook.select(F.col("node").alias(end), F.col("up").alias(to))  # noqa: B023, E731
        moved = left.join(ups("a", "ua"), "a").join(ups("b", "ub"), "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
        left = checkpointed(moved.where("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not hooks:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = hooks[0].select("node", F.col("up").alias("component"))
    for hook in hooks[1:]:
        found = found.join(hook.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return found
