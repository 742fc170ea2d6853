"""Graph operators: arcs, degrees, component statistics, route search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from trailframe.operators.components import checkpointed, connected_components


def arcs(edges: DataFrame, *columns: str) -> DataFrame:
    """Both directions of every edge, as (src, dst) and the given columns; one scan, no self join."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("arc")
    return edges.where("a <> b").select(ends, *columns).select("arc.src", "arc.dst", *columns)


def degrees(edges: DataFrame) -> DataFrame:
    return arcs(edges).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))


def topology_metrics(edges: DataFrame) -> DataFrame:
    d = F.col("degree")
    return degrees(edges).agg(F.count("*").alias("nodes"), F.count_if(d >= 3).alias("junctions"), F.count_if(d == 2).alias("pass_through"), F.count_if(d == 1).alias("dead_ends"), F.sum(d).alias("arcs"))


def component_stats(edges: DataFrame) -> DataFrame:
    """(component, nodes, edges, meters, by_meters) with the rank by metres, then by name."""
    labels = checkpointed(connected_components(edges))
    nodes = labels.groupBy("component").agg(F.count("*").alias("nodes"))
    lengths = edges.join(labels.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count("*").alias("edges"), F.sum("m").alias("meters"))
    joined = nodes.join(lengths, "component")
    ranked = joined.orderBy(F.desc("meters"), "component").limit(15).agg(F.collect_list("component").alias("top"))  # a report's top 15, one row
    at = F.array_position(ranked.scalar(), F.col("component"))
    return joined.withColumn("by_meters", F.when(at > 0, at))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with most nodes; ties go to the smallest name."""
    labels = checkpointed(connected_components(edges))
    first = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return edges.join(labels.join(F.broadcast(first), "component", "left_semi").select(F.col("node").alias("a")), "a", "left_semi")


#: Parameters: nodes of a block, in ids next to each other; blocks of ids that aren't numbers; blocks up to which a round's files are filtered by
#: their names; rounds after which known labels are merged.
BLOCK, NAMED_BLOCKS, READ, MERGE = 1 << 17, 64, 100, 16


def in_block(nodes: DataFrame, node: str, size: int) -> Column:
    """The block of a node's id. Any division gives the same labels; one by which neighbours share a block takes few rounds."""
    whole = isinstance(nodes.schema[node].dataType, IntegralType)
    return F.floor(F.col(node) / size).cast("long") if whole else F.pmod(F.xxhash64(node), F.lit(NAMED_BLOCKS)).cast("long")


def _settled(labels: pa.Table, steps: pa.Table) -> pa.Table:
    """The labels that get better in one block: relaxation from fresh labels until nothing changes; ties to the smaller node and edge."""
    n, m = labels.num_rows, steps.num_rows
    as_numpy = lambda table, c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
    names, code = np.unique(np.concatenate([as_numpy(labels, "node"), as_numpy(steps, "from"), as_numpy(steps, "to")]), return_inverse=True)
    at, to, fresh, given = code[:n], code[n + m :], as_numpy(labels, "fresh").astype(bool), as_numpy(labels, "cost").astype(float)
    bounds = labels["bound"].drop_null()
    bound = min(bounds.to_pylist()) if len(bounds) else np.inf
    order = np.lexsort((as_numpy(steps, "edge_id"), code[n : n + m])) if "edge_id" in steps.column_names else np.argsort(code[n : n + m], kind="stable")
    first, to, price = np.searchsorted(code[n : n + m][order], np.arange(len(names) + 1)), to[order], as_numpy(steps, "price").astype(float)[order]
    cost, via = np.full(len(names), np.inf), np.full(len(names), -1)
    np.minimum.at(cost, at[~fresh], given[~fresh])
    known = cost.copy()
    np.minimum.at(cost, at[fresh], given[fresh])
    here = np.flatnonzero((cost < known) & (cost < bound))
    while len(here):
        count = first[here + 1] - first[here]
        step = np.repeat(first[here] - np.cumsum(count) + count, count) + np.arange(count.sum())
        reached, there = np.repeat(cost[here], count) + price[step], to[step]
        better = (reached < cost[there]) & (reached < bound)
        reached, there, step = reached[better], there[better], step[better]
        best = np.lexsort((step, reached, there))
        best = best[np.r_[True, there[best][1:] != there[best][:-1]]] if len(best) else best
        here = there[best]
        cost[here], via[here] = reached[best], step[best]
    new = np.flatnonzero(via >= 0)
    taken = pa.array(order[via[new]])
    out = {c: labels[c].combine_chunks().take(pa.array(np.zeros(len(new), int))) for c in ("query", "block")} | {"node": pa.array(names[new], labels.schema.field("node").type), "cost": pa.array(cost[new])}
    return pa.table(out | ({"prev": steps["from"].take(taken), "edge_id": steps["edge_id"].take(taken)} if "edge_id" in steps.column_names else {}))


def spread(starts: DataFrame, steps_of: Callable[[DataFrame, Callable], DataFrame], size: int = BLOCK, bounds: Callable[[DataFrame], DataFrame] | None = None, max_rounds: int = 10_000) -> DataFrame:
    """Labels (query, node, cost and, if they are traced, prev and edge_id) of the cheapest paths from labels `starts`; of one node there may be several.

    Nodes are dealt to blocks. In each round the blocks of a query that labels entered settle by themselves, each as a
    group, and the labels that leave them for a node they make cheaper enter its block in the next one: rounds grow with the
    blocks along a path, not with its steps. `steps_of` gives the steps (query, block of `from`, from, to, price and, if traced, edge_id)
    of the asked (query, block), given also a filter by block for what it reads; `bounds` the costs (query, bound) that labels must stay below, given those of the last round."""
    plain = starts.columns
    kind = starts.schema["node"].dataType.simpleString()
    columns = [c if c != "block" else "home" for c in ("query", "block", "node", "cost", *plain[3:])]
    schema = f"query {starts.schema['query'].dataType.simpleString()}, home long, node {kind}, cost double" + (f", prev {kind}, edge_id string" if "edge_id" in plain else "")
    blocked = lambda rows: rows.withColumn("block", in_block(rows, "node", size))
    least = lambda rows: rows.groupBy("query", "node").agg(F.min("cost").alias("cost"))
    fresh = checkpointed(blocked(starts.withColumn("cost", F.col("cost").cast("double"))))
    known, bound = [fresh], None if bounds is None else bounds(fresh)
    entered, settled = fresh, []
    for k in range(max_rounds):
        blocks = [r.block for r in entered.select("block").distinct().limit(READ + 1).collect()]
        if not blocks:
            return reduce(DataFrame.unionByName, known).select(*plain)
        read = (lambda rows: rows.where(F.col("block").isin(blocks))) if len(blocks) <= READ else (lambda rows: rows)  # noqa: B023, E731
        asked = F.broadcast(entered.select(F.col("query").alias("query"), F.col("block").alias("block")).distinct())  # a row for each block that labels entered
        old = [read(reduce(DataFrame.unionByName, settled)).join(asked, ["query", "block"], "left_semi").select("query", "block", "node", "cost", F.lit(False).alias("fresh"))] if settled else []
        labels = reduce(DataFrame.unionByName, old, entered.select("query", "block", "node", "cost", F.lit(True).alias("fresh")))
        labels = labels.withColumn("bound", F.lit(None).cast("double")) if bound is None else labels.join(bound.select("query", "bound"), "query", "left")
        both = labels.select("query", "block", "node", "cost", "fresh", "bound").groupBy("query", "block").cogroup(steps_of(asked, read).groupBy("query", "block"))
        new = blocked(checkpointed(both.applyInArrow(lambda left, right: _settled(left, right).rename_columns(columns), schema)))
        if bounds is not None:
            bound = bounds(new)
        # Labels that leave a block are looked up: only those that are better than all known ones of their nodes go on.
        leaving = new.where("home <> block").groupBy("query", "node", "block").agg(F.min(F.struct("cost", *plain[3:])).alias("l")).select("query", "node", "l.*", "block")
        there = reduce(DataFrame.unionByName, known + [new.where("home = block").select(*plain, "block")]).join(leaving.select("query", "node"), ["query", "node"], "left_semi")
        better = leaving.join(least(there).withColumnRenamed("cost", "known"), ["query", "node"], "left").where("known IS NULL OR cost < known").drop("known")
        if bound is not None:
            better = better.join(bound.select("query", "bound"), "query", "left").where("bound IS NULL OR cost < bound").drop("bound")
        inside = new.where("home = block").select(*plain, "block")
        settled = known + [inside]
        entered = checkpointed(better.select(*plain, "block"))
        known = [*settled, entered]
        if k % MERGE == MERGE - 1:
            merged = reduce(DataFrame.unionByName, settled).groupBy("query", "node", "block").agg(F.min(F.struct("cost", *plain[3:])).alias("l")).select("query", "node", "l.*", "block")
            settled = [checkpointed(merged.select(*plain, "block"))]
            known = [*settled, entered]
    raise RuntimeError(f"paths did not settle in {max_rounds} rounds")


def shortest_paths(edges: DataFrame, sources: DataFrame, cost: Column, max_rounds: int = 10_000, size: int = BLOCK) -> DataFrame:
    """(query, node, cost) of the cheapest paths from sources (query, node), over edges in both directions.

    All queries run in the same rounds. Costs are integers and not negative; those of paths are below 2 ** 53."""
    arc = arcs(edges.withColumn("w", cost.cast("long")), "w").groupBy("src", "dst").agg(F.min("w").alias("price"))
    arc = arc.select(in_block(arc, "src", size).alias("block"), F.col("src").alias("from"), F.col("dst").alias("to"), "price")
    arc = checkpointed(arc.repartitionByRange("block", "from").sortWithinPartitions("block"))
    starts = sources.select("query", "node", F.lit(0).alias("cost")).distinct()
    labels = spread(starts, lambda asked, read: read(arc).join(asked, "block").select("query", "block", "from", "to", "price"), size, max_rounds=max_rounds)
    return labels.groupBy("query", "node").agg(F.min("cost").cast("long").alias("cost"))
