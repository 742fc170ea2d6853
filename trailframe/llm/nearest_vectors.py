"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the largest inner product; a coordinate that lifts all rows to one length makes it the smallest angle. The
trees are fitted on a bounded sample: a node parts its vectors at the median of their projections on the line through two of
them. Every row is put into one leaf of each tree. A query walks all trees with one priority queue, ordered by how far it
lies on the wrong side of the planes passed, until the leaves that it took hold enough rows. How many are enough is
found on the sample, as the share of rows with which its own queries find what brute force over the sample does.

Leaves meet their queries in tasks, where the candidates are ranked by the inner product of the original vectors; the
best of all leaves are merged for each query. The first tree's leaves come first: the k-th best score there is a bound below
which the other trees' leaves return nothing. A leaf of many rows or queries is dealt into slices, and each slice of
rows meets each slice of queries, so that no task holds a large leaf. Equal queries are searched once.

The forest goes to the tasks; SAMPLE, SAMPLE_BYTES and LEAST bound it. With more rows than LEAF times the most leaves,
leaves grow, and with them the slices that a query meets.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, neither do rows without id nor
vectors whose length isn't the most frequent one (ties to the longer); a query with fewer candidates than asked gets all of
them; equal scores go to the smaller id; an id of several rows is one candidate with its best score, and asks with its
smallest vector; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.llm.common import map_texts, stored, table

#: Parameters: trees, rows and bytes of the sample that they are fitted on, rows of a leaf aimed at, rows of the sample in a leaf at least.
TREES, SAMPLE, SAMPLE_BYTES, LEAF, LEAST = 4, 65_536, 64_000_000, 2_048, 8
#: Parameters: recall on the sample that decides how many rows are enough, queries it is measured with, rows and queries
#: in a slice of a leaf, neighbours of a query.
RECALL, PROBES, SLICE, ASKED, K = 0.96, 256, 8_192, 32_768, 20


class Forest:
    """Arrays of nodes: normal and offset of the plane, children (leaf k of all leaves is ~k); root and first leaf of each tree."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, least: int = LEAST, seed: int = 7):
        rng = np.random.default_rng(seed)
        share = rows / max(len(sample), 1)
        self.normals, self.offsets, self.children, self.roots, self.leaves, self.first = [], [], [], [], 0, []
        for _ in range(trees):
            self.first.append(self.leaves)
            self.roots.append(self._node(sample, np.arange(len(sample)), share, leaf, least, rng))
        self.normals = np.array(self.normals).reshape(len(self.offsets), sample.shape[1])
        self.offsets = np.array(self.offsets)

    def _node(self, sample: np.ndarray, own: np.ndarray, share: float, leaf: int, least: int, rng: np.random.Generator) -> int:
        if len(own) * share > leaf and len(own) >= 2 * least:
            for _ in range(5):  # a pair of equal vectors has no line through it
                a, b = sample[rng.choice(own, 2, replace=False)]
                if (length := np.linalg.norm(a - b)) > 0:
                    at = sample[own] @ ((a - b) / length)
                    offset = float(np.median(at))
                    right = at > offset
                    if right.any():
                        k = len(self.offsets)
                        self.normals.append((a - b) / length), self.offsets.append(offset), self.children.append(None)
                        self.children[k] = (self._node(sample, own[~right], share, leaf, least, rng), self._node(sample, own[right], share, leaf, least, rng))
                        return k
        self.leaves += 1
        return ~(self.leaves - 1)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(vectors)))]
            while todo:
                node, own = todo.pop()
                if node < 0:
                    out[own, t] = ~node
                elif len(own):
                    right = vectors[own] @ self.normals[node] > self.offsets[node]
                    todo += [(self.children[node][0], own[~right]), (self.children[node][1], own[right])]
        return out

    def search(self, vector: np.ndarray, counts: np.ndarray, enough: float) -> list[int]:
        """The leaves that a query visits until they hold enough rows; the queue is shared by the trees."""
        heap, number = [(-np.inf, 0, root) for root in self.roots], itertools.count(1)
        heapq.heapify(heap)
        found, total = [], 0
        while heap and total < enough:
            worst, _, node = heapq.heappop(heap)
            if node < 0:
                found.append(~node)
                total += counts[~node]
                continue
            margin = float(self.normals[node] @ vector) - self.offsets[node]
            for child, own in zip(self.children[node], (-margin, margin)):
                heapq.heappush(heap, (max(worst, -own), next(number), child))
        return found


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more coordinate, so that all are as long as the longest."""
    more = np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(axis=1)))
    return np.hstack([vectors, more[:, None]])


def asking(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Queries as long as the longest row; the angles to lifted rows then go by the inner products."""
    return np.hstack([vectors * (longest / np.linalg.norm(vectors, axis=1))[:, None], np.zeros((len(vectors), 1))])


def enough_rows(forest: Forest, sample: np.ndarray, longest: float, rows: int, k: int, recall: float = RECALL, probes: int = PROBES) -> float:
    """Rows that the leaves of a query have to hold, counted in each tree, for such a recall on the sample."""
    places = forest.place(lifted(sample, longest))
    counts = np.bincount(places.ravel(), minlength=forest.leaves)
    own = np.random.default_rng(11).permutation(len(sample))[:probes]
    needed = []
    for i, query in zip(own, asking(sample[own], longest)):
        scores = sample @ sample[i]
        scores[i] = -np.inf
        best = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
        order = forest.search(query, counts, np.inf)
        held = np.empty(forest.leaves)  # rows in hand when a leaf was taken
        held[order] = np.cumsum(counts[order])
        needed += held[places[best]].min(axis=1).tolist()
    return float(np.quantile(needed, recall)) * rows / len(sample) if needed else 0.0


def matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """A column of vectors of one length, as bytes or lists, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def best_of(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k best ids that score at least its bound in `least`, and their scores. Of a vector's rows the k first ids count.

    Products of blocks only choose candidates; scores are sums in one order, so that equal vectors score alike everywhere."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order] + 0.0)
    _, which = np.unique(vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    first = np.ones(len(ids), bool)  # equal rows
    by = np.lexsort((ids, which))
    first[by[1:]] = (which[by[1:]] != which[by[:-1]]) | (ids[by[1:]] != ids[by[:-1]])
    by = by[first[by]]
    starts = np.flatnonzero(np.diff(which[by], prepend=-1))
    place = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    kept = np.sort(by[place < k])
    ids, vectors = ids[kept], vectors[kept]
    most = min(len(ids), k + len(ids) - len(np.unique(ids)))
    out = []
    for at in range(0, len(queries), block := max(1, 4_000_000 // max(len(ids), 1))):
        products = queries[at : at + block] @ vectors.T
        lows = np.maximum(least[at : at + block], np.partition(products, len(ids) - most, axis=1)[:, len(ids) - most])
        for query, row, low in zip(queries[at : at + block], products, lows):
            some = np.flatnonzero(row >= low - 1e-9 * (1 + abs(low)))
            scores = (vectors[some] * query).sum(axis=1)
            rank = np.lexsort((ids[some], -scores))
            _, seen = np.unique(ids[some][rank], return_index=True)
            rank = rank[np.sort(seen)[:k]]
            out.append((ids[some][rank], scores[rank]))
    return out


def valid(rows: DataFrame) -> tuple[DataFrame, str]:
    """Rows (vec_id, vector) that take part, and the type of the vectors' components."""
    kind = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.coalesce(whole, F.lit(False)))
    length = rows.groupBy(F.size("vector").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"]).scalar()
    return rows.where(F.size("vector") == length), "f4" if kind == "float" else "f8"


def _bytes(vectors: np.ndarray, kind: str) -> pa.Array:
    own = np.ascontiguousarray(vectors.astype(kind))
    width = own.itemsize * own.shape[1] if own.ndim == 2 else 0
    return pa.Array.from_buffers(pa.binary(width), len(own), [None, pa.py_buffer(own.tobytes())]).cast(pa.binary()) if width else pa.array([], pa.binary())


def fitted(rows: DataFrame, kind: str, k: int, trees: int, leaf: int) -> tuple[Forest, float, float] | None:
    """The forest, the longest length and how many rows are enough; None if no row takes part."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    n, longest, d = rows.agg(F.count("*"), F.max(length), F.max(F.size("vector"))).first()
    if not n:
        return None
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    share = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(2**20)) < int(min(1.0, 0.95 * most / n) * 2**20) + 1
    taken = rows.where(share).limit(most).select("vector").toArrow()
    taken = taken if len(taken) else rows.limit(1).select("vector").toArrow()
    sample = matrix(taken.column("vector"), kind)
    forest = Forest(lifted(sample, longest), n, trees, leaf)
    enough = enough_rows(forest, sample, longest, n, k) if forest.leaves > trees else float(n * trees)
    return forest, longest, enough


def neighbours(rows: DataFrame, asks: Column, k: int = K, trees: int = TREES, leaf: int = LEAF, slice_rows: int = SLICE, slice_asked: int = ASKED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of (vec_id, embedding) for which `asks` holds."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = rows.sparkSession
    rows, kind = valid(rows)
    if (fit := fitted(rows, kind, k, trees, leaf)) is None:
        return spark.createDataFrame([], schema)
    forest, longest, enough = fit
    sent = spark.sparkContext.broadcast(forest)

    def places():
        return lambda batch: {"leaves": sent.value.place(lifted(matrix(batch.column("vector"), kind), longest)).tolist()}

    found = map_texts(rows.select("vector"), places, "leaves array<int>").select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()  # a row for each leaf
    counts = np.zeros(forest.leaves, np.int64)
    for leaf_, n in found:
        counts[leaf_] = n

    queries = rows.where(asks).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    distinct = queries.groupBy("vector").agg(F.min("vec_id").alias("asked"))

    def visits():
        def each(batch):
            vectors = matrix(batch.column("vector"), kind)
            return {"asked": batch.column("asked"), "vector": _bytes(vectors, kind), "leaves": [sent.value.search(q, counts, enough) for q in asking(vectors, longest)] if len(vectors) else []}

        return each

    visited = stored(map_texts(distinct.select("asked", "vector"), visits, "asked long, vector binary, leaves array<int>"))
    asked = np.zeros(forest.leaves, np.int64)
    for leaf_, n in visited.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # a row for each leaf
        asked[leaf_] = n
    # Slices of rows and of queries by leaf; a cell is a slice of each, numbered on through all leaves. Leaves that nobody visits need none.
    down, across = -(-counts // slice_rows), -(-asked // slice_asked)
    cells = np.concatenate([[0], np.cumsum(down * across)])

    def rows_in_cells(first: int, end: int):
        """Rows of the leaves from `first` to `end`, once for each slice of the leaf's queries."""
        def make():
            turn = 0

            def each(batch):
                nonlocal turn
                vectors = matrix(batch.column("vector"), kind)
                where = sent.value.place(lifted(vectors, longest)) if len(vectors) else np.zeros((0, trees), np.int32)
                line = turn + np.arange(len(where))
                turn += len(where)
                row, tree = np.nonzero((where >= first) & (where < end))
                leaf_of = where[row, tree]
                times = across[leaf_of]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                leaf_of, row = np.repeat(leaf_of, times), np.repeat(row, times)
                cell = cells[leaf_of] + line[row] % np.maximum(down[leaf_of], 1) * across[leaf_of] + part
                return {"cell": cell, "vec_id": batch.column("vec_id").take(pa.array(row)), "vector": _bytes(vectors, kind).take(pa.array(row))}

            return each

        return make

    def asked_in_cells(first: int, end: int):
        """Queries of those leaves, once for each slice of the leaf's rows."""
        def make():
            def each(batch):
                out_cell, out_row = [], []
                for row, (i, leaves) in enumerate(zip(batch.column("asked").to_pylist(), batch.column("leaves").to_pylist())):
                    for x in leaves:
                        if first <= x < end:
                            own = cells[x] + np.arange(down[x]) * across[x] + i % max(across[x], 1)
                            out_cell.append(own)
                            out_row.append(np.full(len(own), row))
                row = pa.array(np.concatenate(out_row) if out_row else [], pa.int64())
                return {"cell": np.concatenate(out_cell) if out_cell else []} | {c: batch.column(c).take(row) for c in ("asked", "vector", "least")}

            return each

        return make

    def meet(given: pa.Table, wanted: pa.Table) -> pa.Table:
        best = []
        if len(given) and len(wanted):
            best = best_of(given.column("vec_id").to_numpy(), matrix(given.column("vector"), kind), matrix(wanted.column("vector"), kind), wanted.column("least").to_numpy(), k + 1)
        ids = wanted.column("asked").to_numpy()
        return pa.table({
            "asked": pa.array(np.repeat(ids[: len(best)], [len(x) for x, _ in best]) if best else [], pa.int64()),
            "vec_id": pa.array(np.concatenate([x for x, _ in best]) if best else [], pa.int64()), "score": pa.array(np.concatenate([y for _, y in best]) if best else [], pa.float64())})

    def met(asking_rows: DataFrame, first: int, end: int) -> DataFrame:
        left = map_texts(rows, rows_in_cells(first, end), "cell long, vec_id long, vector binary").groupBy("cell")
        right = map_texts(asking_rows, asked_in_cells(first, end), "cell long, asked long, vector binary, least double").groupBy("cell")
        return left.cogroup(right).applyInArrow(meet, "asked long, vec_id long, score double")

    in_order = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id"))

    def best_rows(found_rows: DataFrame) -> DataFrame:
        one = found_rows.groupBy("asked", "vec_id").agg(F.max("score").alias("score"))
        return one.withColumn("place", in_order("asked")).where(F.col("place") <= k + 1).drop("place")

    second = forest.first[1] if trees > 1 else forest.leaves
    best = stored(best_rows(met(visited.withColumn("least", F.lit(float("-inf"))), 0, second)))
    if trees > 1:
        low = best.groupBy("asked").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k + 1).select("asked", "least")
        rest = met(visited.join(low, "asked", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), second, forest.leaves)
        best = best_rows(best.unionByName(rest))
    same = queries.join(distinct, "vector").select(F.col("vec_id").alias("query_id"), "asked")
    ranked = same.join(best, "asked").where("vec_id <> query_id").withColumn("rank", in_order("query_id")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
