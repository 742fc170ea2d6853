"""N-gram Jaccard self-join by T-occurrence search.

A document is the set of its distinct 5-word shingles. Counts over all documents (exchange.py) order shingles
from rare to frequent and show how many of a document's are shared at all: with fewer than the overlap that any
partner would need, it has none. Equal sets become one class, whose representative goes on, with its size and
those of its shingles that are shared. Two similar sets
share a shingle among the rarest 1/4 of each, so classes meet in a cell for the smallest class of each such
shingle. In a cell an inverted index answers T-occurrence searches as DivideSkip does: the short lists of a set
are merged, the long ones probed by binary search, and what reaches the required overlap is linked. The overlap
required is that with the smallest set whose size, and whose share of shingles that others in the cell have, leave it similar.

Only links that join components are kept, so groups of thousands of near copies cost links in proportion: sets
are tried on the cell's pivot and on the sets with the most frequent shingles of the cell first, and searches are
made for sets outside the largest component only. Cells over `CELL` sets are dealt into parts by size and hash,
each with the pivot; then sets outside the largest component are sent to all other parts that hold sets of a size
that could be similar, and search there, so that no pair of sets that could be linked is left out.

Edge cases: null and empty texts, and texts without words, have empty sets and link with nothing; fewer words
than 5 make one shingle; a null doc_id is no node but keeps its row (component null unless its set is shared,
then the smallest id); repeated rows and ties have equal sets and so one component; an empty table gives no rows;
other columns are ignored. Shingles are told apart by 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm.common import give_back, small, stored, table
from trailframe.llm.exchange import counted, hashed_words, in_blocks, window_hashes
from trailframe.operators.components import connected_components

#: Parameters: words of a shingle, least similarity in percent, sets of a cell's part, bytes of texts hashed together.
SHINGLE, PERCENT, CELL, TOGETHER = 5, 75, 128, 1_000_000
#: Parameters: sets sent to a part are searched for in groups of so many times a part's, sizes are dealt by powers of e to one over this.
GUESTS, BANDS = 8, 50


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text, A-Z in lower case; `TOGETHER` bytes of texts are hashed at once."""
    out: list[np.ndarray] = []
    while len(out) < len(texts):
        some, taken = [], 0
        while len(out) + len(some) < len(texts) and taken < TOGETHER:
            some.append((texts[len(out) + len(some)] or b"").lower())  # bytes.lower() changes A-Z only
            taken += len(some[-1])
        h, ends = hashed_words(some)
        windows = window_hashes(h, size)
        for a, b in zip([0, *ends], ends):
            x = np.sort(windows[a : b - size + 1] if b - a >= size else window_hashes(h[a:b], b - a) if b > a else h[:0])
            new = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=new[1:])
            out.append(x[new])
    return out


def needed(n: int, percent: int = PERCENT) -> int:
    """The overlap that a set of n needs with any similar set."""
    return -(-percent * n // 100)


def similar(overlap: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * overlap >= percent * (n + m - overlap)


def least_overlap(n: int, m, percent: int = PERCENT):
    """The overlap from which sets of n and m are similar."""
    return -(-percent * (n + m) // (100 + percent))


def shingled(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, prefix, tokens); the shared ones of all tokens, and of those of the prefix, from rare to frequent, only where a partner is possible.

    Counts need not tell all 64 bits apart: a shingle wrongly taken to be shared is searched in vain."""
    blocks, n = in_blocks(docs)

    def use(rows, texts, keys, counts) -> pa.Table:
        digests, prefixes, tokens = [], [], []
        for k, c in zip(keys, counts):
            digests.append(xxhash.xxh3_128_digest(k.tobytes()) if len(k) else None)
            alone = int((c < 2).sum())
            if len(k) and len(k) - alone >= needed(len(k)):
                order = np.argsort(c, kind="stable")[alone:]  # ties by shingle, as they come
                tokens.append(k[order].view(np.int64))
                prefixes.append(tokens[-1][: len(k) - needed(len(k)) + 1 - alone])
            else:
                prefixes.append(None), tokens.append(None)
        return pa.table({"doc_id": rows.column("doc_id"), "n_shingles": pa.array([len(k) for k in keys], pa.int64()), "digest": pa.array(digests, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64())), "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    return counted(blocks, n, shingle_sets, use, "doc_id long, n_shingles long, digest binary, prefix array<long>, tokens array<long>", bits=max(32, 30 + n.bit_length()))


class _Union:
    def __init__(self, names):
        self.up = {x: x for x in names}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def largest(self):
        sizes: dict = {}
        for x in self.up:
            r = self.find(x)
            sizes[r] = sizes.get(r, 0) + 1
        return max(sizes, key=lambda r: (sizes[r], -r))


def divide_skip(lists: list, t: int, probe_long: int) -> dict[int, int]:
    """Numbers that occur in at least `t` of the sorted lists, with their counts: the `probe_long` longest lists (at most t - 1) are probed, the others merged."""
    lists = sorted((np.asarray(x) for x in lists if len(x)), key=len)
    if len(lists) < t:
        return {}
    n_long = min(probe_long, t - 1)
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    found, counts = np.unique(np.concatenate(short), return_counts=True)
    for i, x in enumerate(long):
        may = counts + (n_long - i) >= t
        found, counts = found[may], counts[may]
        if not len(found):
            return {}
        counts += x[np.minimum(np.searchsorted(x, found), len(x) - 1)] == found
    return {int(d): int(c) for d, c in zip(found, counts) if c >= t}


def links_of_cell(pivot: int | None, names: list[int], sizes: list[int], sets: list[np.ndarray], comps: list[int], guest: list[bool]) -> list[tuple[int, int]]:
    """Links that join components among the sets of a cell, given by their sizes and their shared tokens. Guests search the others; without guests, all search."""
    union = _Union(comps)
    out: list[tuple[int, int]] = []
    size, host = np.array(sizes), ~np.array(guest)
    lengths = np.array([len(s) for s in sets])
    ends = np.cumsum(lengths)
    tokens, local = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(local[np.repeat(host, lengths)], minlength=len(tokens))
    own = lambda i: local[ends[i] - lengths[i] : ends[i]]
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
    roots = lambda: np.array([union.find(c) for c in comps])

    def link(i: int, j: int) -> None:
        if union.join(comps[i], comps[j]):
            out.append((names[i], names[j]))

    def try_all_on(p: int) -> bool:
        mask = np.zeros(len(tokens), bool)
        mask[own(p)] = True
        before = len(out)
        for i in np.flatnonzero(similar(sums(mask[local]), size, size[p])):
            link(int(i), p)
        return len(out) > before

    if pivot is not None and pivot in names:
        try_all_on(names.index(pivot))
    main = None
    if host.all():
        score, at = sums(often[local]) / size, roots()
        left = np.ones(len(names), bool)
        while left.any() and (at != at[0]).any() and try_all_on(int(np.flatnonzero(left)[np.argmax(score[left])])):
            at = roots()
            left = at != union.largest()
        main = union.largest()  # all others search, and so meet the largest
    at = roots()
    if (at == at[0]).all():
        return out
    shared = sums(np.where(np.repeat(host, lengths), np.bincount(local)[local] > 1, often[local] > 0))  # tokens of a set that any may have that it is compared with
    members = np.repeat(np.arange(len(names)), lengths)[order := np.argsort(local, kind="stable")]
    members, cuts = members[host[members]], np.concatenate([[0], np.cumsum(often)])
    for i in range(len(names)):
        mine = union.find(comps[i])
        if host[i] and (main is None or mine == union.find(main)):
            continue
        least = np.maximum(least_overlap(int(size[i]), size), 1)
        t = least[host & (at != mine) & (least <= np.minimum(shared, shared[i]))].min(initial=2**62)
        if t > shared[i]:
            continue
        lists = [members[cuts[x] : cuts[x + 1]] for x in own(i)]
        for j, overlap in divide_skip(lists, int(t), probe_long=int(t) - 1).items():
            if i != j and similar(overlap, int(size[i]), int(size[j])):
                link(i, j)
        at = roots()
    return out


def _cells(rows: DataFrame) -> DataFrame:
    """Links (a, b) found in cells given as rows (pivot, part, turn, class_id, n, tokens, comp, guest)."""

    done = 0

    def run(group: pa.Table) -> pa.Table:
        nonlocal done
        _, first = np.unique(group.column("class_id").to_numpy(), return_index=True)
        g = group.take(np.sort(first)).combine_chunks()
        tokens = g.column("tokens").combine_chunks()
        flat, offsets = tokens.flatten().to_numpy(), tokens.offsets.to_numpy()
        sets = np.split(flat, (offsets - offsets[0])[1:-1])
        found = links_of_cell(group.column("pivot")[0].as_py(), g.column("class_id").to_pylist(), g.column("n").to_pylist(), sets, g.column("comp").to_pylist(), g.column("guest").to_pylist())
        done += 1
        if done % 500 == 0:
            give_back()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("pivot", "part", "turn").applyInArrow(run, "a long, b long")


def class_links(classes: DataFrame, cell: int = CELL) -> DataFrame:
    """Links between classes (class_id, prefix, tokens) that connect all similar ones; `n`, where given, is the size of a set of which `tokens` holds the shared ones only."""
    classes = classes if "n" in classes.columns else classes.withColumn("n", F.size("tokens").cast("long"))
    posts = stored(classes.select("class_id", "n", F.size("tokens").alias("shared"), F.explode("prefix").alias("token")))
    pivots = posts.groupBy("token").agg(F.min("class_id").alias("pivot"), F.count("*").alias("many")).where("many > 1").select("token", "pivot")
    members = posts.join(pivots, "token").select("pivot", "class_id", "n", "shared").where("pivot <> class_id").distinct()
    # A small cell is one part; a large one is dealt by size, so that searches leave out parts, and sets of like size by hash.
    banded = members.withColumn("band", F.floor(F.log("n") * BANDS))
    bands = banded.groupBy("pivot", "band").agg(F.count("*").alias("many"))
    cells = bands.groupBy("pivot").agg(F.sum("many").alias("all")).where(F.col("all") > cell).select("pivot")
    parts = small(stored(bands.join(cells, "pivot").select("pivot", "band", F.ceil(F.col("many") / cell).alias("parts"))))  # of large cells only: no task gets a cell's members
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.col("band") * F.lit(2**32) + F.pmod(F.xxhash64("class_id"), F.col("parts")))
    dealt = stored(banded.join(parts, ["pivot", "band"], "left").select("pivot", part.cast("long").alias("part"), "class_id", "n", "shared", F.col("parts").isNotNull().alias("large")))
    sets = classes.select("class_id", "n", "tokens")
    own = dealt.select("pivot", "part", "class_id").unionByName(dealt.select("pivot", "part", F.col("pivot").alias("class_id")).distinct())
    first = stored(_cells(own.join(sets, "class_id").select("pivot", "part", F.lit(0).alias("turn"), "class_id", "n", "tokens", F.col("class_id").alias("comp"), F.lit(False).alias("guest"))))
    # Cells of several parts: sets outside the cell's largest component so far go to all the other parts with sets of a size that may be similar.
    comps = stored(connected_components(first))
    big = dealt.where("large").join(comps.withColumnRenamed("node", "class_id"), "class_id", "left").select("pivot", "part", "class_id", "n", "shared", F.coalesce("component", "class_id").alias("comp"))
    by_comp = big.groupBy("pivot", "comp").count()
    main = by_comp.groupBy("pivot").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("k"), (F.sum("count") - F.max("count")).alias("others")).where("k > 1")
    reach = big.groupBy("pivot", "part").agg(F.min("n").alias("low"), F.max("n").alias("high")).groupBy("pivot").agg(F.collect_list(F.struct("part", "low", "high")).alias("reach"))
    asking = big.join(small(stored(main.join(reach, "pivot"))), "pivot").where("comp <> main")
    # With an overlap of at most `shared`, a set of n is similar to sets of n * PERCENT / 100 to shared * (100 + PERCENT) / PERCENT - n.
    there = F.filter("reach", lambda p: (p["part"] != F.col("part")) & (100 * p["high"] >= PERCENT * F.col("n")) & (PERCENT * (F.col("n") + p["low"]) <= (100 + PERCENT) * F.col("shared")))
    turns = F.ceil(F.col("others") / (GUESTS * cell)).cast("int")
    sent = asking.select("pivot", "class_id", "comp", F.pmod(F.xxhash64("class_id", F.lit(1)), turns).cast("int").alias("turn"), F.explode(there.getField("part")).alias("part"))
    sent = stored(sent.select("pivot", "part", "turn", "class_id", "comp", F.lit(True).alias("guest")))
    hosts = big.join(sent.select("pivot", "part", "turn").distinct(), ["pivot", "part"]).select("pivot", "part", "turn", "class_id", "comp", F.lit(False).alias("guest"))
    again = hosts.unionByName(sent).join(sets, "class_id")
    return first.unionByName(_cells(again.select("pivot", "part", "turn", "class_id", "n", "tokens", "comp", "guest")))


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id of the equal sets) and component_id of every row.

    Classes are numbered by themselves, since a doc_id may have several texts; those texts' classes are linked."""
    rows = stored(shingled(docs))
    one = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.first("tokens").alias("tokens"))
    classes = stored(one.withColumn("class", F.monotonically_increasing_id()))
    links = class_links(classes.where("tokens IS NOT NULL").select(F.col("class").alias("class_id"), "n", "prefix", "tokens"))  # stored once: tokens are most of what is written
    several = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select(F.col("doc_id").alias("many"))
    texts = rows.join(several, F.col("doc_id") == F.col("many"), "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "class"), "digest")
    firsts = texts.groupBy("doc_id").agg(F.min("class").alias("b"))
    comps = connected_components(links.unionByName(texts.join(firsts, "doc_id").select(F.col("class").alias("a"), "b").where("a <> b")))
    named = classes.select("digest", "least", "class").join(comps, F.col("class") == F.col("node"), "left").select("digest", "least", F.coalesce("component", "class").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(smallest, "component").select("digest", F.col("least").alias("class_id"), "component_id")
    out = rows.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns whatever their names, of the smallest doc_id of each component.

    A document is what shares a doc_id: its repeated rows stay together. Rows without an id stay if no row with an id is linked to them."""
    found = similarity_classes(docs)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = packed.join(stay, F.col("row").getField("doc_id").cast("long").eqNullSafe(F.col("stays")), "left_semi")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, s, s + 4), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)
), r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
