"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

Test phrases are the windows of the benchmark's items. Terms of the windows are counted over all documents; the
index stores the postings (term, document, position) of the two rarest terms of each window. The list of the
rarest term, moved by the term's offset in the window, is intersected with that of the second, likewise moved;
what is left is checked against the whole window in the document. The same lists tell where the two rarest terms
stand near each other. Windows and results, being few, are broadcast after a check of their number and size, and
joined by a shuffle beyond it.

Edge cases: a null or empty text has no words (n_words 0, not contaminated); a null doc_id is kept; rows with
the same doc_id and text get the same result, with other texts their own; items without words have no windows,
a null item_id counts for hits but not as an item; with an empty benchmark nothing is hit; an empty table gives
no rows; other columns, whatever their names, are ignored or kept as they are.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm.common import small, stored, table

#: Fixed values of the contract: words of a window, the share (1 / 20) of hit words from which a document is contaminated.
WINDOW, HIT_SHARE = 13, 20
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0))


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (row: a struct of all columns, doc_id, text, k, h); k and h, never null, tell rows of different id or text apart."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumns({"k": F.coalesce("doc_id", F.lit(-(2**63))), "h": F.xxhash64("text")})


def phrases(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows of all items: (phrase, terms, items)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    windows = items.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, F.lit(size)))).alias("terms"))
    return windows.groupBy(F.array_join("terms", " ").alias("phrase")).agg(F.first("terms").alias("terms"), F.collect_set("item").alias("items"))


def postings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The index (term, k, h, pos) of the given terms over keyed rows, once for equal rows; positions count from 0."""
    return rows.select("k", "h", F.posexplode(words_of(F.col("text"))).alias("pos", "term")).join(small(terms), "term", "left_semi").distinct()


def with_rarest(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(number, len, t1, o1, t2, o2) of the phrases all of whose terms occur: their rarest term with its offset, and the next (null for one-word phrases)."""
    each = found.select("number", "terms", F.posexplode("terms").alias("o", "term")).join(counts, "term")
    order = each.groupBy("number").agg(F.first(F.size("terms")).alias("len"), F.array_sort(F.collect_list(F.struct("n", "o", "term"))).alias("by"))
    first, second = F.col("by")[0], F.get("by", F.lit(1))
    return order.where(F.size("by") == F.col("len")).select("number", "len", first["term"].alias("t1"), first["o"].alias("o1"), second["term"].alias("t2"), second["o"].alias("o2"))


def alignments(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """Starts (k, h, number, len, start) at which the two rarest terms stand as in the phrase."""
    first = index.join(small(ranked), F.col("term") == F.col("t1")).select("k", "h", (F.col("pos") - F.col("o1")).alias("start"), "number", "len", "t2", (F.col("pos") - F.col("o1") + F.col("o2")).alias("at2")).where("start >= 0")
    second = index.select(F.col("k").alias("k2"), F.col("h").alias("h2"), F.col("term").alias("t2x"), F.col("pos").alias("pos2"))
    both = first.where("t2 IS NOT NULL").join(second, (F.col("k") == F.col("k2")) & (F.col("h") == F.col("h2")) & (F.col("t2") == F.col("t2x")) & (F.col("at2") == F.col("pos2")), "left_semi")
    columns = ["k", "h", "number", "len", "start"]
    return both.select(*columns).unionByName(first.where("t2 IS NULL").select(*columns))


def near_pairs(index: DataFrame, pairs: DataFrame, span: int) -> DataFrame:
    """(k, h, a, b, pos_a, pos_b) wherever the terms a and b of `pairs` stand at most `span` words apart.

    Positions are joined by stretches of `span` words, so that no list is paired with all of another."""
    cells = index.withColumn("cell", F.floor(F.col("pos") / span))
    left = cells.join(small(pairs), F.col("term") == F.col("a")).select("k", "h", "a", "b", F.col("pos").alias("pos_a"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    near = left.join(cells.withColumnRenamed("term", "b"), ["k", "h", "b", "cell"]).where((F.abs(F.col("pos") - F.col("pos_a")) <= span) & (F.col("pos") != F.col("pos_a")))
    return near.select("k", "h", "a", "b", "pos_a", F.col("pos").alias("pos_b"))


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(row, doc_id, n_words, n_near, matches) of every row: its columns as a struct, the phrases (start, len, items)
    that it holds exactly, and at how many places the two rarest terms of a phrase stand within `size` words."""
    rows = keyed(docs)
    found = stored(phrases(benchmark, size).withColumn("number", F.monotonically_increasing_id()))
    vocabulary = stored(found.select(F.explode("terms").alias("term")).distinct())
    counts = stored(rows.select(F.explode(words_of(F.col("text"))).alias("term")).join(small(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")))
    ranked = stored(with_rarest(found, counts))
    rare = stored(ranked.select(F.explode(F.array("t1", "t2")).alias("term")).where("term IS NOT NULL").distinct())
    index = stored(postings(rows, rare))
    near = near_pairs(index, stored(ranked.where("t2 IS NOT NULL").select(F.col("t1").alias("a"), F.col("t2").alias("b")).distinct()), size).groupBy("k", "h").agg(F.count_distinct("a", "b", "pos_a").alias("near"))
    aligned = alignments(index, ranked).join(small(found.select("number", "phrase", "items")), "number")
    listed = aligned.groupBy("k", "h").agg(F.collect_list(F.struct("start", "len", "phrase", "items")).alias("found"))
    hits = stored(listed.join(near, ["k", "h"], "full"))
    out = rows.join(small(hits), ["k", "h"], "left").withColumn("w", words_of(F.col("text")))
    true = F.filter("found", lambda c: F.array_join(F.slice(F.col("w"), c["start"] + 1, c["len"]), " ") == c["phrase"])
    matches = F.transform(F.coalesce(true, F.array().cast("array<struct<start:int,len:int,phrase:string,items:array<string>>>")), lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), c["items"].alias("items")))
    return out.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), matches.alias("matches"))


def proximity_matches(docs: DataFrame, pairs: DataFrame, span: int) -> DataFrame:
    """(doc_id, a, b, pos_a, pos_b) wherever the terms a and b of `pairs` stand at most `span` words apart, once for equal rows."""
    rows = keyed(docs)
    index = postings(rows, pairs.select(F.explode(F.array("a", "b")).alias("term")).distinct())
    return near_pairs(index, pairs, span).join(rows.select("k", "h", "doc_id").distinct(), ["k", "h"]).select("doc_id", "a", "b", "pos_a", "pos_b")


def hit_words(matches: Column) -> Column:
    """Words inside any of the matches."""
    end = lambda m: m["start"] + m["len"]
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["len"].alias("len"))))
    step = lambda acc, m: F.struct(F.greatest(acc["end"], end(m)).alias("end"), (acc["hit"] + F.greatest(F.lit(0), end(m) - F.greatest(acc["end"], m["start"]))).alias("hit"))
    return F.aggregate(ordered, F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")), step, lambda acc: acc["hit"].cast("long"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (HIT_SHARE * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near of every row of `docs`."""
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["items"]))))
    out = search(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "n_near", hit_words(F.col("matches")).alias("n_hit"), items.alias("found"))
    return out.select("doc_id", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "n_near")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not contaminated."""
    kept = search(docs, benchmark).where(~is_contaminated(hit_words(F.col("matches")), F.col("n_words")))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + 12), ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), x AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p))
), m AS (SELECT x.doc_id, x.s, x.n, p.item FROM x JOIN p USING (n, phrase)
), h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY doc_id
), c AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id
), dw AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d
), f AS (SELECT term, count(*) AS n FROM dw GROUP BY term
), t AS (SELECT phrase, len(ts) AS size, unnest(ts) AS term, generate_subscripts(ts, 1) AS o FROM (SELECT phrase, string_split(phrase, ' ') AS ts FROM (SELECT DISTINCT phrase FROM p))
), k AS (SELECT phrase, size, term, row_number() OVER (PARTITION BY phrase ORDER BY n, o) AS k, count(*) OVER (PARTITION BY phrase) AS c FROM t JOIN f USING (term)
), q AS (SELECT DISTINCT x.term AS a, y.term AS b FROM k x JOIN k y USING (phrase) WHERE x.k = 1 AND y.k = 2 AND x.c = x.size
), e AS (SELECT x.doc_id, count(DISTINCT (a, b, x.pos)) AS n_near FROM q JOIN dw x ON x.term = a JOIN dw y ON y.term = b AND y.doc_id = x.doc_id AND abs(y.pos - x.pos) BETWEEN 1 AND 13 GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_near, 0) AS n_near, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)
"""
