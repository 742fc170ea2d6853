"""Words that differ by one edit, and the more frequent form that each word is a variant of.

Words are counted inside tasks and summed by word. Each word gets a mask that holds for each letter whether it occurs
an odd number of times: one edit flips two bits at most, so of three bands of the mask one is equal for two near
words. Words meet by band, by length (equal, or one more) and by the half of the word that the edit leaves alone, which
keeps bands of many words apart; those whose masks differ by more than two bits go, the others are compared. Rows
that meet are an equi-join, whose large keys Spark splits. Forms are followed to their ends by doubling jumps: a form
is twice as frequent as its variant, so chains are short.

Edge cases: null and empty texts have no words; a null doc_id deletes nothing; repeated rows count each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm.common import stored, table
from trailframe.operators.components import checkpointed

#: Parameters: code points and occurrences of a word at least; how many times as frequent a form is; one in so many
#: occurrences loses a letter; distinct words that a task holds at most.
LETTERS, LEAST, TIMES, DAMAGED, HELD = 5, 3, 2, 97, 200_000
#: Bits of a mask: letters by how frequent they are, so that the bands (bits by their number modulo 3) are alike; letters
#: from U+00C0 on share the bits above.
_ORDER = "etaoinshrdlcumwfgypbvkjxqz"
_BITS, BANDS = 64, 3
#: Latin-1 bytes as they are taken: A-Z as a-z, letters, and a space for all others.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def letter_runs(text: str, doc_id: int | None, damaged: int = DAMAGED) -> list[bytes]:
    """The lower-cased runs of letters of a text (Latin-1), some of which lose a letter, by the document's id and the run."""
    words = text.encode("latin-1", "replace").translate(_LETTERS).split()
    if doc_id is None or not words:
        return words
    crc, start = zlib.crc32, zlib.crc32(b"%d:" % doc_id)
    hashes = np.fromiter((crc(w if w.isascii() else w.decode("latin-1").encode(), start) for w in words), np.uint32, len(words))
    for k in np.flatnonzero(hashes % damaged == 0).tolist():
        at = int(hashes[k]) % len(words[k])
        words[k] = words[k][:at] + words[k][at + 1 :]
    return words


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    def tally(batches):
        seen: Counter[bytes] = Counter()

        def rows():
            kept = [(w.decode("latin-1"), n) for w, n in seen.items() if len(w) >= LETTERS]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                seen.update(letter_runs(text or "", doc_id))
                if len(seen) > HELD:
                    yield rows()
                    seen.clear()
        yield rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def letter_parity(word: Column) -> Column:
    """A bit for each letter: whether it occurs an odd number of times."""
    bit = lambda c: F.when(c < "{", F.instr(F.lit(_ORDER), c) - 1).otherwise(len(_ORDER) + (F.ascii(c) - 0xC0) % (_BITS - len(_ORDER)))
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(one(c)))


def meeting_keys(word: Column, mask: Column, short: Column) -> Column:
    """A key for each band and half of a word, of those that a word of `short` letters (its own number, or one less) may share with it."""
    half = F.floor(short / 2).cast("int")
    halves = ((0, F.left(word, half)), (1, F.right(word, short - half)))
    band = [sum(1 << b for b in range(_BITS) if b % BANDS == k) for k in range(BANDS)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in band]
    return F.array(*(F.xxhash64(short, F.lit(2 * k + side), mask.bitwiseAND(F.lit(m).cast("long")), part) for k, m in enumerate(signed) for side, part in halves))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): both directions of the pairs of words (word, n) that one edit parts."""
    masked = words.select("word", "n", letter_parity(F.col("word")).alias("mask"), F.char_length("word").alias("size"))
    keyed = lambda short: F.explode(meeting_keys(F.col("word"), F.col("mask"), short)).alias("key")
    mine = masked.select("word", "n", "mask", keyed(F.col("size")))
    both = mine.withColumn("longer", F.lit(False)).unionByName(masked.select("word", "n", "mask", keyed(F.col("size") - 1)).withColumn("longer", F.lit(True)))
    a, b = mine.alias("a"), both.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("b.longer") | (F.col("a.word") < F.col("b.word"))) & (F.bit_count(F.col("a.mask").bitwiseXOR(F.col("b.mask"))) <= 2) & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    pairs = a.join(b, near).groupBy(F.col("a.word").alias("word"), F.col("b.word").alias("other")).agg(F.first("a.n").alias("n"), F.first("b.n").alias("other_n"))
    ways = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return pairs.select(F.explode(ways).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of `forms` (word, form)."""
    up = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = checkpointed(up.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return up


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of `docs` (doc_id, text)."""
    words = stored(counted(docs))
    first = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("other"))).alias("first")  # the most frequent, then the first
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), first, F.first("n").alias("n"))
    is_form = -F.col("first.m") >= TIMES * F.col("n")
    best = stored(best.select("word", "n_near", F.when(is_form, F.col("first.other")).alias("form"), F.when(is_form, -F.col("first.m")).alias("form_n")))
    ends = roots(best.where("form IS NOT NULL"))
    rows = words.join(best, "word", "left").join(ends, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: The same in SQL: check sums byte by byte with the table of the polynomial, near words by deletions of a letter.
OP12_SQL = r"""WITH bits AS (SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t FROM range(256) r(b)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS k, hex(encode(doc_id || ':' || w)) AS x FROM runs GROUP BY ALL),
sums AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::INT])), 4294967295) AS h FROM each, bits),
damaged AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w) + 2)::INT) ELSE w END AS w FROM sums),
v AS (SELECT w, sum(k)::BIGINT AS n FROM damaged WHERE length(w) >= 5 GROUP BY w HAVING sum(k) >= 3),
d AS (SELECT w, n, i, substr(w, 1, (i - 1)::INT) || substr(w, (i + 1)::INT) AS rest FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v)),
p AS (SELECT a.w AS a, b.w AS b, b.n AS bn FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND length(a.w) = length(b.w) AND a.w <> b.w
  UNION SELECT v.w, d.w, d.n FROM v JOIN d ON v.w = d.rest UNION SELECT d.w, v.w, v.n FROM v JOIN d ON v.w = d.rest),
s AS (SELECT a, count(*) AS n_near, arg_min(b, (-bn, b)) AS b, max(bn) AS bn FROM p GROUP BY a),
f AS (SELECT v.w AS word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * v.n THEN b END AS form, CASE WHEN bn >= 2 * v.n THEN bn END AS form_n FROM v LEFT JOIN s ON s.a = v.w),
"""
OP12_SQL = OP12_SQL.replace("WITH bits", "WITH RECURSIVE bits", 1) + """chain AS (SELECT word, word AS top, 0 AS k FROM f UNION ALL SELECT chain.word, f.form, k + 1 FROM chain JOIN f ON f.word = chain.top WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(top, k) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)"""
