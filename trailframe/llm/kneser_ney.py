"""Quality by an interpolated modified Kneser-Ney model over bytes.

The model counts the byte n-grams of all trusted documents (labelled quality 1 and not toxic). Counts of lower
orders are continuation counts; three discounts for each order come from the counts of counts. Documents are
dealt into blocks; each block sends its distinct n-grams, which are joined with the sharded counts, and reads the
probabilities back to give every document the perplexity of its whole text. A document goes if its perplexity is
beyond the fence of its language, a quantile of the perplexities of trusted documents held out from the counts. The level of the quantile
is one for all languages; of LEVELS, that which best parts labelled bad documents from trusted ones.

Edge cases: null and empty texts have no perplexity and are not kept; a null lang is a language of its own; a
language with fewer than `LEAST` held-out documents takes the fence of all languages; without labelled bad text the
level is LEVEL; without trusted text the model is uniform and all texts stay; a null doc_id stays null and is not trusted; repeated rows are scored each;
labels are taken together by doc_id (any row that is bad or toxic unmakes trust); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm.common import small, stored, table
from trailframe.llm.exchange import bodies, in_blocks

#: Parameters: bytes of an n-gram (at most 7), bytes of text in a block, of how many trusted documents one is held
#: out, held-out documents that a language needs for a fence of its own.
ORDER, BLOCK_BYTES, HELD, LEAST = 4, 16_000_000, 4, 30
#: Levels of the fence's quantile to choose from, and the one that is taken without bad documents.
LEVELS, LEVEL = (0.9, 0.95, 0.98, 0.99, 0.995, 0.999), 0.99


def grams(text: bytes, order: int = ORDER) -> np.ndarray:
    """Codes of the n-grams that end at each byte, after a start of line feeds."""
    b = np.frombuffer(b"\n" * (order - 1) + text, np.uint8).astype(np.int64)
    code = np.zeros(len(text), np.int64)
    for i in range(order):
        code = code << 8 | b[i : i + len(text)]
    return code


def block_grams(blocks: DataFrame, order: int = ORDER) -> DataFrame:
    """(block, gram, n): the distinct n-grams of each block, with their counts in its documents to learn from."""

    def run(docs: pa.Table) -> pa.Table:
        each, weights = [], []
        for learn, text in zip((r["learn"] for r in docs.column("row").to_pylist()), bodies(docs.column("body"))):
            if text:
                g, c = np.unique(grams(text, order), return_counts=True)
                each.append(g), weights.append(c if learn else np.zeros(len(g), np.int64))
        keys, where = np.unique(np.concatenate(each) if each else np.zeros(0, np.int64), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate(weights), minlength=len(keys)).astype(np.int64) if each else np.zeros(0, np.int64)
        return pa.table({"block": pa.array(np.full(len(keys), docs.column("block")[0].as_py()), pa.int32()), "gram": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})

    return blocks.groupBy("block").applyInArrow(run, "block int, gram long, n long")


def _last(gram: Column, k: int) -> Column:
    return gram.bitwiseAND(F.lit(256**k - 1).cast("long"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams that occur once to four times."""
    n = counts.agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5))).first()
    if not n[0]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i / 2 for i in (1, 2, 3)]
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]


def model(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, discounted share) of its seen n-grams, and (history, weight of the lower order)."""
    by_order = {order: counts}
    for k in range(order - 1, 0, -1):
        by_order[k] = by_order[k + 1].groupBy(_last(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n"))
    out = []
    for k in range(1, order + 1):
        c = by_order[k]
        d = _discounts(c)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = c.select("gram", "n", F.shiftright("gram", 8).alias("history"), cut.alias("cut"))
        histories = rows.groupBy("history").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight"))
        seen = rows.join(histories, "history").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("share"))
        out.append((stored(seen), stored(histories.select("history", "weight"))))
    return out


def resolve(wanted: DataFrame, orders: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, logp) of distinct n-grams: shares and weights joined order by order, interpolated down to 1 / 256."""
    rows, p = wanted.select("gram"), F.lit(1 / 256)
    for k, (seen, histories) in enumerate(orders, 1):
        rows = rows.withColumns({"_g": _last(F.col("gram"), k), "_h": _last(F.shiftright("gram", 8), k - 1)})
        rows = rows.join(seen.select(F.col("gram").alias("_g"), "share"), "_g", "left").join(histories.select(F.col("history").alias("_h"), "weight"), "_h", "left")
        rows = rows.select("gram", *(["p"] if k > 1 else []), "share", "weight").withColumn("p", F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * (F.col("p") if k > 1 else p)).select("gram", "p")
    return rows.select("gram", F.log("p").alias("logp"))


def calibrate(fenced: DataFrame, labels: DataFrame) -> int:
    """The place in LEVELS that best parts documents labelled bad from trusted ones; ties go to the higher level."""
    bad = labels.where("doc_id IS NOT NULL AND quality = 0").select(F.col("doc_id").cast("long").alias("_bad")).distinct()
    judged = fenced.where("perplexity IS NOT NULL").join(small(bad), F.col("doc_id") == F.col("_bad"), "left").where("trusted OR _bad IS NOT NULL")
    beyond = [F.count_if(F.col(c) & (F.col("perplexity") > F.col("fences")[i])).alias(f"{c}{i}") for c in ("trusted", "bad") for i in range(len(LEVELS))]
    n = judged.withColumn("bad", F.col("_bad").isNotNull()).agg(F.count_if("trusted").alias("trusted"), F.count_if("bad").alias("bad"), *beyond).first()
    if not n["bad"] or not n["trusted"]:
        return LEVELS.index(LEVEL)
    return max(range(len(LEVELS)), key=lambda i: (n[f"bad{i}"] / n["bad"] - n[f"trusted{i}"] / n["trusted"], i))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and a struct (lang, learn, trusted): one of HELD trusted documents, by hash, isn't learned from and sets the fences."""
    ids = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("trusted_id")).agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")).where("good").select("trusted_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # Rows without an id get a key of their own, so that a join by shuffle doesn't send them all to one task.
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.xxhash64("text")).alias("id"))
    joined = rows.withColumn("key", key).join(small(ids.select(F.struct(F.lit(False).alias("none"), F.col("trusted_id").alias("id")).alias("trusted_key"))), F.col("key") == F.col("trusted_key"), "left")
    good, held = F.col("trusted_key").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0
    return joined.select("doc_id", "text", F.struct("lang", (good & ~held).alias("learn"), (good & held).alias("trusted")).alias("marks"))


def score(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, trusted (to set the fence), n_bytes, perplexity, fence and kept of every row."""
    blocks, _ = in_blocks(marked(docs, labels), BLOCK_BYTES, F.col("marks"))
    found = stored(block_grams(blocks, order))
    counts = stored(found.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")))
    known = resolve(found.select("gram").distinct(), model(counts, order))
    answers = found.select("block", "gram").join(known, "gram").select("block", "gram", F.col("logp").cast("float").alias("logp"))

    def run(rows: pa.Table, got: pa.Table) -> pa.Table:
        keys = got.column("gram").to_numpy() if len(got) else np.zeros(0, np.int64)
        at = np.argsort(keys)
        keys, logp = keys[at], (got.column("logp").to_numpy()[at] if len(got) else np.zeros(0))
        texts = bodies(rows.column("body")) if len(rows) else []
        marks = rows.column("row").to_pylist() if len(rows) else []
        perplexity = [float(np.exp(-logp[np.searchsorted(keys, grams(t, order))].mean(dtype=np.float64))) if t else None for t in texts]
        return pa.table({
            "doc_id": pa.array(rows.column("doc_id").to_pylist() if len(rows) else [], pa.int64()), "lang": pa.array([m["lang"] for m in marks], pa.string()), "trusted": pa.array([m["trusted"] for m in marks], pa.bool_()),
            "n_bytes": pa.array([len(t or b"") for t in texts], pa.int64()), "perplexity": pa.array(perplexity, pa.float64())})

    scored = stored(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, lang string, trusted boolean, n_bytes long, perplexity double"))
    good = scored.where("trusted AND perplexity IS NOT NULL")
    quantiles = F.percentile_approx("perplexity", list(LEVELS)).alias("fences")
    own = stored(good.groupBy(F.col("lang").alias("_lang")).agg(quantiles, F.count("*").alias("k")).where(F.col("k") >= LEAST).select("_lang", "fences"))
    over_all = F.lit(good.agg(quantiles).first()["fences"]).cast("array<double>")
    fenced = scored.join(small(own), F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("fences", F.coalesce("fences", over_all)).drop("_lang")
    fence = F.col("fences")[calibrate(fenced, labels)]
    return fenced.withColumn("fence", fence).drop("fences").withColumn("kept", F.col("perplexity").isNotNull() & (F.col("fence").isNull() | (F.col("perplexity") <= F.col("fence"))))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
