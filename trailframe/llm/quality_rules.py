"""Quality rules by an isolation forest over rule statistics.

Every text gets its rule statistics in one pass. A forest of random splits is grown on statistics of labelled
good rows; documents whose mean path is short stand apart from good text. The score above which a document goes
is calibrated on labelled rows that the forest has not seen: the lowest score that costs at most `GOOD_LOST` of
the good rows and best parts bad from good.

Edge cases: null and empty texts have no words and fail the base rule; a null doc_id stays null; repeated rows
are judged each; labels with null doc_id or quality are ignored, of several labels of a document any is used, of its several texts one;
with fewer than `LEAST_LABELS` good rows only the base rule decides; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from trailframe.llm.common import binary_list, give_back, map_texts, table

#: Parameters: labelled rows used for fitting and calibration at most (by hash of doc_id), trees, rows of a tree,
#: share of good rows that the threshold may cost, good rows needed for a forest.
LABELLED, TREES, TREE_ROWS, GOOD_LOST, LEAST_LABELS = 8_192, 100, 256, 0.001, 50
#: Parameter: rows of a batch that are judged and given on at once.
AT_ONCE = 1_000
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_no_alpha", "n_upper", "n_punct")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE + EXTRA)

_NON_SYMBOL, _NON_UPPER, _NON_PUNCT = (bytes(b for b in range(256) if b not in keep) for keep in (b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?.,;:"))
_NOT_CODE_POINTS = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"
_ALPHA = re.compile(rb"[A-Za-z\x80-\xff]")


def rule_statistics(text: bytes | None) -> list[int]:
    """The statistics of one text, in the order of BASE and EXTRA."""
    text = text or b""
    words = text.split()
    repeat, n = 0, len(words)
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        seen: set = set()
        twice = set()
        for w in windows:
            if w in seen:
                twice.add(w)
            else:
                seen.add(w)
        if twice:
            covered = -1
            for i, w in enumerate(windows):
                if w in twice:
                    repeat += i + 3 - max(i, covered)
                    covered = i + 3
    dup, lines = 0, set()
    for line in text.split(b"\n"):
        if line.strip():
            dup += line in lines
            lines.add(line)
    bare = {w for w in set(words) if not _ALPHA.search(w)}
    return [
        n, len(text.translate(None, _NOT_CODE_POINTS)), len(text.translate(None, _NON_SYMBOL)), dup, repeat,
        sum(w in bare for w in words) if bare else 0, len(text.translate(None, _NON_UPPER)), len(text.translate(None, _NON_PUNCT)),
    ]


def features(stats: np.ndarray) -> np.ndarray:
    """Rates that do not depend on a text's length, on a scale that spreads small ones; n x 8 statistics to n x 5.

    Repeats and doubled lines are left out: good short texts vary in them. The base rule judges repeated words; doubled
    lines of a text that passes it are judged by nothing."""
    n, chars, symbols, _, _, bare, upper, punct = stats.T.astype(float)
    n1, c1 = np.maximum(n, 1), np.maximum(chars, 1)
    return np.log1p(20 * np.stack([chars / n1, symbols / n1, bare / n1, upper / c1, punct / n1], axis=1))


class Forest:
    """Isolation trees over rows `x`, as arrays; a leaf has feature -1 and its corrected path length.

    Splits are drawn from the range that `domain` spans inside a node's box, not from that of the node's own
    rows: where good text has no rows, a path ends soon, however many bad rows look alike.
    """

    def __init__(self, x: np.ndarray, domain: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        self.depth = int(np.ceil(np.log2(max(rows, 2))))
        self.norm = self._mean_path(rows)
        self.trees = [self._grow(x[rng.choice(len(x), rows, replace=False)], domain.min(0), domain.max(0), rng) for _ in range(trees)]

    @staticmethod
    def _mean_path(n: int) -> float:
        return 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else float(n == 2)

    def _grow(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feature, cut, child = [], [], []

        def node(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> int:
            at = len(feature)
            feature.append(-1), cut.append(0.0), child.append((at, at))
            spread = np.flatnonzero(hi > lo)
            if depth >= self.depth or len(rows) < 2 or not len(spread):
                cut[at] = depth + self._mean_path(len(rows))
                return at
            f = rng.choice(spread)
            c = rng.uniform(lo[f], hi[f])
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = c
            left = node(rows[rows[:, f] < c], lo, below, depth + 1)
            feature[at], cut[at], child[at] = int(f), float(c), (left, node(rows[rows[:, f] >= c], above, hi, depth + 1))
            return at

        node(x, lo, hi, 0)
        return np.array(feature), np.array(cut), np.array(child)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): higher is odder."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, cut, child in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, child[at, (x[every, f] >= cut[at]).astype(int)])
            total += cut[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def calibrate(good: np.ndarray, bad: np.ndarray, lost: float = GOOD_LOST) -> float:
    """The score above which a row goes: of those that cost at most `lost` of the good rows the one that best parts
    bad from good, moved half way to the next bad score."""
    floor = np.quantile(good, 1 - lost, method="higher")
    if not len(bad):
        return float(floor)
    cuts = np.unique(np.concatenate([[floor], good[good >= floor], bad[bad >= floor]]))
    cut = max(cuts, key=lambda c: ((bad > c).mean() - (good > c).mean(), -c))
    above = bad[bad > cut]
    return float((cut + above.min()) / 2 if len(above) else cut)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the rule statistics of every row."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            rows = [rule_statistics(t) for t in binary_list(batch.column("text"))]
            return {"doc_id": batch.column("doc_id")} | {c: [r[i] for r in rows] for i, c in enumerate(BASE + EXTRA)}

        return each

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, STATS_SCHEMA)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[Forest, float] | None:
    """Forest and threshold from at most `labelled` labelled rows; half of the good rows grow the forest, all others calibrate."""
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").orderBy(F.xxhash64("doc_id"), "quality").limit(labelled)
    sample = sample.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "label_id")  # at most `labelled` rows, so it can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("label_id")), F.col("doc_id") == F.col("label_id"), "left_semi")
    one = statistics(texts).groupBy("doc_id").agg(F.min(F.struct(*BASE, *EXTRA)).alias("stats")).select("doc_id", "stats.*")  # of several rows of an id one
    pdf = one.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).drop("label_id").toPandas().sort_values("doc_id")
    stats, quality = pdf[list(BASE + EXTRA)].to_numpy(), pdf["quality"].to_numpy()
    passes = (stats[:, 0] >= MIN_WORDS) & (100 * stats[:, 4] <= MAX_REPEAT_PERCENT * stats[:, 0])
    good, bad = features(stats[passes & (quality == 1)]), features(stats[passes & (quality == 0)])
    if len(good) < LEAST_LABELS:
        return None
    forest = Forest(good[0::2], features(stats[passes]))
    return forest, calibrate(forest.score(good[1::2]), forest.score(bad))


def verdicts(stats: np.ndarray, model: tuple[Forest, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept and score of rows of statistics."""
    failed = (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])
    score = model[0].score(features(stats)) if model and len(stats) else np.zeros(len(stats))
    return failed, ~failed & (score <= (model[1] if model else 1.0)), score


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base statistics, base_failed, kept and anomaly score of every row of `docs`."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            stats = np.array([rule_statistics(t) for t in binary_list(batch.column("text"))], dtype=np.int64).reshape(-1, len(BASE + EXTRA))
            failed, kept, score = verdicts(stats, model.value)
            return {"doc_id": batch.column("doc_id")} | {c: stats[:, i] for i, c in enumerate(BASE)} | {"base_failed": failed, "kept": kept, "score": score}

        return each

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double"
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns whatever their names, that base rule and forest keep."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    at = docs.columns.index("text")
    own = docs.schema[at].dataType == StringType()  # then texts go to the workers once, inside their row

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, AT_ONCE) for k in range(0, len(batch), AT_ONCE)):
                texts = part.column("row").field(at) if own else part.column("text")
                stats = np.array([rule_statistics(t) for t in binary_list(texts)], dtype=np.int64).reshape(-1, len(BASE + EXTRA))
                part = part.filter(pa.array(verdicts(stats, model.value)[1])).select(["row"])
                texts = stats = None
                give_back()
                yield part
        batch = part = None  # as in map_texts
        give_back()

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *([] if own else [F.col("text").cast("string").alias("text")]))
    kept = rows.mapInArrow(run, StructType().add("row", rows.schema["row"].dataType))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op3_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
