"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read the bytes of a segment, one from each end; at every position their states give
probabilities of the languages, and a document's probabilities are the mean over all its positions. Segments
are words with the white space before them (long ones in overlapping pieces of `SEGMENT` bytes), so that equal words need the
network once in a worker and every position is read. The network is
trained here, by backpropagation through time in numpy, on words of a bounded sample of labelled documents.

Edge cases: texts that are null or have no letter get `und` with score 0; a null doc_id counts as the text
"null" in the held-out rule (its crc32 is null: not held out) and stays null; without any labelled text all get
`und`; repeated rows are judged each; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm.common import binary_list, map_texts, stored, table

#: Parameters: sampled documents of each language and distinct words in all, about, bytes of a segment, units of each direction, steps and segments of a step of the training, words in a worker's cache,
#: bytes of texts whose new words are judged together.
DOCS_EACH, WORDS, SEGMENT, UNITS, STEPS, BATCH, CACHED, GROUP_BYTES = 250, 100_000, 32, 16, 500, 512, 200_000, 2_000_000
#: Parameter: bytes that two segments of a long word share.
SHARED = 8

_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """Weights and passes of the network. Bytes index rows of the input weights; float32 throughout."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, units
        w = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {f"{d}{k}": v for d in "fb" for k, v in (("x", w(256, 3 * units, scale=0.3)), ("u", w(units, 2 * units, scale=units**-0.5)), ("n", w(units, units, scale=units**-0.5)))}
        self.p |= {"v": w(2 * units, len(languages), scale=(2 * units) ** -0.5), "c": np.zeros(len(languages), np.float32)}

    def _run(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each byte of equally long segments x (n x t): t x n x units."""
        h, (n, t) = self.h, x.shape
        wx, u, un = self.p[f"{d}x"], self.p[f"{d}u"], self.p[f"{d}n"]
        state, out = np.zeros((n, h), np.float32), np.empty((t, n, h), np.float32)
        for i in range(t):
            a = wx[x[:, i]]
            gates = _sigmoid(a[:, : 2 * h] + state @ u)
            z, r = gates[:, :h], gates[:, h:]
            q = state @ un
            new = np.tanh(a[:, 2 * h :] + r * q)
            if keep is not None:
                keep.append((state, z, r, q, new))
            state = new + z * (state - new)
            out[i] = state
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """t x n x languages for equally long segments."""
        both = np.concatenate([self._run("f", x), self._run("b", x[:, ::-1])[::-1]], axis=2)
        logits = both @ self.p["v"] + self.p["c"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, through all steps of both directions."""
        h, (n, t) = self.h, x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run("f", x, kept["f"]), self._run("b", x[:, ::-1], kept["b"])[::-1]], axis=2)
        logits = both @ self.p["v"] + self.p["c"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        dl = e / e.sum(axis=2, keepdims=True)
        dl[:, np.arange(n), target] -= 1
        dl /= n * t
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["v"], g["c"] = np.einsum("tnh,tnl->hl", both, dl), dl.sum((0, 1))
        dboth = dl @ self.p["v"].T
        for d, dout, xs in (("f", dboth[:, :, :h], x), ("b", dboth[::-1, :, h:], x[:, ::-1])):
            u, un, carry = self.p[f"{d}u"], self.p[f"{d}n"], np.zeros((n, h), np.float32)
            for i in reversed(range(t)):
                state, z, r, q, new = kept[d][i]
                ds = dout[i] + carry
                dnew = ds * (1 - z) * (1 - new * new)
                dz = ds * (state - new) * z * (1 - z)
                dr = dnew * q * r * (1 - r)
                dq = dnew * r
                dgates = np.concatenate([dz, dr], axis=1)
                g[f"{d}u"] += state.T @ dgates
                g[f"{d}n"] += state.T @ dq
                np.add.at(g[f"{d}x"], xs[:, i], np.concatenate([dgates, dnew], axis=1))
                carry = ds * z + dgates @ u.T + dq @ un.T
        return g


def segments(word: bytes) -> list[bytes]:
    """A word behind the white space before it, in pieces of SEGMENT bytes of which each begins SHARED bytes before the last one's end."""
    spaced = b" " + word
    return [spaced[i : i + SEGMENT] for i in range(0, max(len(spaced) - SHARED, 1), SEGMENT - SHARED)]


def train(words: list[tuple[str, bytes, int]], languages: list[str], steps: int = STEPS, batch: int = BATCH, seed: int = 5) -> BiGru:
    """From (language, word, count); batches hold segments of one length, drawn by their bytes and counts."""
    rng, net = np.random.default_rng(seed), BiGru(languages)
    index = {lang: k for k, lang in enumerate(languages)}
    each = [0] * len(languages)
    for lang, _, n in words:
        each[index[lang]] += n
    by_length: dict[int, tuple[list, list, list]] = {}
    for lang, word, n in words:
        k = index[lang]
        for s in segments(word):
            group = by_length.setdefault(len(s), ([], [], []))
            group[0].append(s), group[1].append(k), group[2].append(n / each[k])  # all languages weigh the same
    groups = {t: (np.frombuffer(b"".join(s), np.uint8).reshape(-1, t), np.array(k), np.cumsum(w)) for t, (s, k, w) in by_length.items()}
    lengths = sorted(groups)
    share = np.array([groups[t][2][-1] * t for t in lengths])
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, k, w = groups[lengths[rng.choice(len(lengths), p=share / share.sum())]]
        at = np.minimum(np.searchsorted(w, rng.random(batch) * w[-1], side="right"), len(w) - 1)
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for name, g in net.gradients(x[at], k[at]).items():  # Adam
            m[name] += 0.1 * (g - m[name])
            v[name] += 0.01 * (g * g - v[name])
            net.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_words(docs: DataFrame) -> tuple[list[tuple[str, bytes, int]], list[str]]:
    """Words of a sample, by hash of doc_id, of about DOCS_EACH documents of each language; the most frequent ones of
    each, about WORDS in all. A language takes an equal share of what those with fewer words leave,
    and 20 words at least, so that none falls out."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    shares = labelled.groupBy("lang").agg(F.least(F.lit(1.0), DOCS_EACH / F.count("*")).alias("share"))
    sample = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(2**20)) < F.col("share") * 2**20)
    # Text without spaces is cut into pieces, which the segments are cut from
    pieces = F.regexp_extract_all("text", F.lit(rf"[^\x20\x09-\x0D]{{1,{SEGMENT}}}"), F.lit(0))
    words = stored(sample.select("lang", F.explode(pieces).alias("word")).groupBy("lang", "word").count())
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in words.groupBy("lang", "count").agg(F.count("*").alias("words")).collect():
        sizes.setdefault(r["lang"], []).append((r["count"], r["words"]))
    cuts, left = [], WORDS
    for k, (lang, each) in enumerate(sorted(sizes.items(), key=lambda x: (sum(n for _, n in x[1]), x[0]))):
        room = quota = min(sum(n for _, n in each), max(20, left // (len(sizes) - k)))
        left -= quota
        for count, n in sorted(each, reverse=True):  # all words of the higher counts, a share of those of the last
            if n >= room:
                cuts.append((lang, count, room / n))
                break
            room -= n
    if not cuts:
        return [], []
    kept = words.join(F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, least long, part double")), "lang")
    at = F.pmod(F.xxhash64("word", "lang"), F.lit(2**20))
    rows = kept.where((F.col("count") > F.col("least")) | (F.col("count") == F.col("least")) & (at < F.col("part") * 2**20)).select("lang", "word", "count").collect()
    rows.sort(key=lambda r: (r["lang"], r["word"]))
    return [(r["lang"], r["word"].encode(), r["count"]) for r in rows], sorted({r["lang"] for r in rows})


def predict(docs: DataFrame, net: BiGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        net = sent.value
        known: dict[bytes, int] = {}
        sums = np.zeros((0, len(net.languages) if net else 0), np.float32)  # of a word's positions

        def learn(words: list[bytes]) -> None:
            nonlocal sums
            if len(known) + len(words) > CACHED:
                known.clear()
                sums = sums[:0]
            base = len(sums)
            sums = np.concatenate([sums, np.zeros((len(words), sums.shape[1]), np.float32)])
            by_length: dict[int, tuple[list, list]] = {}
            for i, word in enumerate(words, base):
                known[word] = i
                for s in segments(word):
                    group = by_length.setdefault(len(s), ([], []))
                    group[0].append(s), group[1].append(i)
            for t, (segs, at) in by_length.items():
                for i in range(0, len(segs), 4096):
                    x = np.frombuffer(b"".join(segs[i : i + 4096]), np.uint8).reshape(-1, t)
                    np.add.at(sums, at[i : i + 4096], net.probabilities(x).sum(axis=0))

        def judge(texts: list[bytes]) -> Iterator[tuple[str, float]]:
            """Of some texts at once, so that the network runs over many new words of one length together."""
            words = [t.split() if net and _LETTER.search(t.decode()) else [] for t in texts]
            distinct = set().union(*words)
            missing = distinct.difference(known)
            if missing:
                learn(list(missing if len(known) + len(missing) <= CACHED else distinct))
            for each in words:
                if not each:
                    yield "und", 0.0
                    continue
                p = sums[[known[w] for w in each]].sum(axis=0, dtype=np.float64)
                p /= p.sum()
                yield net.languages[int(p.argmax())], float(p.max())

        def each(batch: pa.RecordBatch) -> dict:
            out, group, size = [], [], 0
            for text in binary_list(batch.column("text")):
                group.append(text or b"")
                size += len(group[-1])
                if size >= GROUP_BYTES:
                    out += judge(group)
                    group, size = [], 0
            out += judge(group)
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": [x for x, _ in out], "score": [x for _, x in out]}

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_texts(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words, languages = training_words(docs)
    return predict(docs, train(words, languages) if words else None)
