"""Stretches of words that repeat with a period, in every text; what is left when each is cut to its first period.

A lag (distance of two words) has as many matches as there are words equal to the word so far behind. Matches of
frequent words come from the exact autocorrelation of their places by a Fourier transform, those of rare words from
the differences of their places. A run of period q and length n has n - q matches in a row at lag q, so only lags with
enough matches, beyond those that runs of a divisor of the lag account for, are scanned for islands: at places so far
apart that an island cannot pass between them, and word by word where all of these match.

A text is worked on in one task, in time n * sqrt(n) at most for n words, as its result is one row. Texts are not
shuffled.

Edge cases: null and empty texts have no words, no runs, four nulls and the digests of empty strings; a null doc_id
plants no repetition; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm.common import binary_list, map_texts, table, words_of

#: Parameters: a run has so many words, and so many times its period, at least; words of over FREQUENT * sqrt(n) places are
#: frequent; places that are looked at first in an island.
WORDS, TIMES, FREQUENT, PROBES = 6, 4, 2.0, 16


def _fast_length(n: int) -> int:
    """A length that a Fourier transform takes well, at least n."""
    return min(m << max(0, (-(-n // m) - 1).bit_length()) for m in (1, 3, 5))


def matches_by_lag(ids: np.ndarray, most: int) -> np.ndarray:
    """For each lag up to `most`, how many places hold the word of the place so far behind (at 0: nothing of use)."""
    counts = np.bincount(ids)
    frequent = np.flatnonzero(counts > max(32, FREQUENT * len(ids) ** 0.5))
    out = np.zeros(most + 1, np.int64)
    if len(frequent):
        size, power = _fast_length(len(ids) + most), 0.0
        for word in frequent:
            spectrum = np.fft.rfft(ids == word, size)
            power = power + spectrum.real**2 + spectrum.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        counts[frequent] = 0
    places = np.argsort(ids, kind="stable")
    words = ids[places]
    for k in range(1, counts.max(initial=0)):
        some = counts[words] > k
        places, words = places[some], words[some]
        steps = (places[k:] - places[:-k])[words[k:] == words[:-k]]
        out += np.bincount(steps[steps <= most], minlength=most + 1)
    return out


def _stretches(match: np.ndarray, least: int) -> np.ndarray:
    """(first, end) of the stretches of at least `least` matches."""
    steps = np.diff(match.astype(np.int8), prepend=0, append=0)
    found = np.stack([np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)], axis=1)
    return found[found[:, 1] - found[:, 0] >= least]


def islands(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of at least `least` places that match those a lag ahead."""
    n, step = len(ids) - lag, max(1, least // PROBES)
    probes = _stretches(ids[:n:step] == ids[lag::step][: -(-n // step)], least // step)
    if step == 1:
        return [tuple(x) for x in probes.tolist()]
    out = []
    for first, end in probes.tolist():
        low, high = max(0, (first - 1) * step + 1), min(n, end * step)
        out += [(low + a, low + b) for a, b in _stretches(ids[low:high] == ids[low + lag : high + lag], least).tolist()]
    return out


def _is_primitive(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of the given period has no smaller one: a smaller one would divide it."""
    left, prime = period, 2
    while left > 1:
        if prime * prime > left:
            prime = left
        if left % prime == 0:
            part = period // prime
            if np.array_equal(ids[start : start + period - part], ids[start + part : start + period]):
                return False
            while left % prime == 0:
                left //= prime
        prime += 1
    return True


def periodic_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's word numbers, by start, then period."""
    most = len(ids) // TIMES
    if len(ids) < WORDS:
        return []
    lags = np.arange(most + 1)
    need = np.maximum(WORDS - lags, (TIMES - 1) * lags)
    left = matches_by_lag(ids, most)
    out = []
    for q in (np.flatnonzero(left[1:] >= need[1:]) + 1).tolist():
        if left[q] < need[q]:
            continue
        for first, end in islands(ids, q, int(need[q])):
            if _is_primitive(ids, first, q):
                out.append((first, end - first + q, q))
                # At a multiple of the period, what matches inside the run is the run and nothing else.
                more = np.arange(2 * q, min(most, end - first + q) + 1, q)
                left[more] -= end - first + q - more
    return sorted(out, key=lambda run: (run[0], run[2]))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a text, repeated from a place on in every tenth document, by its id."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def runs_row(words: list[bytes]) -> tuple:
    """n_runs, start, length, period and exponent of the longest run, digest of all runs, digest of the words kept."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    found = periodic_runs(ids)
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found).encode()
    text = b" ".join([words[k] for k in np.flatnonzero(kept).tolist()] if found else words)
    return len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest()


_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def runs_of(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id and what `runs_row` says of each document; with `plant`, of its words repeated by the id."""
    def make():
        def each(batch):
            ids, texts = batch.column("doc_id"), binary_list(batch.column("text"))
            rows = [runs_row(planted(words_of(t), i) if plant else words_of(t)) for i, t in zip(ids.to_pylist(), texts)]
            return {"doc_id": ids} | {c: [r[k] for r in rows] for k, c in enumerate(_COLUMNS)}

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, make, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(table(spark, sf_dir, "documents"), plant=True)
