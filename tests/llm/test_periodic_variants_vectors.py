"""Periodic runs, spelling variants and nearest vectors against brute force; edge cases of each."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, odd
from trailframe.llm import nearest_vectors, periodic_runs, spelling_variants
from trailframe.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every maximal stretch that keeps a period q, for each q, if q is its smallest period."""
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            smallest = next(p for p in range(1, q + 1) if all(part[k] == part[k + p] for k in range(len(part) - p)))
            if smallest == q and len(part) >= max(6, 4 * q):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_as_by_brute_force():
    rng = random.Random(1)
    for k in range(400):
        words = [rng.randrange(rng.choice((1, 2, 3, 30))) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            part = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
            words += part * rng.randrange(1, 9) + part[: rng.randrange(len(part))]
            words += [rng.randrange(30) for _ in range(rng.randrange(4))]
        ids = np.unique(words, return_inverse=True)[1].astype(np.int64) if words else np.zeros(0, np.int64)
        assert periodic_runs.periodic_runs(ids) == plain_runs(words), words


@pytest.mark.parametrize("frequent", [0.0, 2.0, 1e9])
def test_matches_by_lag(monkeypatch, frequent):
    monkeypatch.setattr(periodic_runs, "FREQUENT", frequent)
    ids = np.random.default_rng(3).zipf(1.5, 3000) % 50
    want = [0, *(int((ids[:-p] == ids[p:]).sum()) for p in range(1, 751))]
    assert periodic_runs.matches_by_lag(ids, 750)[1:].tolist() == want[1:]


def test_long_texts_of_one_period():
    ids = np.tile(np.arange(7), 20_000)
    assert periodic_runs.periodic_runs(ids) == [(0, 140_000, 7)]
    ids[70_000] = 9
    assert periodic_runs.periodic_runs(ids) == [(0, 70_000, 7), (70_001, 69_999, 7)]


def test_op11_on_a_table(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in periodic_runs.op11_periodic_runs(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
            some += 1
        elif len(words) > 400:
            continue  # brute force is slow
        if len(words) > 1500:
            continue
        runs = plain_runs(words)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[doc_id]
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
    assert some > 3


def test_runs_edge_cases(spark):
    out = periodic_runs.runs_of(odd(spark)).collect()
    assert len(out) == len(ODD) and {r.doc_id: r.n_runs for r in out}[6] == 1
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_runs, r.start, r.runs_sha256, r.collapsed_sha256) == (0, None, empty, empty) for r in out if r.doc_id in (1, 2, 3))
    assert periodic_runs.runs_of(odd(spark).limit(0), plant=True).collect() == []


def plain_variants(rows):
    counts = {}
    for doc_id, text in rows:
        for w in spelling_variants.letter_runs(text or "", doc_id):
            w = w.decode("latin-1")
            counts[w] = counts.get(w, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, words = {}, sorted(counts)
    beside = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and near(w, v)] for w in words}
    for w in words:
        best = min(beside[w], key=lambda v: (-counts[v], v.encode()), default=None)
        out[w] = (best if best and counts[best] >= 2 * counts[w] else None, counts[w], len(beside[w]))
    return out


def test_variants_as_by_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(("er", "on", "th", "é", "a", "ß", "st")) for _ in range(rng.randrange(2, 6)))
    stock = [word() for _ in range(250)]
    rows = [(i, " ".join(rng.choice(stock) if rng.random() < 0.8 else word().upper() for _ in range(300)) + " Ää1zz×y÷ 漢字abcdef 12345") for i in range(12)] + [(None, "thonerst " * 4), (3, None), (4, ""), (5, "aaaaab aaaaac " * 5), (None, "zzcdef " * 3 + "zzcdeg " * 8 + "zzcdhg " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS word", "2 AS key")
    got = {r.word: r for r in spelling_variants.variants(docs).collect()}
    want = plain_variants(rows)
    assert {w: (r.form, r.n, r.n_near) for w, r in got.items()} == want
    for w, r in got.items():
        top = w
        while want[top][0]:
            top = want[top][0]
        assert r.root == top and r.form_n == (want[r.form][1] if r.form else None)
    assert got["zzcdef"].form == "zzcdeg" and got["zzcdef"].root == "zzcdhg"
    assert spelling_variants.variants(docs.limit(0)).collect() == []


def test_letters_are_runs_of_the_pattern():
    import re

    text = "Zoë's naïve×÷ ÀÉÿ ĀBC a b_c-d 9x10 \U0001d11eend"
    runs = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[A-Za-zÀ-ÿ]+", text)]
    assert [w.decode("latin-1") for w in spelling_variants.letter_runs(text, None)] == runs
    for w, d in zip(runs, spelling_variants.letter_runs(text, 5, damaged=1)):
        h = zlib.crc32(f"5:{w}".encode())
        assert d.decode("latin-1") == w[: h % len(w)] + w[h % len(w) + 1 :]


def plain_nearest(rows, k=20, every=20):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in rows:
        if i % every == 0:
            scores = (vectors * np.array(v, np.float64)).sum(axis=1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def recall(got, want):
    return sum(len({x for x, _ in got.get(q, [])} & {x for x, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_of_the_forest(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = plain_nearest(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = found(nearest_vectors.neighbours(df, F.col("vec_id") % 20 == 0, leaf=64, slice_rows=20, slice_asked=7))
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    assert all(len(x) == 20 for x in got.values())
    exact = {q: dict(w) for q, w in want.items()}
    assert all(abs(s - exact[q][i]) < 1e-12 for q, x in got.items() for i, s in x if i in exact[q])


def test_lengths_differ_and_copies_tie(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(900, 6)) * rng.lognormal(size=(900, 1))
    rows = [(i, [float(np.float32(x)) for x in base[i if i % 3 else 0]]) for i in range(900)]  # a third are copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = plain_nearest(rows)
    assert found(nearest_vectors.neighbours(df, F.col("vec_id") % 20 == 0)) == want  # one leaf holds all
    got = found(nearest_vectors.neighbours(df, F.col("vec_id") % 20 == 0, leaf=32, slice_rows=16, slice_asked=5))
    assert got.keys() == want.keys() and recall(got, want) >= 0.9


def test_vectors_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (None, [1.0, 3.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS leaf", "'x' AS vector")
    got = found(nearest_vectors.neighbours(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(7, 1.0), (8, 1.0), (20, 0.0)], 20: [(7, 2.0), (8, 2.0), (0, 0.0)]}
    assert nearest_vectors.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest_vectors.neighbours(df.where("vec_id = 1"), F.col("vec_id") % 20 == 0).collect() == []
