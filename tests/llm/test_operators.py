"""Operators of the training-data pipeline against SQL, libraries and brute force; edge cases of each."""

import base64
import collections
import hashlib
import itertools
import math
import os
import random
import re
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest

from tests.test_queries import SF, same
from trailframe.llm import byte_bpe, chat_format, decontamination, html_extract, kneser_ney, language_id, ngram_join, phrase_dedup, quality_rules, token_counts
from trailframe.llm.queries import ORACLE_SQL, QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
POOL = pa.proxy_memory_pool(pa.default_memory_pool())  # what it gives must not outlive it
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "x" * 3000), (6, "a b c d e f " * 300), (None, "no id here at all"), (7, "same text twice"), (7, "same text twice"), (8, "naïve ☃ 𝄞 <|endoftext|> don't")]


def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars", "9 AS k", "'x' AS component", "7 AS words", "3 AS block")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    got, want = same(spark, QUERIES[name], ORACLE_SQL[name])
    assert got == want


def test_bpe_is_tiktoken(spark):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.encode_decode(odd(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in out) == sorted((i or 0, own.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD)


def test_bpe_decodes_by_itself(spark):
    bpe = byte_bpe.ByteBpe(spark, RANKS, public_tokenizers.PATTERN)  # nothing is known: every piece is folded where it stands
    docs = odd(spark).selectExpr("text AS t", "doc_id AS row", "k AS ids0")
    coded = bpe.encode(docs, "t", "a.b")
    out = bpe.decode(coded, "`a.b`", "row2").collect()
    assert coded.columns == ["row", "ids0", "a.b"] and sorted(bytes(r.row2).decode() for r in out) == sorted(t or "" for _, t in ODD)
    assert sorted((r.row or 0, len(r["a.b"])) for r in out) == sorted((r.doc_id or 0, len(r.ids)) for r in byte_bpe.encode_decode(odd(spark), RANKS, public_tokenizers.PATTERN).collect())


def test_pieces_are_looked_up_without_a_table_of_all_known_ones():
    known = pa.array([f"piece{i}" for i in range(200_000)])
    pieces = pa.array([["piece7", "new", "piece199999", "new"], [], ["other", "piece7"]], pa.list_(pa.string()))
    whole = pa.default_memory_pool()
    pa.set_memory_pool(POOL)
    try:
        codes, unknown = byte_bpe.look_up(pieces, known)
    finally:
        pa.set_memory_pool(whole)
    assert codes.to_pylist() == [[7, -1, 199_999, -2], [], [-1, 7]] and unknown.to_pylist() == [["new", "new"], [], ["other"]]
    assert POOL.max_memory() < known.nbytes / 2


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)
    out = token_counts.count_tokens(odd(spark), WORDS).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out) == sorted((i or 0, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)


def test_token_counts_take_no_threads_of_their_own():
    code = f"import os\nfrom trailframe.llm import token_counts\nbefore = len(os.listdir('/proc/self/task'))\nassert sum(token_counts.lengths({WORDS!r}, [b'word%d' % i for i in range(2000)])) > 2000\nassert len(os.listdir('/proc/self/task')) == before"
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    subprocess.run([sys.executable, "-c", code], check=True, env=env)


def test_rule_statistics():
    text = b"a b c a b c x\n\na b c a b c x\n $$ d\xc3\xa9"
    assert quality_rules.rule_statistics(text)[:5] == [16, 18, 2, 1, 14]
    assert quality_rules.rule_statistics(None)[:5] == [0] * 5


def test_forest_parts_junk_from_text(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9)))
    texts = [(i, " ".join(word() for _ in range(80)) + "." if i % 4 else " ".join(f"{word()}$$$ ###" for _ in range(60))) for i in range(400)]
    docs, marks = spark.createDataFrame(texts, "doc_id long, text string"), labels(spark, [(i, int(i % 4 > 0), 0) for i in range(0, 400)])
    out = {r.doc_id: r.kept for r in quality_rules.judge(docs, marks).collect()}
    assert sum(out[i] == (i % 4 > 0) for i in out) >= 396
    assert sorted(quality_rules.keep_good(docs, marks).columns) == ["doc_id", "text"]
    assert len(quality_rules.judge(odd(spark), labels(spark)).collect()) == len(ODD)


def test_extraction():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href=/a>Home</a></ul></nav>
    <!-- ad --><div class="ad">Buy now.</div><article><header><h1>Title &amp; more</h1></header><p>First&nbsp;one <b>bold<br>x<p>Short.<aside>See also this</aside><form><input> Mail</form></article>
    <section id="comments"><p>I like this very much indeed.</p></section><div class="cookie-notice">We use cookies.</div><footer>&copy; site</footer></body></html>"""
    tree = html_extract.grow(*html_extract.labelled_table())
    assert html_extract.main_text(page, tree) == "Title & more\nFirst one bold x\nShort."
    assert html_extract.main_text(None, tree) == html_extract.main_text("", tree) == ""
    assert html_extract.main_text("just text", tree) == "just text"
    assert html_extract.main_text("<p>a < b and <!-- never closed", tree) == "a < b and"
    x, y = html_extract.labelled_table()
    assert all(html_extract.verdict(tree, tuple(r)) == k for r, k in zip(x, y))


def test_extraction_inside_an_article():
    """Link lists and sections of an article stay, whatever parts of a text are named; menus, comments and calls to sign up go."""
    tree = html_extract.grow(*html_extract.labelled_table())
    text = lambda page: html_extract.main_text(page, tree)
    long, other = " ".join(["word"] * 60), " ".join(["other"] * 25)
    links = "<ul><li><a href=/a>One source</a></li><li><a href=/b>Second source here</a></li></ul>"
    assert text(f"<body><article><p>{long}</p>{links}<p>{other}</p></article></body>") == f"{long}\nOne source\nSecond source here\n{other}"
    assert text(f"<article><p>{long}</p><p>See <a href=/x>all of these long notes of ours here</a></p><p>Yes.</p></article>") == f"{long}\nSee all of these long notes of ours here\nYes."
    for name in ("related-work", "legal", "discussion", "popular search"):
        assert text(f'<article><h1>Title</h1><p>{long}</p><section class="{name}"><p>{other}</p></section></article>').endswith(other) == (name != "discussion")
    assert text(f'<article><p>{long}</p><div class="related"><a href=/a>More of this</a> <a href=/b>And that</a></div></article>') == long
    for name in ("cmt-list", "cta-box", "comments", "newsletter-signup"):
        assert text(f'<article><p>{long}</p></article><div class="{name}"><p>{other}</p></div>') == long
        assert text(f'<article><p>{long}</p><div class="{name}"><p>{other}</p></div></article>') == long


def test_extraction_reads_a_block_s_own_words_and_links():
    tree = html_extract.grow(*html_extract.labelled_table())

    def used(t):
        return set() if isinstance(t, int) else {html_extract.FEATURES[t[0]]} | used(t[2]) | used(t[3])

    assert {"words", "links", "links_after", "furniture", "main"} <= used(tree)
    long, links = " ".join(["word"] * 300), "<ul><li><a href=/a>One</a><li><a href=/b>Two</a><li><a href=/c>Three</a></ul>"
    text = lambda page: html_extract.main_text(page, tree)
    assert text(f"<article><h1>Two words</h1><p>{long}</p></article><footer><a>Privacy</a> <a>Terms</a></footer>") == f"Two words\n{long}"
    assert text(f"<div><h2>Places</h2><p>{long}</p>{links}</div>") == f"Places\n{long}"
    assert text(f"<article><h2>Places</h2><p>{long}</p>{links}</article>") == f"Places\n{long}"
    assert text(f"<div><a href=/>Home</a> <a href=/n>News</a></div><p>{long}</p>") == long
    words, others, flags = (1, 8, 40, 300), (0, 1, 9, 60, 300), (0, 1)
    for around in itertools.product(others, (0, 100), others, (0, 100)):
        assert all(html_extract.verdict(tree, (w, 0, *around, 0, m, 0)) for w in (40, 300) for m in flags)
        assert not any(html_extract.verdict(tree, (w, 100, *around, 0, 0, 0)) for w in words)
        assert not any(html_extract.verdict(tree, (w, k, *around, 1, m, 0)) for w in words for k in (0, 100) for m in flags)


def test_extraction_is_not_gated_by_an_article():
    tree = html_extract.grow(*html_extract.labelled_table())
    text = lambda page: html_extract.main_text(page, tree)
    first, second = " ".join(["first"] * 60), " ".join(["second"] * 40)
    body = f"<div class=content><h1>Title of it</h1><p>{first}</p><p>{second}</p></div>"
    want = f"Title of it\n{first}\n{second}"
    assert text(f"{body}<aside><article><p>A teaser.</p></article></aside>") == want
    assert text(f"{body}<div class=comments><article><p>I like this.</p></article></div>") == want
    assert text(f"<article><p>{first}</p></article><div><p>{second}</p></div>") == f"{first}\n{second}"
    assert [b[3:5] for b in html_extract.blocks("<aside><article><p>A teaser.</p></article></aside><main><p>Text.</p></main>")] == [(1, 0), (0, 1)]


def test_network_gradients_are_those_of_the_loss():
    net = language_id.BiGru(["a", "b"], units=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net._run.__func__  # noqa: B018
    x, t = np.frombuffer(b"abcxyzqqq", np.uint8).reshape(3, 3), np.array([0, 1, 1])
    loss = lambda: -np.log(net.probabilities(x)[:, np.arange(3), t]).mean()
    g = net.gradients(x, t)
    for name in ("fu", "bn", "fx", "v"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, d = net.p[name][at], 1e-3
        net.p[name][at] = old + d
        up = loss()
        net.p[name][at] = old - d
        down = loss()
        net.p[name][at] = old
        assert math.isclose((up - down) / (2 * d), g[name][at], rel_tol=0.05, abs_tol=1e-4), name


def test_every_language_keeps_training_words(spark, monkeypatch):
    rows = [(i, f"l{i % 70:02}", f"word{i % 70} word{i % 70} other{i}") for i in range(420)]
    words, languages = language_id.training_words(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert languages == sorted({lang for _, lang, _ in rows})
    monkeypatch.setattr(language_id, "WORDS", 300)
    sentence = lambda i: "".join(chr(0x4E00 + (97 * i + 31 * k) % 900) for k in range(80))
    rows = [(i, f"l{i % 13:02}", " ".join(f"{i % 13}x{k}" for k in range(100))) for i in range(260)] + [(i, "zh", sentence(i)) for i in range(1000, 1010)]
    words, languages = language_id.training_words(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert languages == sorted({lang for _, lang, _ in rows})
    kept = {lang: sum(w[0] == lang for w in words) for lang in languages}
    assert min(kept.values()) >= 8 and len(words) <= 400 and kept["zh"] > 8
    assert max(len(w.decode()) for _, w, _ in words) <= language_id.SEGMENT


def test_language_held_out(spark):
    lang = dict(zip(*(pq.read_table(f"{SF}/documents.parquet")[c].to_pylist() for c in ("doc_id", "lang"))))
    out = QUERIES["op5_language_id"](spark, SF).collect()
    held = [r for r in out if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    net = language_id.train([("en", b"the", 5), ("fr", b"les", 5)], ["en", "fr"], steps=5)
    und = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd(spark), net).collect()}
    assert und[1] == und[2] == und[3] == ("und", 0.0) and und[4][0] in ("en", "fr")
    assert {r.lang_pred for r in language_id.predict(odd(spark), None).collect()} == {"und"}


def test_chat_events(spark):
    events = [(1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", ""), (1, 2, "delta", 1, None, "he"), (1, 3, "delta", 1, None, "y"), (1, 4, "edit", 0, None, "hello <|im_end|>"),
              (1, 5, "message", 2, "user", "gone"), (1, 6, "regenerate", 1, None, None), (1, 7, "delta", 1, None, "new <\\| \\"), (2, None, None, None, None, None)]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, turn long, role string, text string")
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.reconstruct(log).collect()}
    assert turns == {1: [("user", "hello <|im_end|>"), ("assistant", "new <\\| \\")], 2: [("", "")]}
    out = chat_format.render(chat_format.reconstruct(log))
    back = {r.conv_id: ([(t.role, t.text) for t in r.back], r.loss) for r in out.select("conv_id", chat_format.parse(out.formatted).alias("back"), chat_format.under_mask(out.formatted, out.loss_spans).alias("loss")).collect()}
    assert back == {1: (turns[1], "new <\\| \\"), 2: (turns[2], "")}


def test_divide_skip_counts():
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(20), rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        t = rng.randint(1, 6)
        want = {d: n for d in range(20) if (n := sum(d in x for x in lists)) >= t}
        assert ngram_join.divide_skip(lists, t, rng.randint(0, 7)) == want


@pytest.mark.parametrize("cell", [2, 5, 128])
def test_links_connect_what_brute_force_connects(spark, cell):
    rng = random.Random(cell)
    base = [[rng.randrange(60) * 7 + b * 1000 for _ in range(40)] for b in range(4)]
    sets = [sorted({x if rng.random() > 0.08 else rng.randrange(10**6) for x in base[i % 4]}) for i in range(60)]
    count = {x: sum(x in s for s in sets) for s in sets for x in s}
    rows = []
    for i, s in enumerate(sets):
        order = sorted(s, key=lambda x: (count[x], x))
        rows.append((i, [x for x in order[: len(s) - ngram_join.needed(len(s)) + 1] if count[x] > 1], order))
    up = list(range(60))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, j in itertools.combinations(range(60), 2):
        if ngram_join.similar(len(set(sets[i]) & set(sets[j])), len(sets[i]), len(sets[j])):
            up[max(find(i), find(j))] = min(find(i), find(j))
    links = ngram_join.class_links(spark.createDataFrame(rows, "class_id long, prefix array<long>, tokens array<long>"), cell)
    got = {r.node: r.component for r in ngram_join.connected_components(links).collect()}
    assert [got.get(i, i) for i in range(60)] == [find(i) for i in range(60)]


def test_sets_that_no_part_can_answer_are_not_sent_to_all(spark, monkeypatch):
    rng = random.Random(11)
    given, cells = [], ngram_join._cells
    monkeypatch.setattr(ngram_join, "_cells", lambda rows: given.append(rows.count()) or cells(rows))

    def rows_of(n):
        sets = [[*rng.sample(range(200), 200 - gone), *range(1000 * i + 1000, 1000 * i + 1000 + gone)] for i in range(n) for gone in [44 if i % 3 == 0 else i % 9]]  # each third shares too little with any of its size
        rows = [(i, sorted(x for x in s if x < 200)[:51], sorted(s)) for i, s in enumerate(sets)]
        given.clear()
        links = ngram_join.class_links(spark.createDataFrame(rows, "class_id long, prefix array<long>, tokens array<long>").selectExpr("class_id", "prefix", "filter(tokens, x -> x < 200) AS tokens", "size(tokens) * 1L AS n"), 8)
        comps = {r.node: r.component for r in ngram_join.connected_components(links).collect()}
        up = list(range(n))
        find = lambda x: x if up[x] == x else find(up[x])
        for i, j in itertools.combinations(range(n), 2):
            if ngram_join.similar(len(set(sets[i]) & set(sets[j])), 200, 200):
                up[max(find(i), find(j))] = min(find(i), find(j))
        assert [comps.get(i, i) for i in range(n)] == [find(i) for i in range(n)]
        return sum(given)

    few, many = rows_of(60), rows_of(240)
    assert many < 5 * few


def test_no_task_gets_the_members_of_a_large_cell(spark, monkeypatch):
    plans, stored = {}, ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df: plans.__setitem__(tuple(df.columns), df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = [list(range(i, i + 40)) for i in range(40)]
        links = ngram_join.class_links(spark.createDataFrame([(i, x[:11], x) for i, x in enumerate(sets)], "class_id long, prefix array<long>, tokens array<long>"), 3)
        assert ngram_join.connected_components(links).groupBy("component").count().collect() == [(0, 40)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    by_cell = [plan for columns, plan in plans.items() if "class_id" in columns and "token" not in columns]
    assert by_cell and not any(re.search(r"hashpartitioning\(pivot#\d+L?, (band#\d+L?, )?\d+\)", plan) for plan in by_cell)


def test_search_by_arrays_finds_what_brute_force_finds():
    for seed in range(120):
        rng = random.Random(seed)
        size, noise, n = rng.choice([3, 8, 40, 90]), rng.choice([0.02, 0.05, 0.08, 0.12]), rng.randint(2, 40)
        bases = [[rng.randrange(200) * 7 + b * 1000 for _ in range(size)] for b in range(rng.randint(1, 4))]
        sets = [{x if rng.random() > noise else rng.randrange(10**6) for x in b[: rng.randint(max(1, len(b) * 3 // 5), len(b))]} for b in rng.choices(bases, k=n)]
        count = collections.Counter(x for s in sets for x in s)
        shared = [np.array(sorted(x for x in s if count[x] > 1), np.int64) for s in sets]
        guest = [seed % 2 == 1 and (i == 0 or rng.random() < 0.4) for i in range(n)]
        want, got = ngram_join._Union(range(n)), ngram_join._Union(range(n))
        near = lambda i, j: ngram_join.similar(len(sets[i] & sets[j]), len(sets[i]), len(sets[j]))  # noqa: B023, E731
        for i, j in itertools.combinations(range(n), 2):
            if near(i, j) and (seed % 2 == 0 or guest[i] != guest[j]):
                want.join(i, j)
        for i, j in ngram_join.links_of_cell(0 if seed % 2 == 0 else None, list(range(n)), [len(s) for s in sets], shared, list(range(n)), guest):
            assert near(i, j) and got.join(i, j)
        assert [got.find(i) for i in range(n)] == [want.find(i) for i in range(n)]


def test_shingles_of_texts_taken_together(monkeypatch):
    rng = random.Random(3)
    letters = ["a", "B", "b", "\u00e9", " ", " ", "\n", "\t", "\x0b", "\x1c", "\u2003", "x" * 9, "y" * 40]
    texts = [None, b"", b"  ", b"x" * 3000, *("".join(rng.choices(letters, k=rng.randint(0, 60))).encode() for _ in range(800))]
    seen = {}
    for together in (50, 10**6):
        monkeypatch.setattr(ngram_join, "TOGETHER", together)
        for text, got in zip(texts, ngram_join.shingle_sets(texts), strict=True):
            words = (text or b"").lower().split()
            want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
            assert len(want) == len(got) and seen.setdefault(frozenset(want), got.tobytes()) == got.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_counts_of_fewer_bits_are_never_too_small(spark):
    from trailframe.llm import exchange

    rng = np.random.default_rng(2)
    keys = [np.unique(np.concatenate([rng.integers(0, 2**64, 50, np.uint64), np.uint64(2**60) * np.arange(i % 7, dtype=np.uint64)])) for i in range(40)]
    true = collections.Counter(int(x) for k in keys for x in k)
    docs = spark.createDataFrame([(i, str(i)) for i in range(40)], "doc_id long, text string")
    blocks, n = exchange.in_blocks(docs, 10)
    assert n > 3
    use = lambda rows, texts, each, counts: pa.table({"keys": pa.array([k.view(np.int64) for k in each], pa.list_(pa.int64())), "counts": pa.array([c.astype(np.int64) for c in counts], pa.list_(pa.int64()))})
    for bits in (64, 40, 32):
        out = exchange.counted(blocks, n, lambda texts: [keys[int(t)] for t in texts], use, "keys array<long>, counts array<long>", bits=bits).collect()
        alike = collections.Counter(int(x) >> (64 - bits) for k in keys for x in k)
        found = {int(x) & (2**64 - 1): c for r in out for x, c in zip(r["keys"], r["counts"])}
        assert found == {x: alike[x >> (64 - bits)] for x in true} and all(found[x] >= c for x, c in true.items())


def test_sets_are_stored_by_document_and_by_class_only(spark, monkeypatch):
    frames, stored = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df: frames.append(df.columns) or stored(df))
    assert {r.doc_id: r.component_id for r in ngram_join.similarity_classes(odd(spark)).collect()}[7] == 7
    assert sum("tokens" in columns for columns in frames) == 2


def test_odd_rows(spark):
    docs = odd(spark)
    assert len(ngram_join.similarity_classes(docs).collect()) == len(ODD)
    assert len(phrase_dedup.mark_repeats(docs).collect()) == len(ODD)
    assert {r.doc_id: r.n_removed for r in phrase_dedup.mark_repeats(docs).collect()}[6] == 1800
    items = benchmark(spark, [(1, "Same text"), (2, None), (3, ""), (None, "one")])
    out = {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in decontamination.decontaminate(docs, items).collect()}
    assert {(1, 0, 0, False), (4, 1, 0, True), (7, 2, 1, True)} <= out
    near = decontamination.proximity_matches(docs, spark.createDataFrame([("same", "twice")], "a string, b string"), 2).collect()
    assert {(r.doc_id, r.pos_a, r.pos_b) for r in near} == {(7, 0, 2)}
    assert len(kneser_ney.score(docs, labels(spark, [(6, 1, 0), (None, 1, None), (5, 0, 1)])).collect()) == len(ODD)
    none = docs.limit(0)
    for frame in (ngram_join.similarity_classes(none), phrase_dedup.mark_repeats(none), decontamination.decontaminate(none, items), quality_rules.judge(none, labels(spark)), kneser_ney.score(none, labels(spark)), token_counts.count_tokens(none, WORDS)):
        assert frame.collect() == []


def test_kneser_ney_is_the_formula(spark):
    text = b"abracadabra abba cabra"
    docs = spark.createDataFrame([(1, text.decode(), "en"), (2, "abrab qab", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.perplexity for r in kneser_ney.score(docs, labels(spark, [(1, 1, 0)])).collect()}
    order = kneser_ney.ORDER
    pad = lambda t: b"\n" * (order - 1) + t
    counts = {order: {}}
    for i in range(len(text)):
        g = pad(text)[i : i + order]
        counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def cut(k, c):
        n = [0, *(sum(v == i for v in counts[k].values()) for i in range(1, 5))]
        if not n[1]:
            return 0.5
        y, i = n[1] / (n[1] + 2 * n[2]), min(c, 3)
        return min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2, 0.05), i - 0.05)

    def p(g):
        if not g:
            return 1 / 256
        k, below = len(g), p(g[1:])
        row = {x: c for x, c in counts[k].items() if x[:-1] == g[:-1]}
        if not row:
            return below
        total = sum(row.values())
        return (row.get(g, 0) - cut(k, row[g]) if g in row else 0) / total + sum(cut(k, c) for c in row.values()) / total * below

    for doc_id, t in ((1, text), (2, b"abrab qab")):
        logs = [math.log(p(pad(t)[i : i + order])) for i in range(len(t))]
        assert math.isclose(got[doc_id], math.exp(-sum(logs) / len(logs)), rel_tol=1e-4)


def test_fences_are_quantiles_of_each_language(spark):
    draw = random.Random(4)
    text = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    rows, judged = [], []
    for k, (lang, letters) in enumerate((("aa", "abcde "), ("bb", "abcdefghijklmnopqrstuvwxyz "), (None, "xyz "), ("few", "pq "))):
        for i in range(12 if lang == "few" else 200):
            rows.append((1000 * k + i, text(letters, 60 + 4 * i), lang)), judged.append((1000 * k + i, 1, 0))
        for i in range(500, 506):
            rows.append((1000 * k + i, text("#$%&/()=?!0123456789", 200), lang)), judged.append((1000 * k + i, 0, 0))
    out = kneser_ney.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels(spark, judged)).collect()
    assert len(out) == len(rows)
    for lang in ("aa", "bb", None, "few"):
        trusted = [r for r in out if r.trusted and (lang == "few" or r.lang == lang)]  # held out from the counts
        assert len(trusted) >= kneser_ney.LEAST and len(trusted) < 0.5 * 612
        fence = {r.fence for r in out if r.lang == lang}
        assert len(fence) == 1 and fence <= {r.perplexity for r in trusted}
        assert sum(r.kept for r in trusted) >= 0.9 * len(trusted) - 1
    assert not any(r.kept for r in out if r.doc_id % 1000 >= 500)


def test_quality_model_on_held_out_labels(spark):
    """Of documents labelled bad few stay, of trusted ones that the model hasn't counted few are lost."""
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op9_kneser_ney"](spark, sf).collect()
    quality = pq.read_table(f"{sf}/labels.parquet").to_pydict()
    bad = {i for i, q in zip(quality["doc_id"], quality["quality"]) if q == 0}
    kept = {r.doc_id for r in out if r.kept}
    trusted = {r.doc_id for r in out if r.trusted}
    assert bad and trusted and len(bad & kept) <= 0.2 * len(bad) and len(trusted & kept) >= 0.85 * len(trusted)


def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    kept = {r.doc_id for r in out}
    assert len(kept) == len(out) and kept <= set(docs["doc_id"]) and len(kept) > 0.5 * len(docs["doc_id"])
    assert all(hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 for r in out)


def made_page(rng):
    """A page and its article, of random templates that are none of the labelled rows."""
    words = lambda n: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{i}'>{words(rng.randint(1, 3))}</a></li>" for i in range(n)) + "</ul>"
    article = [f"<h1>{words(6)}</h1>"] + [f"<p>{words(rng.randint(30, 90))}</p>" for _ in range(rng.randint(2, 6))]
    if rng.random() < 0.5:
        article.insert(2, f"<h2>{words(3)}</h2>")
    text = [p[p.index(">") + 1 : p.rindex("<")] for p in article]
    noise = ["<div class='advert'>" + words(rng.randint(4, 25)) + "</div>", f"<aside>{words(9)}{links(3)}</aside>", f"<form><p>{words(5)}</p><button>{words(1)}</button></form>", "<script>if (a < b) { x() }</script>", "<!-- note -->"]
    for piece in rng.sample(noise, rng.randint(0, 3)):
        article.insert(rng.randint(1, len(article)), piece)
    head = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id='post-body'>{}</div>", "<main><article>{}</article></main>"]).format("".join(article))
    outer = rng.choice(["{}", "<div class='layout has-sidebar'>{}</div>", "<div class='page sidebar-right'>{}</div>", "<form id='all' action='/'>{}</form>"])
    before = [f"<header><a href='/'>{words(2)}</a></header>", f"<nav>{links(rng.randint(3, 9))}</nav>", f"<div class='cookie-banner'><p>{words(14)}</p></div>", f"<div class='breadcrumbs'><a href='/'>{words(1)}</a> {words(1)}</div>"]
    after = [f"<section id='comments'>{''.join(f'<article><p>{words(rng.randint(5, 60))}</p></article>' for _ in range(rng.randint(1, 9)))}</section>", f"<aside class='sidebar'>{words(5)}{links(4)}</aside>", f"<div class='related'><h3>{words(2)}</h3>{links(4)}</div>", f"<div class='newsletter'><p>{words(12)}</p></div>"]
    pick = lambda xs: "".join(x for x in xs if rng.random() < 0.7)
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>{pick(before)}{outer.format(head + pick(after[1:]))}{pick(after[:1])}<footer><p>{words(12)}</p>{links(2)}</footer></body></html>", "\n".join(text)


def test_extraction_of_held_out_pages():
    rng, tree = random.Random(12), html_extract.grow(*html_extract.labelled_table())
    right = both = got_n = want_n = 0
    for _ in range(400):
        page, want = made_page(rng)
        got = html_extract.main_text(page, tree)
        a, b = collections.Counter(got.split()), collections.Counter(want.split())
        right, both, got_n, want_n = right + (got == want), both + (a & b).total(), got_n + a.total(), want_n + b.total()
    assert both >= 0.99 * got_n and both >= 0.99 * want_n and right >= 0.9 * 400, (right, both / got_n, both / want_n)


def test_extraction_of_wrappers_and_heads():
    tree = html_extract.grow(*html_extract.labelled_table())
    long = " ".join(["word"] * 120)
    text = lambda page: html_extract.main_text(page, tree)
    assert text(f"<nav><a href=/>Home</a></nav><div class='layout has-sidebar'><main><h1>Title</h1><p>{long}</p></main><aside><p>See this.</p></aside></div>") == f"Title\n{long}"
    assert text(f"<div class='page sidebar-left'><h1>Title</h1><p>{long}</p><div class=sidebar><a>x</a></div></div><div class=comments><p>{long} {long} {long}</p></div>") == f"Title\n{long}"
    assert text(f"<article><h1>Title</h1><p>{long}</p><p class='more'>And this is more of it.</p></article>") == f"Title\n{long}\nAnd this is more of it."
    assert text(f"<article><div class='post-header'><h1>Title of it</h1></div><p>{long}</p></article>") == f"Title of it\n{long}"
    assert text(f"<header><h1>Site</h1></header><div class=content><h2>Title of it</h2><p>{long}</p></div><article class=teaser><p>A teaser.</p></article>").startswith(f"Title of it\n{long}")


def test_bpe_of_long_pieces(spark):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["x" * 9001, "ab" * 2500, draw("abcdefghijklmnopqrst", 6000), draw([chr(k) for k in range(0x4E00, 0x5000)], 2500), " " * 3000 + "a", "-" * 2500, draw("aab", 3000), "é" * 1500, "the" * 700, "\n" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert out == {i: (own.encode_ordinary(t), t.encode()) for i, t in enumerate(texts)}
    none = byte_bpe.encode_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN)
    assert none.collect() == [] and html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_whole_table_is_as_the_libraries_have_it(spark):
    import tiktoken
    from tokenizers import Tokenizer

    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own, words = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(WORDS)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (len(x := own.encode_ordinary(t or "")), digest(",".join(map(str, x)).encode()), digest((t or "").encode())) for i, t in zip(docs["doc_id"], docs["text"])}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op1_byte_bpe"](spark, SF).collect()} == want
    counts = {i: len(words.encode(t or "", add_special_tokens=False).ids) for i, t in zip(docs["doc_id"], docs["text"])}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op4_token_counts"](spark, SF).collect()} == counts


CLASHING = ("block", "body", "row", "k", "h", "w", "n_words", "n_removed", "n_near", "kept_text", "matches", "found", "stays", "digest", "class", "key", "_k", "_stays", "_text", "a.b")


def test_stages_keep_columns_of_any_name(spark):
    plain = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "no id"), (4, "same text here"), (4, "same text here"), (5, "other words of one id"), (5, "and its second text"), *((6, "a b c d e f " * 20) for _ in range(300))], "doc_id long, text string")
    docs = plain.selectExpr("doc_id", "text", "1L AS n_chars", *(f"'{c}' AS `{c}`" for c in CLASHING))
    marks, items = labels(spark), benchmark(spark, [(1, "a b c d e f a b c d e f a b"), (2, None)])
    for stage in (lambda d: quality_rules.keep_good(d, marks), ngram_join.one_of_each, phrase_dedup.without_repeats, lambda d: decontamination.clean(d, items)):
        for frame in (docs, docs.limit(0)):
            out = stage(frame)
            assert out.columns == docs.columns
            assert all(r[c] == c for r in out.collect() for c in CLASHING)
    assert phrase_dedup.without_repeats(docs).count() == docs.count()
    assert decontamination.clean(docs, items).count() == docs.count() - 300
    assert ngram_join.one_of_each(docs).count() == docs.count()
    hit = decontamination.decontaminate(plain, items).where("doc_id = 6").collect()
    words, item = ("a b c d e f " * 20).split(), "a b c d e f a b c d e f a b".split()
    inside = {k for s in range(108) for w in range(2) if words[s : s + 13] == item[w : w + 13] for k in range(s, s + 13)}
    assert len(hit) == 300 and {(r.n_words, r.n_hit, r.n_items) for r in hit} == {(120, len(inside), 1)} and len(inside) == 116


def test_an_id_of_two_texts_links_both(spark):
    rng = random.Random(5)
    w, v = ([f"{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "wv")
    near = lambda x: " ".join([*x[:-1], "end"])
    rows = [(1, " ".join(w)), (1, " ".join(v)), (2, near(w)), (3, near(v)), (4, "apart from all others here")]
    out = {(r.doc_id, r.component_id) for r in ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, 1), (2, 1), (3, 1), (4, 4)}
    rows = [(5, " ".join(w)), (5, " ".join(v)), (2, near(w)), (9, near(v))]
    out = {(r.doc_id, r.component_id) for r in ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(5, 2), (2, 2), (9, 2)}


def test_base_statistics_are_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = {}
    for i, t in zip(docs["doc_id"], docs["text"]):
        words = [x for x in re.split("[\x20\x09-\x0D]+", t or "") if x]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = collections.Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        want[i] = (len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in QUERIES["op3_quality_forest"](spark, SF).collect()}
    assert got == want


def test_rows_between_blocks_grow_as_the_input():
    from trailframe.llm import exchange

    rows = lambda total: (1 + total // exchange.block_size(total)) ** 2
    assert exchange.block_size(10**8) == exchange.BLOCK_BYTES == exchange.block_size(10**9)
    assert rows(50 * 10**9) < 60 * rows(10**9) and exchange.block_size(10**14) == exchange.MOST_BLOCK_BYTES


def test_texts_go_to_the_forest_once_and_come_back_in_parts(spark, monkeypatch, capsys):
    """A copy of each text beside its row, and whole batches given on, took an executor's memory."""
    text = "Good plain words of a text that is long enough for the rule, as every one of them is another one here: " + " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{text} {i}" if i % 3 else ("few words" if i % 2 else None)) for i in range(50)], "doc_id long, text string").coalesce(1)
    marks = spark.createDataFrame([], "doc_id long, quality int")
    monkeypatch.setattr(quality_rules, "AT_ONCE", 7)
    kept = quality_rules.keep_good(docs, marks)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(i, f"{text} {i}") for i in range(50) if i % 3]
    kept.explain(extended=True)
    assert "cast(text" not in capsys.readouterr().out.lower()
    from_bytes = docs.selectExpr("doc_id", "cast(text as binary) as text")
    assert quality_rules.keep_good(from_bytes, marks).count() == kept.count()


def test_a_block_of_phrases_holds_the_words_of_one_text_at_a_time(spark, monkeypatch):
    """What marks a block's words took over 12 times the texts' bytes, all words of all texts at once."""
    monkeypatch.setattr(phrase_dedup, "in_blocks", lambda docs, carry=None: (docs, 1))
    monkeypatch.setattr(phrase_dedup, "counted", lambda blocks, n, keys_of, use, schema: use)
    use = phrase_dedup.mark_repeats(spark.createDataFrame([], "row boolean"), whole=True)
    texts = [" ".join(f"w{(7 * i + k) % 900}" for i in range(600)).encode() for k in range(400)] + [b"a text  of its own", None, b""]
    counts = [np.full(max(0, len((t or b"").split()) - 34), 1) for t in texts]
    counts[3][10:20] = 2
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "row": pa.nulls(len(texts), pa.bool_())})
    tracemalloc.start()
    try:
        out = use(rows, texts, None, counts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 5 * sum(len(t or b"") for t in texts), peak
    assert out.column("n_removed").to_pylist()[3] >= 44 and out.column("n_words").to_pylist()[-2:] == [0, 0]
    assert out.column("kept_text").to_pylist()[-3:] == ["a text  of its own", None, ""]


def test_ids_are_joined_in_small_parts(spark, monkeypatch):
    """A million pieces were joined at once, in 100 MB of a worker."""
    made = []
    monkeypatch.setattr(byte_bpe, "map_texts", lambda df, make, schema: made.append(make) or spark.createDataFrame([], schema))
    bpe = byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    bpe.known_ids = spark.sparkContext.broadcast((np.arange(300, dtype=np.int32), np.arange(0, 301, 2, dtype=np.int32)))
    bpe.encode(spark.createDataFrame([], "doc_id long, text string"), "text", "ids", "decoded")
    n = 100_000
    codes = np.tile(np.arange(150, dtype=np.int32), 2000)
    lists = pa.ListArray.from_arrays(pa.array([0, n, n, 2 * n, 3 * n], pa.int32()), pa.array(codes))
    batch = pa.RecordBatch.from_arrays([pa.nulls(4, pa.bool_()), lists, pa.array([[]] * 4, pa.list_(pa.list_(pa.int32())))], ["row", "codes", "folded"])
    parts = list(made[1]()(batch))
    assert len(parts) > 1 and sum((p["ids"].to_pylist() for p in parts), []) == [[i for c in codes[a * n : b * n] for i in (2 * int(c), 2 * int(c) + 1)] for a, b in ((0, 1), (1, 1), (1, 2), (2, 3))]
    assert b"".join(d for p in parts for d in p["decoded"].to_pylist()) == b"".join(bpe.pieces.to_pylist()[i] for i in range(300)) * 2000
