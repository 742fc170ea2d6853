"""Removal of repeated phrases by sharded Aho-Corasick automata.

Windows of words that occur more than once are confirmed by counts over all documents (see exchange.py, without
a row for each window); consecutive confirmed windows make recurring passages. Every block of documents compiles
its passages into one automaton over word numbers and streams all its documents through it; each located passage
covers its words, and covered words go. Blocks are the shards: an automaton holds no more than the passages that
occur in its block, however many the corpus has.

Edge cases: null and empty texts have no words; a null doc_id is kept; repeated rows repeat each other's windows;
texts shorter than a window keep all words; windows may overlap, and may repeat inside one text; an empty table
gives no rows; other columns, whatever their names, are ignored or kept as they are. Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailframe.llm.common import table, words_of
from trailframe.llm.exchange import counted, in_blocks, window_hashes, word_hashes

#: Fixed value of the contract: words of a window.
WINDOW = 35


def numbered(texts: list[bytes | None]) -> list[array]:
    """The words of every text as numbers, equal words alike; words themselves are held for one text at a time, as all of a block's take many times its bytes."""
    numbers: dict[bytes, int] = {}
    return [array("i", [numbers.setdefault(w, len(numbers)) for w in words_of(t)]) for t in texts]


def passages(repeated: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Word ranges [start, end) of the runs of repeated windows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    return [(int(a), int(b) + size - 1) for a, b in zip(edge[0::2], edge[1::2])]


def locate(texts: Sequence[Sequence[int]], recurring: set[tuple[int, ...]]) -> list[np.ndarray]:
    """For every text, a mask of the words inside any occurrence of a recurring passage; words are numbers."""
    if not recurring:
        return [np.zeros(len(t), bool) for t in texts]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for p in recurring:
        automaton.add_word(p)
    automaton.make_automaton()
    masks = []
    for t in texts:
        steps = np.zeros(len(t) + 1, np.int64)
        for end, length in automaton.iter(tuple(t)) if t else ():
            steps[end - length + 1] += 1
            steps[end + 1] -= 1
        masks.append(np.cumsum(steps)[:-1] > 0)
    return masks


def mark_repeats(docs: DataFrame, size: int = WINDOW, carry: Column | None = None, whole: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_text, row) of all documents, `row` being the column to carry.

    `kept_text` has the kept words, joined by one space; if `whole`, the text as it is where nothing goes."""
    blocks, n = in_blocks(docs, carry=carry)

    def keys_of(texts: list[bytes | None]) -> list[np.ndarray]:
        cache: dict[bytes, int] = {}
        return [window_hashes(word_hashes(words_of(t), cache), size) for t in texts]

    def use(rows, texts, keys, counts) -> pa.Table:
        coded = numbered(texts)
        found = {tuple(c[a:b]) for c, k in zip(coded, counts) for a, b in passages(k >= 2, size)}
        masks = locate(coded, found)
        kept = []
        for t, m in zip(texts, masks):
            if m.any():
                kept.append(b" ".join([w for w, gone in zip(words_of(t), m) if not gone]).decode())
            elif whole:
                kept.append(None if t is None else t.decode())
            else:
                kept.append(b" ".join(words_of(t)).decode())
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array([len(c) for c in coded], pa.int64()), "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()), "kept_text": pa.array(kept, pa.string()), "row": rows.column("row")})

    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_text string").add("row", blocks.schema["row"].dataType)
    return counted(blocks, n, keys_of, use, schema)


def without_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """`docs` with the covered words gone; texts that lose nothing stay as they are, n_chars (if there) is counted anew.

    The other columns travel in a struct, so their names clash with nothing."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = mark_repeats(docs, size, F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else None, whole=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text")}
    return rows.select(*(new.get(c, F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 34), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d)
), r AS (SELECT doc_id, s FROM x WHERE g IN (SELECT g FROM x GROUP BY g HAVING count(*) > 1)
), c AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(range(s, s + 35)) AS pos FROM r) GROUP BY doc_id
), e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n_kept FROM e LEFT JOIN c USING (doc_id) WHERE gone IS NULL OR NOT list_contains(gone, pos) GROUP BY e.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
