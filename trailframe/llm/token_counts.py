"""Token counts by a map-side two-tier lookup.

A pre-token of the tokenizer must not cross ASCII white space (one that does is refused when it is loaded), so a text's count is the sum over its white-space-separated
chunks. Tier 1: the counts of the most frequent chunks, found by merging a summary of bounded size from every task
(no pre-token is shuffled), broadcast as one compact table of bounded size. Tier 2: chunks that it misses are
encoded once by the library and kept in a cache of bounded size in the worker. Both tiers give the library's
own figures; the bounds change speed only.

Edge cases: null and empty texts have 0 tokens; null doc_id stays null; a chunk of any length is encoded whole;
repeated rows are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm.common import binary_list, map_texts, stored, table, words_of

#: Parameters: chunks in the broadcast table and bytes of each at most (so 4 MB at most), chunks that a task reports or
#: remembers while it counts, chunks in a worker's cache, tokens over which a document is too long.
FREQUENT, CHUNK_BYTES, REPORTED, COUNTED, CACHED, LIMIT = 50_000, 64, 20_000, 500_000, 300_000, 2048
#: Parameter: summaries that are merged into one.
FAN_IN = 16

_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, made once in each worker."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        probe = "Two words\tand\n\u00e9\u0301 more  , 12'll"
        if len(_TOKENIZERS[path].encode(probe, add_special_tokens=False).ids) != sum(len(_TOKENIZERS[path].encode(c, add_special_tokens=False).ids) for c in probe.split()):
            raise ValueError("this tokenizer's pre-tokens cross white space")
        _TOKENIZERS[path].no_truncation()
        _TOKENIZERS[path].no_padding()
    return _TOKENIZERS[path]


def lengths(path: str, chunks: Iterable[bytes]) -> list[int]:
    """One after another: the library's batches use threads of their own beside Spark's tasks, which take twice the CPU time for a text's few chunks."""
    encode = tokenizer(path).encode
    return [len(encode(c.decode(), add_special_tokens=False)) for c in chunks]


def _merged(summaries: list[tuple[list[bytes], np.ndarray]], keep: int) -> tuple[list[bytes], np.ndarray]:
    """The `keep` most frequent chunks of some summaries together."""
    total: Counter[bytes] = Counter()
    for chunks, counts in summaries:
        for c, n in zip(chunks, counts.tolist()):
            total[c] += n
    top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:keep]
    return [c for c, _ in top], np.array([n for _, n in top], np.int64)


def _row(part: int, chunks: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([b"\n".join(chunks)], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["part", "chunks", "counts"])


def frequent_chunks(docs: DataFrame, n: int = FREQUENT) -> list[bytes]:
    """About the n most frequent chunks of all texts.

    Every task sums up what it sees in one row of bounded size; FAN_IN of these are merged into one of the same size,
    round by round, until one is left, which alone reaches the driver. No pre-token is a row of a shuffle."""
    schema = "part int, chunks binary, counts binary"

    def see(batches):
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in binary_list(batch.column(0)):
                seen.update(words_of(text))
                if len(seen) > COUNTED:  # what is rare so far goes; this affects speed, not counts of tokens
                    seen = Counter(dict(seen.most_common(COUNTED // 4)))
        top = [(c, k) for c, k in seen.most_common(REPORTED) if k > 1 and len(c) <= CHUNK_BYTES]
        yield _row(TaskContext.get().partitionId(), [c for c, _ in top], np.array([k for _, k in top], np.int64))

    def merge(group: pa.Table) -> pa.Table:
        rows = zip(group.column("chunks").to_pylist(), group.column("counts").to_pylist())
        chunks, counts = _merged([(c.split(b"\n") if c else [], np.frombuffer(k, np.int64)) for c, k in rows], n)
        return pa.Table.from_batches([_row(group.column("part")[0].as_py() // FAN_IN, chunks, counts)])

    rows = stored(docs.select("text").mapInArrow(see, schema))
    left = rows.agg(F.max("part")).first()[0]
    while left:  # numbers of parts above 0
        rows = rows.groupBy(F.floor(F.col("part") / FAN_IN).cast("int").alias("to")).applyInArrow(merge, schema)
        left //= FAN_IN
    row = rows.first()
    return bytes(row.chunks).split(b"\n") if row and row.chunks else []


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to doc_id."""
    keys = frequent_chunks(docs)
    compact = docs.sparkSession.sparkContext.broadcast(dict(zip(keys, lengths(path, keys))))

    def make():
        tier1 = compact.value
        known = dict(tier1)

        def each(batch: pa.RecordBatch) -> dict:
            nonlocal known
            n_bytes, n_tokens = [], []
            for text in binary_list(batch.column("text")):
                chunks = words_of(text)
                counts = list(map(known.get, chunks))
                if None in counts:
                    missing = {c for c, n in zip(chunks, counts) if n is None}
                    if len(known) + len(missing) > FREQUENT + CACHED:
                        known = dict(tier1)
                        missing = {c for c in chunks if c not in known}
                    known.update(zip(missing, lengths(path, missing)))
                    counts = map(known.__getitem__, chunks)
                n_bytes.append(len(text or b""))
                n_tokens.append(sum(counts))
            return {"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens]}

        return each

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
