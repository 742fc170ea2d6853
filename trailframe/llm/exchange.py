"""Counting keys of all documents without shuffling a row for each.

Documents are dealt into blocks by hash. A block sends its distinct 64-bit keys, sorted and packed, to shards of
the key space: one row for each block and shard. A shard adds up the counts of its keys over all blocks and sends
each block its counts back, a byte for each key. A block then reads its documents again beside the counts. Copies
of a document are spread over the blocks, and a key that all documents hold is one entry in each block, so that
no key or group makes a task large. Blocks have a fixed size; blocks and shards grow in number with the input.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailframe.llm.common import binary_list, give_back, map_texts

#: Parameters: bytes of text in a block, on average, at first and at most; bytes of text from which blocks grow.
BLOCK_BYTES, MOST_BLOCK_BYTES, GROWS_FROM = 4_000_000, 32_000_000, 1_000_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that part words, masks of the first bytes of eight, bytes of a word up to which it is hashed in arrays.
_SPACE, _FIRST, _SHORT = np.isin(np.arange(256), list(b"\t\n\v\f\r ")), np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64), 64


def word_hashes(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the words; `cache` belongs to a task and is emptied when it is large."""
    if len(cache) > 500_000:
        cache.clear()
    get, digest = cache.get, xxhash.xxh64_intdigest
    return np.fromiter(((get(w) or cache.setdefault(w, digest(w) | 1)) for w in words), np.uint64, len(words))


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after another, and how many words there are up to the end of each text.

    Eight bytes of all words are taken at once; words of more than `_SHORT` bytes are hashed each."""
    data = b" " + b" ".join(texts) + b" " * 8
    inside = ~_SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place
    out, at, left, rest = sizes.astype(np.uint64) * _MIX, starts, sizes, slice(None)
    for _ in range(_SHORT // 8):
        out[rest] = _stir(out[rest] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        rest, at, left = more if isinstance(rest, slice) else rest[more], at[more] + 8, left[more] - 8
        if not len(more):
            break
    for i in np.flatnonzero(sizes > _SHORT):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return out, np.searchsorted(starts, 1 + np.cumsum([len(t) + 1 for t in texts]))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` consecutive words, from the words' hashes."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - size + 1].copy()
        for i in range(1, size) if size <= 8 else ():
            out = (out * _MIX) ^ h[i : len(h) - size + 1 + i]
            out ^= out >> np.uint64(29)
        if size > 8:  # a polynomial in an odd number, over sums of all words before
            powers = np.cumprod(np.full(len(h) + 1, _MIX, np.uint64))
            inverse = np.cumprod(np.full(len(h) + 1, pow(int(_MIX), -1, 2**64), np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)], dtype=np.uint64)])
            out = (sums[size:] - sums[:-size]) * inverse[: len(out)]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(28))


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, by planes of bytes: the upper planes are nearly empty and compress away."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def block_size(total: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Bytes of text in a block of so much text."""
    return max(block_bytes, min(MOST_BLOCK_BYTES, int(block_bytes * (total / GROWS_FROM) ** 0.5)))


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, carry: Column | None = None) -> tuple[DataFrame, int]:
    """Rows (block, doc_id, body: the text's bytes compressed, null if it is, row: a column to carry), and the number of blocks.

    Rows of different ids or texts are dealt apart, so neither null ids nor an id of many rows make a block large."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(None).cast("boolean") if carry is None else carry).alias("row"))
    total = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = 1 + total // block_size(total, block_bytes)

    def make():
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return lambda batch: {"body": [None if t is None else squeeze(t) for t in binary_list(batch.column("text"))]} | {c: batch.column(c) for c in ("block", "doc_id", "row")}

    schema = StructType.fromDDL("block int, doc_id long, body binary").add("row", rows.schema["row"].dataType)
    return map_texts(rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), "doc_id", "text", "row"), make, schema), n


def bodies(column: pa.ChunkedArray) -> list[bytes | None]:
    expand = zstandard.ZstdDecompressor().decompress
    return [None if x is None else expand(x) for x in column.to_pylist()]


def counted(blocks: DataFrame, shards: int, keys_of: Callable[[list[bytes | None]], list[np.ndarray]], use: Callable, schema: str | StructType, bits: int = 64) -> DataFrame:
    """For every block, `use(rows, texts, keys, counts)` as a pa.Table of `schema`; `rows` is the block's table.

    `keys_of(texts)` gives an array of keys for each text; `counts` are arrays alike, how often each key occurs in
    all blocks, up to 255. Of keys only the upper `bits` (32 at least) are sent: keys alike in them are counted as
    one, so that with fewer than 64 a count may be too large, but never too small."""

    def sent_keys(each: list[np.ndarray]) -> np.ndarray:
        return (np.concatenate(each) if each else np.zeros(0, np.uint64)) >> np.uint64(64 - bits)

    def send(group: pa.Table) -> pa.Table:
        keys, counts = np.unique(sent_keys(keys_of(bodies(group.column("body")))), return_counts=True)
        at = np.searchsorted(((keys >> np.uint64(bits - 32)) * np.uint64(shards)) >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))
        counts = np.minimum(counts, 255).astype(np.uint8)
        full = np.flatnonzero(np.diff(at))
        block = group.column("block")[0].as_py()
        return pa.table({
            "shard": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32()),
            "keys": pa.array([pack(keys[at[s] : at[s + 1]]) for s in full], pa.binary()), "counts": pa.array([counts[at[s] : at[s + 1]].tobytes() for s in full], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        keys = [unpack(x) for x in group.column("keys").to_pylist()]
        own = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("counts").to_pylist()])
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.minimum(np.bincount(where, weights=own), 255).astype(np.uint8)[where]
        ends = np.cumsum([len(k) for k in keys])
        return pa.table({"shard": group.column("shard"), "block": group.column("block"), "counts": pa.array([total[e - len(k) : e].tobytes() for k, e in zip(keys, ends)], pa.binary())})

    def back(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = bodies(docs.column("body"))
        each = keys_of(texts)
        order = np.argsort(answers.column("shard").to_numpy()) if len(answers) else []
        replies = answers.column("counts").to_pylist() if len(answers) else []
        counts = np.frombuffer(b"".join(replies[i] for i in order), np.uint8)
        _, where = np.unique(sent_keys(each), return_inverse=True)
        cuts = np.cumsum([len(k) for k in each])[:-1]
        counts, where = counts[where], None  # places take eight times the counts
        give_back()
        return use(docs, texts, each, np.split(counts, cuts) if each else [])

    def frugal(work):
        def run(*groups: pa.Table) -> pa.Table:
            give_back()
            out = work(*groups)
            give_back()
            return out

        return (lambda a: run(a)) if work is not back else (lambda a, b: run(a, b))

    sent = blocks.groupBy("block").applyInArrow(frugal(send), "shard int, block int, keys binary, counts binary")
    answers = sent.groupBy("shard").applyInArrow(frugal(add), "shard int, block int, counts binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(frugal(back), schema)
