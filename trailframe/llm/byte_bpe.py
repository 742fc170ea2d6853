"""Byte-level BPE encoding and decoding with Spark higher-order functions.

A piece (a match of the splitting pattern) becomes an array of its bytes; a fold merges the leftmost pair of the
lowest rank until no pair has one. Ranks of pairs of ids and the binary pieces of ids are literals of bounded size
(hash tables in arrays, so that a lookup takes constant time). Distinct pieces are counted over all texts; the
frequent ones are folded once, in a table of bounded size that is sent to the tasks, where Arrow batches of pieces are
looked up in it. Pieces that aren't there are folded where they stand. Nothing is shuffled but the counts of distinct
pieces. Decoding concatenates the ids' binary pieces.

Only one pair of ids can make a given piece: inside a longer text the bytes of a piece that will be one merge as
they do alone, so the last merge is always that of the piece by itself. Likewise a row of ids is what the merges give
as soon as each two neighbours are, so a long piece is folded in overlapping chunks, each of which starts where an id
of the chunk before starts, and joined at an id that both have.

Edge cases: null and empty texts have no ids, and the digests of empty strings; a null doc_id stays null;
repeated rows are encoded each; an empty table gives no rows; other columns are ignored; a piece may be as long
as its text, in time that grows with its length (chunks that share no id, which was never seen, would take its
square, and raise beyond 8 MB).
"""

from __future__ import annotations

import base64

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from trailframe.llm.common import map_texts, stored, table

#: Parameters: frequent pieces that are folded once at most (and bytes of each), pieces that a task looks up at a time,
#: bytes that two chunks of a long piece share at least.
FREQUENT, PIECE_BYTES, AT_ONCE, OVERLAP = 1_000_000, 32, 1_000_000, 64
#: Parameter: pieces (or ids) that are joined at a time. Unlike a look-up, which goes through all known pieces, joining costs no more in small parts.
JOINED = 200_000
#: Ids and ranks have 20 bits, the last of which means none; a place has 23; a free slot is larger than any entry.
_NO_RANK = _PART = 2**20 - 1
_PLACES, _FREE = 2**23, 2**62
#: The longest piece whose places fit the bits of a long.
SHORT = 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def literal(spark: SparkSession, values: pa.Array) -> Column:
    """A large constant array, once in a plan: a scalar subquery over a row of its own.

    The analyzer takes none inside a higher-order function, so it is selected as a column below, which the
    optimizer merges into the one place that uses it; no row ever holds it."""
    return spark.createDataFrame(pa.table({"x": pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)})).scalar()


def latin(text: Column) -> Column:
    """A string with one character for each UTF-8 byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _let(value: Column, body) -> Column:
    """`body` with a value computed once: the fold of no elements, which copies nothing (a transform copies its results)."""
    return F.aggregate(F.array(), value, lambda acc, _: acc, body)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def last_merges(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left, right, merged): the ids of the pair that the merges of each piece end with, alone or in a longer text."""
    out = []
    for piece, i in ranks.items():
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 2:
            rank, k = min((ranks.get(x + y, _NO_RANK), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == _NO_RANK:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2:
            out.append((ranks[parts[0]], ranks[parts[1]], i))
    return out


class MergeTable:
    """The merges as a perfect hash table: left << 40 | right << 20 | merged id in slots, and the shifts of its buckets.

    A key's bucket are the bits of its hash from 40 on, its place other bits of the hash and the bucket's shift together."""

    def __init__(self, spark: SparkSession, merges: list[tuple[int, int, int]]):
        keys = np.array([left << 20 | right for left, right, _ in merges], np.int64)
        hashes = np.array([xxhash.xxh64_intdigest(int(k).to_bytes(8, "little"), seed=42) for k in keys], np.uint64)
        self.size, self.buckets = 1 << (2 * len(keys) + 1).bit_length(), 1 << max(1, len(keys) // 3).bit_length()
        at_bucket = (hashes >> np.uint64(40)).astype(np.int64) & (self.buckets - 1)
        for self.low in range(24):  # bits that tell the keys of each bucket apart
            at = (hashes >> np.uint64(self.low)).astype(np.int64) & (self.size - 1)
            if len(np.unique(at_bucket * self.size + at)) == len(keys):
                break
        else:
            raise ValueError("no bits of the hashes tell the merges apart")
        slots, shifts, free = np.full(self.size, _FREE, np.int64), np.zeros(self.buckets, np.int32), np.ones(self.size, bool)
        order, ends = np.argsort(at_bucket, kind="stable"), np.searchsorted(np.sort(at_bucket), np.arange(self.buckets + 1))
        for b in np.argsort(-np.diff(ends), kind="stable"):
            members = order[ends[b] : ends[b + 1]]
            for shift in range(self.size):
                places = (at[members] + shift) & (self.size - 1)
                if free[places].all():
                    break
            else:
                raise ValueError("no place for the merges of a bucket")
            free[places], shifts[b] = False, shift
            slots[places] = keys[members] << 20 | np.array([merges[m][2] for m in members], np.int64)
        self.slots, self.shifts = literal(spark, pa.array(slots, pa.int64())), literal(spark, pa.array(shifts, pa.int32()))

    def merged(self, m: Column, left: Column, right: Column) -> Column:
        """The id that a pair merges into, which is its rank too; _NO_RANK if none. The exclusive or leaves the id alone where an entry is the pair's."""
        pair = F.shiftleft(left, 20).bitwiseOR(right)
        mask = lambda x, n: x.bitwiseAND(_long(n - 1)).cast("int")
        place = lambda h: mask(F.shiftrightunsigned(h, self.low) + F.get(m["_shifts"], mask(F.shiftrightunsigned(h, 40), self.buckets)), self.size)
        return _let(F.xxhash64(pair), lambda h: F.least(F.get(m["_slots"], place(h)).bitwiseXOR(F.shiftleft(pair, 20)), _long(_NO_RANK)))


def byte_pairs(ranks: dict[bytes, int], merges: list[tuple[int, int, int]]) -> list[int]:
    """For a byte and the one after it (256: none), at byte * 257 + next: rank of the pair << 43 | id of the byte."""
    one, merged = [ranks[bytes([b])] for b in range(256)], {(x, y): i for x, y, i in merges}
    return [merged.get((x, y), _NO_RANK) << 43 | x for x in one for y in [*one, -1]]


def _parts(piece: Column, m: Column) -> Column:
    """A fold's first state, one array: for each part, rank of the pair that it begins << 43 | its first byte's place << 20
    | id. Its minimum is the leftmost pair of the lowest rank. An end mark on either side pairs with nothing."""
    end = F.array(_long(_NO_RANK << 43 | _PART))
    return _let(F.transform(F.split(piece, ""), F.ascii), lambda codes: F.concat(end, F.transform(codes, lambda c, i: F.get(
        m["_pairs"], c * 257 + F.coalesce(F.get(codes, i + 1), F.lit(256))).bitwiseOR(F.shiftleft(i.cast("long"), 20))), end))


def _joined(parts: Column, e: Column, k: Column, m: Column, table: MergeTable) -> Column:
    """`parts` with part e at k (from 1) and the next as one, and the ranks beside it anew."""
    part = lambda x: x.bitwiseAND(_long(_PART))
    rank = lambda a, b: F.shiftleft(table.merged(m, a, b), 43)
    one = lambda q: F.array(
        rank(part(q["before"]), q["id"]).bitwiseOR(q["before"].bitwiseAND(_long((1 << 43) - 1))),
        rank(q["id"], q["after"]).bitwiseOR(e.bitwiseAND(_long((1 << 43) - 1 - _PART))).bitwiseOR(q["id"]))
    near = F.struct(F.get(parts, k - 2).alias("before"), part(F.get(parts, k + 1)).alias("after"), F.shiftright(e, 43).alias("id"))
    return F.flatten(F.array(F.slice(parts, F.lit(1), k - 2), _let(near, one), F.slice(parts, k + 2, F.lit(2**30))))


def _places(parts: Column) -> Column:
    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 2), lambda e: e.bitwiseAND(_long((1 << 43) - 1)))


def _steps(piece: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.char_length(piece) - 1, F.lit(1)))


def fold_merges(piece: Column, m: Column, table: MergeTable) -> Column:
    """The parts of one piece, given with one character for each byte: place of the first byte << 20 | id."""
    def step(acc: Column, _: Column) -> Column:
        return _let(F.array_min(acc), lambda e: F.when(e >= _long(_NO_RANK << 43), acc).otherwise(
            _let(F.array_position(acc, e).cast("int"), lambda k: _joined(acc, e, k, m, table))))

    return F.aggregate(_steps(piece), _parts(piece, m), step, _places)


def fold_short(piece: Column, m: Column, table: MergeTable) -> Column:
    """As fold_merges, of at most SHORT bytes: one bit for each place where a part begins tells where in the array a part is."""
    place = lambda e: F.shiftright(e, 20).bitwiseAND(_long(_PLACES - 1)).cast("int")
    bit = lambda n: F.call_function("shiftleft", _long(1), n)

    def merged(acc: Column, e: Column) -> Column:
        parts, starts = acc["parts"], acc["starts"]
        return _let(F.bit_count(starts.bitwiseAND(bit(place(e)) - 1)) + 2, lambda k: F.struct(
            _joined(parts, e, k, m, table).alias("parts"), starts.bitwiseXOR(bit(place(F.get(parts, k)))).alias("starts")))

    def step(acc: Column, _: Column) -> Column:
        return _let(F.array_min(acc["parts"]), lambda e: F.when(e >= _long(_NO_RANK << 43), acc).otherwise(merged(acc, e)))

    start = F.struct(_parts(piece, m).alias("parts"), (bit(F.char_length(piece)) - 1).alias("starts"))
    return F.aggregate(_steps(piece), start, step, lambda acc: _places(acc["parts"]))


def fold_chunks(piece: Column, fold, overlap: int) -> Column:
    """As fold_merges, of a long piece (binary): `fold` in chunks of four times `overlap`, which no id may be longer
    than. Null if two chunks share no id.

    State: the next chunk's start, the parts of the last chunk from there on, the parts before."""
    size, n = 4 * overlap, F.octet_length(piece)
    place = lambda e: F.shiftright(e, 20).cast("int")
    longs = lambda x: x.cast("array<bigint>")
    state = lambda at, tail, done: F.struct(at.alias("at"), longs(tail).alias("tail"), done.cast("array<array<bigint>>").alias("done"))

    def joined(acc: Column, found: Column) -> Column:
        """From the first id that the tail has too, or from the start of the piece, on; the last chunk gives all it has."""
        shared = F.when(acc["at"] == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect(acc["tail"], found)))
        last = acc["at"] + size >= n
        stop = F.when(last, n).otherwise(place(F.array_max(F.filter(found, lambda e: place(e) <= acc["at"] + size - overlap))))
        return _let(F.struct(shared.alias("shared"), stop.alias("stop")), lambda c: F.when(c["shared"].isNull(), state(n, F.array(), F.lit(None))).otherwise(state(
            c["stop"], F.filter(found, lambda e: place(e) >= c["stop"]),
            F.concat(acc["done"], F.array(F.filter(acc["tail"], lambda e: e < c["shared"]), F.filter(found, lambda e: (e >= c["shared"]) & (place(e) < c["stop"])))))))

    def step(acc: Column, _: Column) -> Column:
        chunk = F.decode(F.substring(piece, acc["at"] + 1, F.lit(size)), "ISO-8859-1")
        return F.when(acc["at"] >= n, acc).otherwise(_let(F.transform(fold(chunk), lambda e: e + F.shiftleft(acc["at"].cast("long"), 20)), lambda found: joined(acc, found)))

    return F.aggregate(F.sequence(F.lit(0), (n / overlap).cast("int")), state(F.lit(0), F.array(), F.array()), step, lambda acc: F.flatten(acc["done"]))


def _offsets(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums; an Arrow batch has fewer than 2 ** 31 elements."""
    out = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=out[1:])
    return out


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _some_rows(batch: pa.RecordBatch, lists: str, some: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose lists together have about `some` elements, or one row that has more."""
    ends, at = np.cumsum(_lengths(batch.column(lists))), 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + some, "right")))
        yield batch.slice(at, end - at)
        at = end


def look_up(pieces: pa.Array, known: pa.Array) -> tuple[pa.Array, pa.Array]:
    """For lists of pieces, the numbers of those that are known, -1 - k for the k-th of a list that isn't, and lists of these."""
    ends, flat = _offsets(_lengths(pieces)), pieces.flatten()
    if not len(flat):
        return _lists(ends, pa.array([], pa.int32())), _lists(ends, flat)
    distinct = flat.dictionary_encode()
    # Known pieces are looked up in a table of the pieces here: one of all known ones would take several times their memory.
    at = pc.index_in(known, value_set=distinct.dictionary)
    found = np.full(len(distinct.dictionary), -1, np.int32)
    found[_numbers(at.drop_null())] = np.flatnonzero(_numbers(at.is_valid()))
    codes = found[_numbers(distinct.indices)]
    missing = codes < 0
    before = _offsets(missing)
    codes[missing] = (np.repeat(before[ends[:-1]], np.diff(ends))[missing] - before[:-1][missing]) - 1
    return _lists(ends, pa.array(codes)), _lists(before[ends], flat.filter(pa.array(missing)))


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of `values` that begin at `starts`, one after another."""
    out = _offsets(lengths)
    return values[np.arange(out[-1], dtype=np.int32) + np.repeat(starts - out[:-1], lengths)]


def put_together(codes: pa.Array, folded: pa.Array, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of lists and the ids in them, from lists of pieces: known ones by number, as stretches of `values` between `starts`, the
    others as the lists of what they were folded into."""
    ends, number, own = _offsets(_lengths(codes)), _numbers(codes.flatten()), folded.flatten()
    first, own_lengths = _offsets(_lengths(folded)), _lengths(own)
    missing = number < 0
    lengths, there = np.empty(len(number), np.int32), number[~missing]
    lengths[~missing] = starts[there + 1] - starts[there]
    place = (np.repeat(first[:-1], np.diff(ends))[missing] - 1 - number[missing]) if len(own) else np.zeros(0, np.int32)
    lengths[missing] = own_lengths[place]
    out = _offsets(lengths)
    ids = np.empty(out[-1], np.int32)
    rest = np.repeat(missing, lengths)
    ids[~rest] = _gathered(values, starts[there], lengths[~missing])
    ids[rest] = _gathered(_numbers(own.flatten()), _offsets(own_lengths)[place], own_lengths[place])
    return out[ends], ids


def joined_pieces(offsets: np.ndarray, ids: np.ndarray, pieces: pa.Array) -> pa.Array:
    """For each stretch of ids their binary pieces, one after another: those of all ids lie so in memory already."""
    every = pieces.take(pa.array(ids, pa.int32()))
    _, at, data = every.buffers()
    ends = np.frombuffer(at, np.int32, len(ids) + 1, every.offset * 4)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].tobytes()), data])


class ByteBpe:
    """Encoder and decoder for one rank file and splitting pattern; `fit` folds the frequent pieces of a table."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.spark, self.pattern = spark, f"(?U){pattern}"  # white space and classes as in Unicode
        self.ids = read_ranks(path)
        if max(self.ids.values()) >= _PART:
            raise ValueError(f"ids up to {_PART - 1} only")
        merges = last_merges(self.ids)
        self.merges = MergeTable(spark, merges)
        self.overlap = max(OVERLAP, max(map(len, self.ids)))
        self.pairs = literal(spark, pa.array(byte_pairs(self.ids, merges), pa.int64()))
        pieces = {i: b for b, i in self.ids.items()}
        self.pieces = pa.array([pieces.get(i, b"") for i in range(max(pieces) + 1)], pa.binary())
        self.known, self.known_ids = spark.sparkContext.broadcast(pa.array([], pa.string())), spark.sparkContext.broadcast((np.zeros(0, np.int32), np.zeros(1, np.int32)))

    def split(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def frequent(self, docs: DataFrame, n: int = FREQUENT) -> DataFrame:
        """The pieces that occur most often, at most n: all of those above a power of two that leaves so many, and a share of the next."""
        counts = docs.select(F.explode(self.split(F.col("text"))).alias("piece")).groupBy("piece").count()
        counts = counts.where((F.col("count") > 1) & (F.octet_length("piece") <= PIECE_BYTES)).withColumn("power", F.floor(F.log2("count")))
        counts = stored(counts)
        least, left = 64, n
        for power, k in sorted(counts.groupBy("power").agg(F.count("*").alias("k")).collect(), reverse=True):  # a row for each power of two
            if k > left:
                break
            least, left = power, left - k
        # Of the next power, the share by hash that still has room.
        share = next((left / r["k"] for r in counts.where(F.col("power") == least - 1).groupBy().agg(F.count("*").alias("k")).collect() if r["k"]), 0.0)
        at = F.pmod(F.xxhash64("piece"), F.lit(2**20))
        return counts.where((F.col("power") >= least) | ((F.col("power") == least - 1) & (at < 0.98 * share * 2**20))).select("piece")

    def fit(self, docs: DataFrame, n: int = FREQUENT) -> ByteBpe:
        some = self.frequent(docs, n).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "piece")
        folded = some.select("piece", *self._tables()).select("piece", self._with_tables(lambda m: self._fold(F.col("piece"), m)).alias("ids")).toArrow()
        piece, ids = folded.column("piece").combine_chunks(), folded.column("ids").combine_chunks()
        # At most `n` pieces of PIECE_BYTES; those who look up need no ids, those who join no pieces.
        self.known = self.spark.sparkContext.broadcast(piece.cast(pa.string()))
        self.known_ids = self.spark.sparkContext.broadcast((_numbers(ids.flatten()).astype(np.int32), _offsets(_lengths(ids))))
        return self

    def _tables(self) -> list[Column]:
        return [t.alias(c) for t, c in ((self.merges.slots, "_slots"), (self.merges.shifts, "_shifts"), (self.pairs, "_pairs"))]

    def _with_tables(self, body) -> Column:
        return _let(F.struct("_slots", "_shifts", "_pairs"), body)

    def _fold(self, piece: Column, m: Column) -> Column:
        fold = lambda x: fold_merges(x, m, self.merges)
        small = F.octet_length(piece) < _PLACES
        raw = F.encode(piece, "UTF-8")
        parts = F.when(F.octet_length(piece) <= SHORT, fold_short(latin(piece), m, self.merges)).when(F.octet_length(piece) <= 4 * self.overlap, fold(latin(piece))).otherwise(
            F.coalesce(fold_chunks(raw, fold, self.overlap), F.when(small, fold(latin(piece))).otherwise(F.raise_error(F.lit("a piece of over 8 MB whose chunks share no id")))))
        return F.transform(parts, lambda e: e.bitwiseAND(F.lit(_PART).cast("long")).cast("int"))

    def encode(self, docs: DataFrame, text: str, ids: str, decoded: str | None = None) -> DataFrame:
        """`docs` with the ids of column `text` in place of it, as column `ids`; and with what these decode to, if `decoded` names a column for it."""
        rest, known, known_ids, pieces = [c for c in docs.columns if c != text], self.known, self.known_ids, self.pieces
        rows = docs.select((F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None).cast("boolean")).alias("row"), self.split(F.col(text)).alias("pieces"))
        row, whole = rows.schema["row"].dataType, ArrayType(IntegerType(), False)

        def find():
            pa.set_memory_pool(pa.system_memory_pool())  # gives memory back

            def each(batch):
                for x in _some_rows(batch, "pieces"):
                    codes, unknown = look_up(x.column("pieces"), known.value)
                    yield {"row": x.column("row"), "codes": codes, "unknown": unknown}

            return each

        def join():
            pa.set_memory_pool(pa.system_memory_pool())

            def each(batch):
                for x in _some_rows(batch, "codes", JOINED):
                    offsets, numbers = put_together(x.column("codes"), x.column("folded"), *known_ids.value)
                    yield {"row": x.column("row"), "ids": _lists(offsets, pa.array(numbers)), "decoded": joined_pieces(offsets, numbers, pieces) if decoded else pa.nulls(len(x), pa.binary())}

            return each

        coded = map_texts(rows, find, StructType().add("row", row).add("codes", whole).add("unknown", ArrayType(StringType(), False)))
        folded = self._with_tables(lambda m: F.transform("unknown", lambda p: self._fold(p, m)))
        coded = coded.select("row", "codes", "unknown", *self._tables()).select("row", "codes", folded.alias("folded"))
        out = map_texts(coded, join, StructType().add("row", row).add("ids", whole).add("decoded", BinaryType()))
        return out.select(*(F.col("row").getField(c).alias(c) for c in rest), F.col("ids").alias(ids), *([F.col("decoded").alias(decoded)] if decoded else []))

    def decode(self, docs: DataFrame, ids: str, out: str) -> DataFrame:
        """Adds the binary pieces of the ids, one after another, as column `out`."""
        pieces = self.pieces
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(ids), F.array()).cast("array<int>").alias("ids"))

        def join():
            def each(batch):
                for x in _some_rows(batch, "ids", JOINED):
                    yield {"row": x.column("row"), "decoded": joined_pieces(_offsets(_lengths(x.column("ids"))), _numbers(x.column("ids").flatten()), pieces)}

            return each

        done = map_texts(rows, join, StructType().add("row", rows.schema["row"].dataType).add("decoded", BinaryType()))
        return done.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("decoded").alias(out))


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes decoded from them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bpe = ByteBpe(docs.sparkSession, path, pattern).fit(rows)
    return bpe.encode(rows, "text", "ids", "decoded")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
