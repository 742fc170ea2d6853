"""What several of the operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailframe.operators.components import shared_folder

#: Parameters: rows and bytes (as JSON) up to which a table is taken to be small enough for a broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def stored(df: DataFrame) -> DataFrame:
    """A table computed once and kept in the shared folder, so that lost executors lose nothing of it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows of BROADCAST_BYTES in all; beyond that Spark shuffles it like any table."""
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


def binary_list(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: exactly what bytes.split() takes as words."""
    return text.split() if text else []


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system; workers live on between tasks, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(df: DataFrame, make, schema: str | StructType) -> DataFrame:
    """mapInArrow over batches; what `make()` gives takes a batch and returns a dict of columns, or several, one for each part of the
    batch. State that `make` keeps lives as long as a task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            parts = each(batch)
            for columns in [parts] if isinstance(parts, dict) else parts:
                give_back()
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip((columns[f.name] for f in arrow), arrow)], schema=arrow)
        each = batch = parts = columns = None  # what the task's last batch took goes back before the worker waits for another task
        give_back()

    return df.mapInArrow(run, schema)
