"""Whole texts as flat byte buffers, in pieces of bounded size, for the operators that work in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.shipping import ship

#: Rows of a table that are worked on at once; their texts go in slices of SLICE bytes.
BATCH_ROWS = 256
SLICE = 1 << 20
#: Bytes that Python gets at once, or one longer row.
BATCH_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def encode(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(blobs: list[bytes], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive runs [a, b) of blobs with at most ``limit`` bytes together, or one longer blob alone."""
    a, size = 0, 0
    for b, blob in enumerate(blobs):
        if b > a and size + len(blob) > limit:
            yield a, b
            a, size = b, 0
        size += len(blob)
    if a < len(blobs):
        yield a, len(blobs)


def joined(blobs: list[bytes], gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The blobs in one uint8 array, each followed by ``gap`` bytes 0xFF (in no UTF-8 text), and where each starts; a last entry is the end."""
    ends = np.cumsum([0, *(len(b) + gap for b in blobs)], dtype=np.int64)
    return np.frombuffer((b"\xff" * gap).join([*blobs, b""]) if gap else b"".join(blobs), dtype=np.uint8), ends


def ready(df: DataFrame) -> None:
    """Python workers have the package and get BATCH_BYTES at once, however many rows these are.

    Spark's own limit of 64 MB is too much beside several tasks on small executors.  It is the session's, so other plans
    have it, too; rows of numbers stay under it.
    """
    ship(df.sparkSession)
    spark, limit = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit)) <= BATCH_BYTES:
        spark.conf.set(limit, BATCH_BYTES)


def sliced(batches: Iterator) -> Iterator:
    """Arrow batches, which Spark limits in bytes, as slices of BATCH_ROWS rows, without copies."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def give_back() -> None:
    """What a task has freed goes back to the machine: the worker lives on, and others need the memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def by_batch(df: DataFrame, columns: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on every BATCH_ROWS rows of these columns of ``df``; integers with nulls among them come as objects."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for c in sliced(batches):
            if len(made := work(c.to_pandas(integer_object_nulls=True))):  # columns without values have no type that Arrow could take for text
                yield pa.RecordBatch.from_pandas(made, schema=kinds, preserve_index=False)
        give_back()

    ready(df)
    return df.select(*columns).mapInArrow(run, schema)


def append(df: DataFrame, inputs: list[str], work: Callable[..., list[list]], fields: list[tuple[str, str]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with new columns that Python makes from the columns ``inputs``; the others pass through as Arrow, untouched.

    ``work`` gets a list per input column and returns a list per field (name, type); the names must be new ones.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    made = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields]
    rest = [c for c in df.columns if c not in drop]
    places, left = [df.columns.index(c) for c in inputs], [df.columns.index(c) for c in rest]
    schema = T.StructType([*(df.schema[k] for k in left), *made])
    kinds = [to_arrow_type(f.dataType) for f in made]
    names = schema.names

    def run(batches):
        for c in sliced(batches):
            got = work(*(c.column(k).to_pylist() for k in places))
            arrays = [pa.array(v, type=kind) for v, kind in zip(got, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.column(k) for k in left), *arrays], names=names)
        give_back()

    ready(df)
    return df.mapInArrow(run, schema)
