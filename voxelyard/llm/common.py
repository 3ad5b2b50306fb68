"""Shared pieces of the training-data operators: scratch tables and Arrow text access.

Scratch tables live in the folder named by ``spark.checkpoint.dir`` so that every executor sees
them and a lost executor costs only its running tasks.  They are plain Parquet, written once by
Spark's own commit protocol, which also cuts the lineage of whatever produced them.
"""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import table  # noqa: F401

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that numpy code expands at once (a single longer text is taken alone).
SLICE_BYTES = 1 << 21

_scratch: list[str] = []
_own_dir: str | None = None
_serial = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one of our own only where none is set (tests)."""
    global _own_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="voxelyard-shared-")
    return _own_dir


def materialize(df: DataFrame, name: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder, in a folder a value of ``by`` where given, and returns the
    table that was written; ``release`` deletes it later unless ``keep`` is set."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voxelyard/{uuid.uuid4().hex[:12]}-{next(_serial)}-{name}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    if not keep:
        _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    return len(_scratch)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes the scratch tables made since a mark (all of them by default); call it once the results
    that read them are written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = _scratch[since:until]
    del _scratch[since:until]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def plus(schema: T.StructType, more: str) -> T.StructType:
    """The schema with further fields, given as DDL."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets with one more entry than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_null(column.type):
        column = pa.array([""] * len(column))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold at most ``most`` bytes together, or one row that holds more."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def trim() -> None:
    """Gives back what this process has freed: a Python worker lives as long as its executor and
    counts against it while other stages run."""
    pa.default_memory_pool().release_unused()
    if trim_heap := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim_heap(0)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
