"""Sharding by histogram sort, under the law of near-equal bytes.

Every row gets a 64-bit key: the upper half hashes its text, the lower half its id and its number
in the task that reads it, so equal texts lie side by side in key order and yet one huge group of
them, or of equal rows, can be cut.  The driver holds, for
each boundary between bins, an interval of keys; in every round all tasks count the exact bytes and
rows below a grid of candidate keys (map-side, so a round moves bins x tasks numbers), and the
interval shrinks to the cell that holds the target, until the boundary is within tolerance.  Then
rows are exchanged once, and the slot in a shard follows from the counts of the bins before it.

Bins are finer than shards (``BIN_ROWS`` rows on average), so no task gathers a shard; there are at
most ``MOST_BINS``, which bounds the counts that the driver sees in a round (at 10^11 rows a bin is
some 40 million rows of 40 bytes, which a task sorts on disk).

Defined results: a null text has no bytes and a CRC of 0; null ids and repeated rows are placed once
each like any others, in any order among themselves; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plus

SHARDS = 24
ROW_OVERHEAD = 8
#: Part of a shard's bytes by which a boundary may miss its target.
TOLERANCE = 0.0005
GRID = 64
BIN_ROWS, MOST_BINS = 500_000, 2400
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key) of every row, written once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.shiftleft(F.xxhash64(text), 32).bitwiseOR(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).bitwiseAND(F.lit(0xFFFFFFFF)))
    out = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("key"))
    return materialize(out, "shard-keys")


def _below(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key under each probe."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(), "right")
            np.add.at(size, at, batch.column(1).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(size[used]), pa.array(rows[used])], ["bin", "size", "n"])

    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in keys.select("key", "size").mapInArrow(count, "bin long, size long, n long").groupBy("bin").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect():
        size[r.bin], rows[r.bin] = r.size, r.n
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, bins: int, strict: int, total: int, largest: int) -> tuple[list[int], list[int]]:
    """Keys of the bins - 1 boundaries (a row at or above the key lies beyond) and rows below each.
    Every ``strict``-th boundary is refined to the tolerance or to the last key, the others less."""
    targets = [total * j // bins for j in range(1, bins)]
    tight = max(total * strict / bins * TOLERANCE, largest / 2)
    loose = max(total / bins / 4, largest)
    low, high = [LOW] * len(targets), [HIGH] * len(targets)
    best: list[tuple[float, int, int]] = [(float("inf"), LOW, 0)] * len(targets)
    while True:
        open_ = [j for j, t in enumerate(targets) if high[j] - low[j] > 1 and best[j][0] > (tight if (j + 1) % strict == 0 else loose)]
        if not open_:
            break
        probes = np.array(sorted({low[j] + (high[j] - low[j]) * g // GRID for j in open_ for g in range(1, GRID)} | {high[j] for j in open_ if high[j] == HIGH}), np.int64)
        size, rows = _below(keys, probes)
        for j in open_:
            for k in range(int(np.searchsorted(probes, low[j], "right")), int(np.searchsorted(probes, high[j], "right"))):
                best[j] = min(best[j], (abs(int(size[k]) - targets[j]), int(probes[k]), int(rows[k])))
            over = int(np.searchsorted(size, targets[j], "right"))  # the first probe with more below it
            below, above = (int(probes[over - 1]) if over else LOW), (int(probes[over]) if over < len(probes) else HIGH)
            low[j], high[j] = max(low[j], below), min(high[j], above)
    best.sort(key=lambda b: b[1])
    return [b[1] for b in best], [b[2] for b in best]


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    keys = keyed(docs, id_col, text_col)
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n"), F.coalesce(F.max("size"), F.lit(0)).alias("m")).first()
    fine = max(4, min(MOST_BINS // shards, -(-total.n // (shards * BIN_ROWS))))
    cuts, before = splitters(keys, shards * fine, fine, total.b, total.m) if total.n else ([], [])
    bounds, rows = np.array(cuts, np.int64), np.array([0, *before], np.int64)
    first = rows - rows[np.arange(len(rows)) // fine * fine]  # rows of the same shard in earlier bins

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(3).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(first[at])], [*batch.schema.names, "bin", "first"])

    placed = keys.mapInArrow(place, plus(keys.schema, "bin int, first long"))
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("key", "doc_id"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), (F.col("bin") / fine).cast("int").alias("shard"), (F.col("first") + rank - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
