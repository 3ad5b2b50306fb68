"""Exact deduplication by two-pass Bloom filtering.

Pass one inserts the hash of every row into a filter of saturating two-state cells ("seen",
"seen again") that each task builds over its own rows; the tasks' filters are folded cell by cell.
A hash all of whose cells are in state "seen again" is possibly repeated - every truly repeated
hash is.  Pass two tests every row: only the possibly repeated rows shuffle (digest and id, never
the text, when only decisions are asked for); all other rows pass straight through.

The filter takes ``BITS_PER_ROW`` bits a row, and one filter never more than ``MOST_BITS``, which
bounds the broadcast and what a task holds (two packed arrays of that size).  ``decide`` cuts a corpus
beyond that into parts by digest, each with a filter of its own, one after the other, so the share of
false positives stays.  ``drop_repeats``, which tests rows beside their texts, has one filter: beyond
``MOST_BITS`` it gets more false positives, and these cost shuffle, never a wrong answer, because the
repeated rows are grouped by their whole SHA-256.

Defined results: a null text counts as empty; a null id loses against any other; of repeated rows
with the same id and text exactly one stays; an empty table gives an empty result; other columns
are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, materialize, plus, text_buffers

BITS_PER_ROW = 16
MOST_BITS = 1 << 28  # 32 MiB
SEGMENT_BITS = 1 << 17
PROBES = 3


def _digests(column) -> list[bytes]:
    data, at = text_buffers(column)
    raw, sha = data.tobytes(), hashlib.sha256
    return [sha(raw[a:b].translate(ASCII_LOWER)).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _cells(digests: list[bytes], bits: int) -> np.ndarray:
    """PROBES cell numbers a row, by double hashing of the digest's first 16 bytes."""
    if not digests:
        return np.empty((0, PROBES), np.int64)
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)
    a, b = words[:, 0], words[:, 1] | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((a[:, None] + steps * b[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, sha) of every row, written once; rid tells repeated rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(rid, rid + n)), pa.array(_digests(batch.column(1)), pa.binary())], ["doc_id", "rid", "sha"])
            rid += n

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, rid long, sha binary")
    return materialize(out, "digests")


def repeat_filter(digests: DataFrame):
    """Broadcast (bits, packed cells seen again) over all digests."""
    spark = digests.sparkSession
    rows = digests.count()
    bits = 1 << 16
    while bits < min(rows * BITS_PER_ROW, MOST_BITS):
        bits *= 2
    size = min(bits, SEGMENT_BITS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = (np.zeros(bits // 8, np.uint8) for _ in range(2))

        def put(cells: np.ndarray, into: np.ndarray) -> None:
            """Sets sorted distinct cells."""
            if len(cells):
                at = cells >> 3
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                into[at[first]] |= np.bitwise_or.reduceat(np.uint8(128) >> (cells & 7).astype(np.uint8), first)

        for batch in batches:
            cells = _cells(batch.column(0).to_pylist(), bits).T
            for row in cells:  # a probe of its own each: one row does not repeat itself
                now, n = np.unique(row, return_counts=True)
                held = (once[now >> 3] >> (7 - (now & 7)).astype(np.uint8)) & 1
                put(now[(n > 1) | (held == 1)], again)
                put(now, once)
        for k in np.flatnonzero(once.reshape(-1, size // 8).any(axis=1)).tolist():
            part = slice(k * size // 8, (k + 1) * size // 8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([once[part].tobytes()], pa.binary()), pa.array([again[part].tobytes()], pa.binary())], ["seg", "once", "again"])

    def fold(key: tuple, parts: pa.Table) -> pa.Table:
        once, again = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        for a, b in zip(parts["once"], parts["again"]):
            a, b = (np.frombuffer(x.as_buffer(), np.uint8) for x in (a, b))
            again |= b | (once & a)
            once |= a
        return pa.table({"seg": pa.array([key[0].as_py()], pa.int32()), "again": pa.array([again.tobytes()], pa.binary())})

    built = digests.select("sha").coalesce(512).mapInArrow(build, "seg int, once binary, again binary")
    cells = np.zeros((bits // size, size // 8), np.uint8)
    for row in built.groupBy("seg").applyInArrow(fold, "seg int, again binary").collect():  # at most MOST_BITS in all
        cells[row.seg] = np.frombuffer(row.again, np.uint8)
    return spark.sparkContext.broadcast((bits, cells.reshape(-1)))


def _maybe(digests: list[bytes], seen) -> np.ndarray:
    bits, packed = seen.value
    cells = _cells(digests, bits)
    return ((packed[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=1)


def _marked(digests: DataFrame, seen) -> DataFrame:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("maybe", pa.array(_maybe(batch.column(2).to_pylist(), seen)))

    return digests.select("doc_id", "rid", "sha").mapInArrow(mark, plus(digests.select("doc_id", "rid", "sha").schema, "maybe boolean"))


def possibly_repeated(digests: DataFrame) -> DataFrame:
    """The digests with ``maybe``: true of every repeated one and of few others, however many there are.
    More rows than one filter serves are written once more by the digest's last bytes, a folder
    a part, so that each part is read once for its filter and once for its marks."""
    rows, parts = digests.count(), 1
    while parts * MOST_BITS < rows * BITS_PER_ROW:
        parts *= 2
    if parts == 1:
        return _marked(digests, repeat_filter(digests))
    # the cells come from the digest's first 16 bytes, the part from its last 4
    last = F.conv(F.hex(F.substring("sha", 29, 4)), 16, 10).cast("long")
    cut = materialize(digests.coalesce(512).withColumn("part", (last % parts).cast("int")), "digest-parts", by="part")
    out = None
    for k in range(parts):
        part = cut.where(F.col("part") == k)
        seen = repeat_filter(part)
        marks = materialize(_marked(part, seen), f"marks-{k}")
        seen.destroy()
        out = marks if out is None else out.unionByName(marks)
    return out


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    marked = possibly_repeated(digest_table(docs, id_col, text_col))
    repeated = marked.where("maybe")
    groups = repeated.groupBy("sha").agg(F.max(F.struct("doc_id", "rid")).alias("last"), F.count("*").alias("n")).where("n > 1")
    # as a table of its own, so that both sides of the join are plain shuffles, whose hot keys Spark splits
    groups = materialize(groups, "groups")
    joined = repeated.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("rid") == F.col("last.rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    single = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return single.unionByName(joined)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.  Possibly repeated rows pass a row_number
    of 1 a digest, which Spark already cuts before the shuffle, so a hot group leaves each task as
    one row; the other rows never shuffle."""
    seen = repeat_filter(digest_table(docs, id_col, text_col))
    where, columns = docs.columns.index(text_col), docs.columns
    names = [f"c{k}" for k in range(len(columns))]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = _digests(batch.column(where))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary()), pa.array(_maybe(digests, seen))], [*names, "sha", "maybe"])

    plain = docs.toDF(*names)
    marked = plain.mapInArrow(mark, plus(plain.schema, "sha binary, maybe boolean"))
    order = Window.partitionBy("sha").orderBy(F.col(f"c{columns.index(id_col)}").desc_nulls_last())
    winners = marked.where("maybe").withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return marked.where("not maybe").select(names).unionByName(winners.select(names)).toDF(*columns)
