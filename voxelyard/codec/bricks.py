"""Brick tables: encoding volumes to one row a brick and back, on Spark.

A brick is at most 64^3 cells, so a group of the encoding shuffle is bounded by construction; decoding
is a narrow map that can skip bricks by filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spacefill import linear
from ..volume import AXES, Volume
from . import ops as O
from . import packing as P

MODES = ("nibble", "random", "rans", "rans2", "wavelet", "huffman", "stopped")
#: Modes that store every node's operation, and of these the ones that store it in bit vectors.
COMPLETE, SUCCINCT = ("random", "wavelet", "huffman", "stopped"), ("wavelet", "huffman", "stopped")
SCHEMA = "brick_idx long, bx int, by int, bz int, n_ops int, starts array<int>, ops binary, detail binary, palette array<long>, mask binary"


def select_mode(strength: int, random_access: bool) -> str:
    """Encoding of a strength from 0 to 2: nibbles, range-ANS with one table, with two; with random
    access nibbles, the wavelet matrix, the Huffman-shaped one."""
    if strength not in (0, 1, 2):
        raise ValueError("strength is 0, 1 or 2")
    return (("random", "wavelet", "huffman") if random_access else ("nibble", "rans", "rans2"))[strength]


def _valid(side: int, corner: tuple[int, int, int], dims: tuple[int, int, int]) -> np.ndarray:
    return (O.z_order(side) + np.array(corner) < np.array(dims)).all(1)


def _inside(row: dict, side: int, dims: tuple[int, int, int]) -> np.ndarray:
    """The brick's voxels, in Z order: those in the volume, or those its own mask names."""
    if row["mask"] is not None:
        return np.unpackbits(np.frombuffer(row["mask"], np.uint8), count=side**3).astype(bool)
    return _valid(side, (row["bx"] * side, row["by"] * side, row["bz"] * side), dims)


def _detail_start(starts) -> int:
    """First nibble of the finest level, which is kept apart."""
    return int(starts[-1])


def _counts(bricks: Iterator[tuple[np.ndarray, int]]) -> np.ndarray:
    out = np.zeros((2, 16), np.int64)
    for nibbles, split in bricks:
        out[0] += np.bincount(nibbles[:split], minlength=16)
        out[1] += np.bincount(nibbles[split:], minlength=16)
    return out


def encode(volume: Volume, side: int, mode: str = "nibble", mask: str = "o", tables: np.ndarray | None = None) -> DataFrame:
    """One row a brick.  Range-ANS modes take their 2 x 16 symbol counts from ``tables``
    (``symbol_counts``); the finest level's operations lie in ``detail`` (but for the modes of bit
    vectors, whose ``ops`` hold those of all levels), and ``mask`` is set where voxels of the volume
    are absent."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if side > 64 or side & (side - 1):
        raise ValueError("a brick's side is a power of two up to 64")
    allowed, short = O.parse_mask(mask)
    volume_dims = volume.dims
    coders = None
    if mode.startswith("rans"):
        counts = np.asarray(tables)
        coders = [counts.sum(0)] * 2 if mode == "rans" else list(counts)

    def run(key: tuple, part: pa.Table) -> pa.Table:
        idx, bx, by, bz = (k.as_py() for k in key)
        at = [part[a].to_numpy() - b * side for a, b in zip(AXES, (bx, by, bz))]
        cells = np.full(side**3, -1, np.int64)
        cells[O.z_index(side)[at[0], at[1], at[2]]] = part["label"].to_numpy()
        if mode in COMPLETE:
            nibbles, starts, palette = O.encode_all(cells)
        else:
            nibbles, starts, palette = O.encode(cells, allowed, short)
        split = _detail_start(starts)
        halves = nibbles[:split], nibbles[split:]
        if coders:
            packed = [P.RangeANS(c).encode(h) if len(h) else b"" for c, h in zip(coders, halves)]
        elif mode in SUCCINCT:
            packed = [_succinct(nibbles, starts, mode).to_bytes(), b""]
        else:
            packed = [P.pack_nibbles(h).astype(">u4").tobytes() for h in halves]
        full = _valid(side, (bx * side, by * side, bz * side), volume_dims)
        mask_bits = None if ((cells >= 0) == full).all() else np.packbits(cells >= 0).tobytes()
        row = [[idx], [bx], [by], [bz], [len(nibbles)], [[int(s) for s in starts]], [packed[0]], [packed[1]], [[int(p) for p in palette[::-1]]], [mask_bits]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        return pa.table({n.split(" ")[0]: pa.array(v, k) for n, v, k in zip(SCHEMA.split(", "), row, kinds)})

    cut = volume.with_brick(side).df.select("brick_idx", "bx", "by", "bz", *AXES, "label")
    return cut.groupBy("brick_idx", "bx", "by", "bz").applyInArrow(run, SCHEMA)


def _succinct(nibbles: np.ndarray, starts, mode: str):
    if mode == "stopped":
        return P.StoppedStream(nibbles, starts, O.constant_below(nibbles, starts))
    return (P.WaveletMatrix if mode == "wavelet" else P.HuffmanWaveletMatrix)(nibbles)


def _stored(row: dict, mode: str):
    """The structure that a row of a bit-vector mode holds."""
    if mode == "stopped":
        return P.StoppedStream.from_bytes(row["ops"], row["starts"])
    return (P.WaveletMatrix if mode == "wavelet" else P.HuffmanWaveletMatrix).from_bytes(row["ops"])


def unpack(ops: bytes, detail: bytes, starts: list[int], n: int, coders=None) -> np.ndarray:
    """The brick's nibbles in order."""
    split = _detail_start(starts)
    out = []
    for k, (raw, m) in enumerate(((ops, split), (detail, n - split))):
        if coders:
            out.append(P.RangeANS(coders[k]).decode(raw, m) if m else np.empty(0, np.uint8))
        else:
            out.append(P.unpack_nibbles(np.frombuffer(raw, ">u4").astype(np.uint32), m))
    return np.concatenate(out)


def symbol_counts(bricks: DataFrame, every: int = 1) -> np.ndarray:
    """2 x 16 counts of the symbols above and at the finest level of nibble bricks (every ``every``-th
    an axis, scaled up): 32 numbers a task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            counts = _counts((unpack(r["ops"], r["detail"], r["starts"], r["n_ops"]), _detail_start(r["starts"])) for r in rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], 16), pa.int32()), pa.array(np.tile(np.arange(16), 2), pa.int32()), pa.array(counts.reshape(-1))], ["detail", "op", "n"])

    sample = bricks.where((F.col("bx") % every == 0) & (F.col("by") % every == 0) & (F.col("bz") % every == 0))
    out = np.zeros((2, 16), np.int64)
    for r in sample.mapInArrow(run, "detail int, op int, n long").groupBy("detail", "op").agg(F.sum("n").alias("n")).collect():  # 32 rows
        out[r.detail, r.op] = r.n * every**3
    return out


def _brick_rows(bricks: DataFrame) -> DataFrame:
    return bricks.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")])


def decode(bricks: DataFrame, dims: tuple[int, int, int], side: int, mode: str = "nibble", mask: str = "o", tables: np.ndarray | None = None, inv_lod: int | None = None) -> DataFrame:
    """(x, y, z, label) of the nodes of a level (coordinates in nodes; default: the voxels)."""
    short = O.parse_mask(mask)[1]
    top = side.bit_length() - 1
    depth = top if inv_lod is None else inv_lod
    nodes = 1 << depth
    coders = None
    if mode.startswith("rans"):
        counts = np.asarray(tables)
        coders = [counts.sum(0)] * 2 if mode == "rans" else list(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                valid = _inside(r, side, dims)
                palette = r["palette"][::-1]
                stream = _stored(r, mode).symbols() if mode in SUCCINCT else unpack(r["ops"], r["detail"], r["starts"], r["n_ops"], coders)
                if mode in COMPLETE:
                    seen = valid.reshape(nodes**3, -1).any(1)
                    labels = np.where(seen, O.read_level(stream, r["starts"], palette, depth), -1)
                else:
                    labels = O.decode(stream, palette, side, valid, short, depth)
                keep = labels >= 0
                at = O.z_order(nodes)[keep] + np.array([r["bx"], r["by"], r["bz"]]) * nodes
                yield pa.RecordBatch.from_arrays([*(pa.array(at[:, a].astype(np.int32)) for a in range(3)), pa.array(labels[keep])], [*AXES, "label"])

    return _brick_rows(bricks).mapInArrow(run, "x int, y int, z int, label long")


def _reader(row: dict, mode: str):
    """(symbol, rank of palette pushes) of a complete stream under one of the random-access modes."""
    if mode in SUCCINCT:
        matrix = _stored(row, mode)
        return matrix.access, lambda k: matrix.rank(O.PALETTE_ADV, k)
    stream = unpack(row["ops"], row["detail"], row["starts"], row["n_ops"])
    ranks = np.concatenate([[0], np.cumsum(stream == O.PALETTE_ADV)])
    return lambda k: int(stream[k]), lambda k: int(ranks[k])


def read_voxels(bricks: DataFrame, wanted: DataFrame, dims: tuple[int, int, int], side: int, mode: str = "random") -> DataFrame:
    """(x, y, z, label) of single voxels: the wanted ones meet only their bricks, and of these only the
    operations on the voxels' own paths are read."""
    nx, ny = ((d - 1) // side + 1 for d in dims[:2])
    cell = [F.call_function("div", F.col(a).cast("long"), F.lit(side).cast("long")) for a in AXES]
    asked = wanted.select(linear(*cell, nx, ny).alias("brick_idx"), F.struct(*AXES).alias("p")).groupBy("brick_idx").agg(F.collect_list("p").alias("points"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                symbol, rank = _reader(r, mode)
                palette, index, depth = r["palette"][::-1], O.z_index(side), len(r["starts"]) - 1
                points = [(p["x"], p["y"], p["z"]) for p in r["points"]]
                labels = [O.read_voxel(symbol, rank, r["starts"], palette, side, int(index[x % side, y % side, z % side]), depth) for x, y, z in points]
                yield pa.RecordBatch.from_arrays([*(pa.array([p[a] for p in points], pa.int32()) for a in range(3)), pa.array(labels, pa.int64())], [*AXES, "label"])

    return _brick_rows(bricks).join(asked, "brick_idx").mapInArrow(run, "x int, y int, z int, label long")


def violations(bricks: DataFrame, side: int) -> DataFrame:
    """(brick_idx, problem) of rows that break a brick's structure."""
    levels = side.bit_length()
    ascending = F.forall(F.sequence(F.lit(1), F.size("starts") - 1), lambda k: F.get("starts", k - 1) <= F.get("starts", k))
    problems = [
        (F.size("starts") != levels, "level count"),
        (F.get("starts", F.lit(0)) != 0, "first start"),
        (~ascending, "level order"),
        (F.get("starts", F.size("starts") - 1) > F.col("n_ops"), "level beyond the end"),
        (F.size("palette") == 0, "empty palette"),
        (F.size("palette") > F.col("n_ops"), "palette longer than the operations"),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in problems]))
    return bricks.select("brick_idx", F.explode(found).alias("problem"))


def operations(bricks: DataFrame) -> DataFrame:
    """(brick_idx, inv_lod, i, op, stop): the stored nibbles one by one, for inspection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                s = unpack(r["ops"], r["detail"], r["starts"], r["n_ops"])
                k = np.arange(len(s))
                lod = np.searchsorted(r["starts"], k, "right") - 1
                first = np.array(r["starts"])[lod]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), r["brick_idx"])), pa.array(lod.astype(np.int32)), pa.array((k - first).astype(np.int32)), pa.array((s & 7).astype(np.int32)), pa.array(s >= 8)], ["brick_idx", "inv_lod", "i", "op", "stop"])

    return _brick_rows(bricks).mapInArrow(run, "brick_idx long, inv_lod int, i int, op int, stop boolean")


def statistics(bricks: DataFrame) -> DataFrame:
    """brick_x, brick_y, brick_z, total_byte_size, palette_length."""
    words = 1 + F.size("starts") + 1 + F.ceil((F.octet_length("ops") + F.octet_length("detail")) / 4) + F.size("palette")
    return bricks.select(F.col("bx").alias("brick_x"), F.col("by").alias("brick_y"), F.col("bz").alias("brick_z"), (words * 4).cast("long").alias("total_byte_size"), F.size("palette").cast("long").alias("palette_length"))


def merge_chunks(chunks: list[tuple[DataFrame, tuple[int, int, int]]], dims: tuple[int, int, int], side: int) -> DataFrame:
    """Brick tables of chunks at voxel offsets, as one table; offsets must be multiples of the side."""
    nx, ny = ((d - 1) // side + 1 for d in dims[:2])
    out = None
    for bricks, offset in chunks:
        if any(o % side for o in offset):
            raise ValueError("chunk offsets must be multiples of the brick's side")
        moved = bricks.withColumns({f"b{a}": (F.col(f"b{a}") + o // side).cast("int") for a, o in zip(AXES, offset)})
        moved = moved.withColumn("brick_idx", linear("bx", "by", "bz", nx, ny))
        out = moved if out is None else out.unionByName(moved)
    return out


ENTRY = "brick_idx long, bx int, by int, bz int, index_bits int, words binary, palette array<long>"


def cache_entries(volume: Volume, side: int) -> DataFrame:
    """One row a brick as the palettised cache holds it: 32-bit words of as many palette indices as
    fit, in Z order, counted from the palette's end; 0 is no voxel."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        palette, at = np.unique(part["label"].to_numpy(), return_inverse=True)
        bits = max(1, len(palette).bit_length())
        per = 32 // bits
        index = np.zeros(-(-(side**3) // per) * per, np.uint32)
        x, y, z = (part[a].to_numpy() % side for a in AXES)
        index[O.z_index(side)[x, y, z]] = len(palette) - at
        words = np.bitwise_or.reduce(index.reshape(-1, per) << (bits * np.arange(per, dtype=np.uint32)), axis=1)
        row = [[k.as_py()] for k in key] + [[bits], [words.astype("<u4").tobytes()], [palette.tolist()]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        return pa.table({n.split(" ")[0]: pa.array(v, k) for n, v, k in zip(ENTRY.split(", "), row, kinds)})

    cut = volume.with_brick(side).df.select("brick_idx", "bx", "by", "bz", *AXES, "label")
    return cut.groupBy("brick_idx", "bx", "by", "bz").applyInArrow(run, ENTRY)


def read_entries(entries: DataFrame, side: int) -> DataFrame:
    """(x, y, z, label) of palettised cache rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bits, palette = r["index_bits"], np.array(r["palette"], np.int64)
                shifts = bits * np.arange(32 // bits, dtype=np.uint32)
                index = (np.frombuffer(r["words"], "<u4")[:, None] >> shifts & np.uint32((1 << bits) - 1)).reshape(-1)[: side**3].astype(np.int64)
                keep = np.flatnonzero(index)
                at = O.z_order(side)[keep] + np.array([r["bx"], r["by"], r["bz"]]) * side
                yield pa.RecordBatch.from_arrays([*(pa.array(at[:, a].astype(np.int32)) for a in range(3)), pa.array(palette[len(palette) - index[keep]])], [*AXES, "label"])

    return entries.select(*[c.split(" ")[0] for c in ENTRY.split(", ")]).mapInArrow(run, "x int, y int, z int, label long")


def entry_sizes(volume: Volume, side: int) -> DataFrame:
    """(brick_idx, entries, index_bits, bytes) of palettised cache rows, without packing them."""
    palettes = volume.with_brick(side).df.groupBy("brick_idx").agg(F.count_distinct("label").alias("entries"))
    bits = F.length(F.bin("entries"))
    words = F.ceil(F.lit(side**3) / F.floor(F.lit(32) / bits))
    return palettes.select("brick_idx", "entries", bits.cast("int").alias("index_bits"), (4 * words + 8 * F.col("entries")).cast("long").alias("bytes"))
