"""Scalar functions on labels, bytes and distances."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def msb(c: Column) -> Column:
    """Index of the highest set bit, -1 for zero."""
    return F.when(c <= 0, F.lit(-1)).otherwise(F.length(F.bin(c.cast("long"))) - 1).cast("int")


def bytes_per_voxel(labels: Column) -> Column:
    top = msb(labels)
    return F.when(top > 15, 4).when(top > 7, 2).otherwise(1).cast("int")


def inv_lod_for_distance(distance: Column, per_distance: float, lods: int, bias: int = 0, most: int | None = None) -> Column:
    """Inverse level of detail of a brick at a distance: coarser by one whenever the distance doubles."""
    far = F.least(F.greatest(F.lit(bias) + msb(F.floor(distance * per_distance)), F.lit(0)), F.lit(lods - 1))
    return F.least(F.lit(lods - 1) - far, F.lit(lods - 1 if most is None else most)).cast("int")


def rgba(label: Column) -> tuple[Column, ...]:
    """The four bytes of a label, lowest first."""
    return tuple(F.shiftright(label.cast("long"), 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(4))


def endian_swap32(c: Column) -> Column:
    r, g, b, a = (x.cast("long") for x in rgba(c))
    return F.shiftleft(r, 24).bitwiseOR(F.shiftleft(g, 16)).bitwiseOR(F.shiftleft(b, 8)).bitwiseOR(a)


def pack_nibbles(nibbles: Column) -> Column:
    """Up to eight 4-bit numbers in one 32-bit number, the first in the highest bits."""
    shift = lambda acc, x: F.shiftleft(acc, 4).bitwiseOR(x.cast("long"))
    padded = F.concat(nibbles.cast("array<long>"), F.array_repeat(F.lit(0).cast("long"), 8 - F.size(nibbles)))
    return F.aggregate(padded, F.lit(0).cast("long"), shift)


def nibble_at(word: Column, k: int) -> Column:
    return F.shiftright(word, 28 - 4 * k).bitwiseAND(F.lit(15)).cast("int")


def register_udfs(spark: SparkSession) -> None:
    """SQL functions of the engine: ``morton3d(x, y, z)``, ``morton2d(x, y)``, ``bytes_per_voxel(n)``."""
    spread3 = lambda c, s: " | ".join(f"shiftleft(shiftright({c}, {k}) & 1L, {3 * k + s})" for k in range(10))
    spread2 = lambda c, s: " | ".join(f"shiftleft(shiftright({c}, {k}) & 1L, {2 * k + s})" for k in range(16))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION morton3d(x BIGINT, y BIGINT, z BIGINT) RETURNS BIGINT RETURN {spread3('x', 0)} | {spread3('y', 1)} | {spread3('z', 2)}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION morton2d(x BIGINT, y BIGINT) RETURNS BIGINT RETURN {spread2('x', 0)} | {spread2('y', 1)}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bytes_per_voxel(n BIGINT) RETURNS INT RETURN CASE WHEN n >= 65536 THEN 4 WHEN n >= 256 THEN 2 ELSE 1 END")


__all__ = ["bytes_per_voxel", "endian_swap32", "inv_lod_for_distance", "msb", "nibble_at", "pack_nibbles", "register_udfs", "rgba"]
