"""32-bit PCG hashes (published constants) on long columns; all arithmetic wraps at 2^32."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
MUL, ADD = 1664525, 1013904223  # fixed values


def _u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def _mul(a: Column, b: Column) -> Column:
    """Product of two 32-bit numbers modulo 2^32, by halves that cannot overflow a long."""
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return _u32(high + a * b.bitwiseAND(F.lit(0xFFFF)))


def _lcg(c: Column) -> Column:
    return _u32(c * MUL + ADD)


def _fold(c: Column) -> Column:
    return c.bitwiseXOR(F.shiftright(c, 16))


def pcg2d(x: Column, y: Column) -> tuple[Column, Column]:
    x, y = (_lcg(_u32(c.cast("long"))) for c in (x, y))
    for _ in range(2):
        x = _u32(x + y * MUL)
        y = _u32(y + x * MUL)
        x, y = _fold(x), _fold(y)
    return x, y


def pcg3d(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    x, y, z = (_lcg(_u32(c.cast("long"))) for c in (x, y, z))
    for k in range(2):
        x = _u32(x + _mul(y, z))
        y = _u32(y + _mul(z, x))
        z = _u32(z + _mul(x, y))
        if not k:
            x, y, z = _fold(x), _fold(y), _fold(z)
    return x, y, z


def stepwise_pcg(df, names: list[str], out: list[str]):
    """pcg3d or pcg4d of columns, one projection a step: the closed expressions grow too fast."""
    df = df.withColumns({o: _lcg(_u32(F.col(n).cast("long"))) for n, o in zip(names, out)})
    # which two coordinates are multiplied into which (fixed values)
    steps = {3: [(0, 1, 2), (1, 2, 0), (2, 0, 1)], 4: [(0, 1, 3), (1, 2, 0), (2, 0, 1), (3, 1, 2)]}[len(names)]
    for k in range(2):
        for a, b, c in steps:
            df = df.withColumn(out[a], _u32(F.col(out[a]) + _mul(F.col(out[b]), F.col(out[c]))))
        if not k:
            df = df.withColumns({o: _fold(F.col(o)) for o in out})
    return df


def change_key(*columns: str) -> Column:
    """A key that changes with any of the columns, for change detection."""
    return F.xxhash64(*columns)
