"""Index arithmetic and Z-curves as Column expressions (JVM side, code-generated)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(c: Column | str | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c).cast("long")


def div(a, b) -> Column:
    """Integer quotient as a long."""
    return F.call_function("div", _long(a), _long(b))


def linear(x, y, z, width: int, height: int) -> Column:
    return _long(x) + _long(y) * width + _long(z) * (width * height)


def unlinear(i, width: int, height: int) -> tuple[Column, Column, Column]:
    i = _long(i)
    return (i % width).cast("int"), (div(i, width) % height).cast("int"), div(i, width * height).cast("int")


def _spread(c: Column, bits: int, step: int, shift: int) -> Column:
    out = F.shiftleft(c.bitwiseAND(F.lit(1).cast("long")), shift)
    for k in range(1, bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long")), step * k + shift))
    return out


def _gather(c: Column, bits: int, step: int, shift: int) -> Column:
    out = F.shiftright(c, shift).bitwiseAND(F.lit(1).cast("long"))
    for k in range(1, bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(c, step * k + shift).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def morton3d(x, y, z, bits: int = 10) -> Column:
    """Bit k of x, y, z goes to bits 3k, 3k + 1, 3k + 2; up to 21 bits an axis."""
    return _spread(_long(x), bits, 3, 0).bitwiseOR(_spread(_long(y), bits, 3, 1)).bitwiseOR(_spread(_long(z), bits, 3, 2))


def unmorton3d(code, bits: int = 10) -> tuple[Column, Column, Column]:
    return tuple(_gather(_long(code), bits, 3, k).cast("int") for k in range(3))


def morton2d(x, y, bits: int = 16) -> Column:
    return _spread(_long(x), bits, 2, 0).bitwiseOR(_spread(_long(y), bits, 2, 1))


def unmorton2d(code, bits: int = 16) -> tuple[Column, Column]:
    return tuple(_gather(_long(code), bits, 2, k).cast("int") for k in range(2))


def bit_reverse(c, bits: int) -> Column:
    """The number with its lowest ``bits`` bits in reverse order."""
    c = _long(c)
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long")), bits - 1 - k))
    return out


def stratified_pixel(i, power: int) -> tuple[Column, Column]:
    """Pixel (x, y) of step i in a 2^power square: the Z-curve position of the reversed step, so that
    every prefix of the sequence is spread over the square."""
    return unmorton2d(bit_reverse(i, 2 * power), power) if power else (F.lit(0), F.lit(0))
