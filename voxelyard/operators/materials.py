"""Materials: ordered closed-interval rules on attributes, and the colours they give."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import pcg2d

NONE, ANY = -2, -1
CLAMP, REPEAT, RANDOM = 0, 1, 2


@dataclass(frozen=True)
class Material:
    """Voxels whose ``attribute`` lies in [low, high]; ``attribute`` is a column name, NONE or ANY."""

    attribute: str | int
    low: float = 0.0
    high: float = 0.0
    tf_attribute: str = "label"
    tf_low: float = 0.0
    tf_high: float = 1.0
    opacity: float = 1.0
    emission: float = 0.0
    wrapping: int = RANDOM

    def matches(self) -> Column:
        if self.attribute == NONE:
            return F.lit(False)
        if self.attribute == ANY:
            return F.lit(True)
        return F.col(self.attribute).between(self.low, self.high)


def classify(materials: list[Material]) -> Column:
    """Index of the first material that matches, -1 for none."""
    out = F.lit(-1)
    for k in reversed(range(len(materials))):
        out = F.when(materials[k].matches(), F.lit(k)).otherwise(out)
    return out.cast("int")


def visible(materials: list[Material]) -> Column:
    return classify(materials) >= 0


def visible_labels(table: DataFrame, materials: list[Material]) -> DataFrame:
    return table.select("label", classify(materials).alias("material")).where("material >= 0")


def default_materials(ranges: DataFrame, count: int, first: str) -> list[Material]:
    """Material 0 takes the whole range of the first attribute (from 1 where it starts at 0, which
    hides the background); the others match nothing."""
    row = ranges.where(F.col("attribute") == first).first()
    low = 1.0 if row.lo == 0 else row.lo
    return [Material(first, low, row.hi, first, low, row.hi), *[Material(NONE) for _ in range(count - 1)]]


def _fract(c: Column) -> Column:
    return c - F.floor(c)


def colour_coordinate(m: Material) -> Column:
    """Position in the transfer function, before clamping to [0, 1] by the sampler."""
    value = F.col(m.tf_attribute).cast("double")
    if m.wrapping == RANDOM:
        seed = struct.unpack("<I", struct.pack("<f", m.tf_low))[0]
        return _fract(((pcg2d(F.col("label"), F.lit(seed))[0] % 65536) / 65536.0) + F.lit(m.tf_high / 65536.0))
    at = (value - F.lit(m.tf_low)) / F.lit(m.tf_high + 1.0 - m.tf_low)
    if m.wrapping == REPEAT:
        length = m.tf_high - m.tf_low
        return _fract(at) * F.lit((length + 1.0) / length)
    return at


@dataclass(frozen=True)
class TransferFunction:
    """Piecewise linear colour and opacity over control points (position, value...)."""

    colours: tuple[tuple[float, float, float, float], ...]
    opacities: tuple[tuple[float, float], ...] = ((0.0, 0.0), (1.0, 1.0))

    @staticmethod
    def _sample(points, at: float) -> tuple[float, ...]:
        at = at * (points[-1][0] - points[0][0]) + points[0][0]
        low = points[0]
        for high in points:
            if high[0] >= at:
                a = 0.5 if low[0] == high[0] else (at - low[0]) / (high[0] - low[0])
                return tuple(p * (1 - a) + q * a for p, q in zip(low[1:], high[1:]))
            low = high
        return tuple(points[-1][1:])

    def samples(self, width: int = 256) -> list[tuple[int, float, float, float, float]]:
        return [(k, *self._sample(self.colours, k / (width - 1)), *self._sample(self.opacities, k / (width - 1))) for k in range(width)]

    def lut(self, spark, width: int = 256) -> DataFrame:
        """The rasterised function: one row a sample, a bounded dimension table."""
        rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("slot", "r", "g", "b", "alpha"))]) for s in self.samples(width)])
        return spark.range(1).select(F.explode(rows).alias("s")).select("s.*")


def lut_slot(coordinate: Column, width: int = 256) -> Column:
    """Sample of a coordinate, clamped to the function."""
    return F.floor(F.least(F.greatest(coordinate, F.lit(0.0)), F.lit(1.0)) * (width - 1) + 0.5).cast("int")


# CIE constants of the sRGB primaries under D65 (fixed values)
_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
_WHITE = (0.95047, 1.0, 1.08883)


def _lab(rgb: tuple[float, float, float]) -> tuple[float, float, float]:
    linear = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in rgb]
    f = []
    for row, white in zip(_XYZ, _WHITE):
        t = sum(a * b for a, b in zip(row, linear)) / white
        f.append(t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116)
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def _rgb(lab: tuple[float, float, float]) -> tuple[float, float, float]:
    fy = (lab[0] + 16) / 116
    xyz = [w * (t**3 if t**3 > 0.008856 else (t - 16 / 116) / 7.787) for t, w in zip((fy + lab[1] / 500, fy, fy - lab[2] / 200), _WHITE)]
    (a, b, c), (d, e, f), (g, h, i) = _XYZ
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    inverse = (((e * i - f * h), (c * h - b * i), (b * f - c * e)), ((f * g - d * i), (a * i - c * g), (c * d - a * f)), ((d * h - e * g), (b * g - a * h), (a * e - b * d)))
    linear = [sum(m * v for m, v in zip(row, xyz)) / det for row in inverse]
    return tuple(min(1.0, max(0.0, 12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055)) for v in linear)


# Fixed values of the published diverging map (Moreland, "Diverging Color Maps for Scientific
# Visualization", 2009): least saturation, least magnitude of the white middle, hue distance.
_SATURATED, _WHITE_MIDDLE, _HUE_GAP = 0.05, 88.0, math.pi / 3


def diverging(low: tuple[float, float, float], high: tuple[float, float, float], at: float) -> tuple[float, float, float]:
    """Diverging colour map in polar CIELAB (magnitude, saturation, hue) with a white midpoint
    between saturated, distinct hues; an unsaturated end turns its hue to avoid false colours."""

    def msh(rgb):
        lab = _lab(rgb)
        m = math.hypot(*lab)
        s = math.acos(lab[0] / m) if m > 0 else 0.0
        return m, s, math.atan2(lab[2], lab[1]) if s > 0 else 0.0

    def turned(of, m):
        if of[0] >= m:
            return of[2]
        spin = of[1] * math.sqrt(m * m - of[0] * of[0]) / (of[0] * math.sin(of[1]))
        return of[2] + spin if of[2] > -_HUE_GAP else of[2] - spin

    a, b = msh(low), msh(high)
    gap = abs(a[2] - b[2])
    gap = min(gap, 2 * math.pi - gap)
    if a[1] > _SATURATED and b[1] > _SATURATED and gap > _HUE_GAP:
        middle = max(a[0], b[0], _WHITE_MIDDLE)
        if at < 0.5:
            b, at = (middle, 0.0, 0.0), 2 * at
        else:
            a, at = (middle, 0.0, 0.0), 2 * at - 1
    if a[1] < _SATURATED < b[1]:
        a = (a[0], a[1], turned(b, a[0]))
    elif b[1] < _SATURATED < a[1]:
        b = (b[0], b[1], turned(a, b[0]))
    m, s, h = (p * (1 - at) + q * at for p, q in zip(a, b))
    return _rgb((m * math.cos(s), m * math.sin(s) * math.cos(h), m * math.sin(s) * math.sin(h)))


#: Named two-ended maps, rendered through ``diverging``; end colours are this engine's own.
COLORMAPS: dict[str, tuple[tuple[float, float, float], tuple[float, float, float]]] = {
    "cool-warm": ((0.23, 0.30, 0.75), (0.71, 0.02, 0.15)),
    "purple-orange": ((0.44, 0.30, 0.60), (0.76, 0.40, 0.04)),
    "green-purple": ((0.09, 0.50, 0.25), (0.44, 0.30, 0.60)),
    "blue-brown": ((0.22, 0.40, 0.70), (0.55, 0.32, 0.05)),
    "grey": ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)),
}


def colormap(name: str, points: int = 33) -> TransferFunction:
    low, high = COLORMAPS[name]
    return TransferFunction(tuple((k / (points - 1), *diverging(low, high, k / (points - 1))) for k in range(points)))
