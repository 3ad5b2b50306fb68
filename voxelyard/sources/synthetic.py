"""Synthetic volumes: random boxes and ellipsoids painted over each other, from a seed.

Each region's numbers are hashes of (seed, region), so the volume is the same on any cluster.  A
region meets only the cells of a coarse grid that its bounding box touches, and the last painter of
a voxel is found by a max with map-side partials.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spacefill import unlinear
from ..volume import AXES, Volume


@dataclass(frozen=True)
class Spec:
    dims: tuple[int, int, int] = (100, 80, 95)
    voxels_per_label: int = 8192
    most_label: int = 1 << 31
    low: int = 10
    high: int = 50
    shape: float = 0.5
    seed: int = 1


def parse(text: str) -> Spec:
    """``+synth_d100x80x95_l8192_max1000_r10-50_b0.5_s7``: any parts in any order; ``100x80x95`` alone
    gives dimensions, ``--`` ends the arguments.  Region sizes follow from the voxels a label, or
    those from the sizes."""
    given: dict = {}
    for part in text.removeprefix("+synth").split("--")[0].strip("_").split("_"):
        if m := re.fullmatch(r"d?(\d+)x(\d+)x(\d+)", part):
            given["dims"] = tuple(map(int, m.groups()))
        elif m := re.fullmatch(r"max(\d+)", part):
            given["most_label"] = int(m[1])
        elif m := re.fullmatch(r"l(\d+)", part):
            given["voxels_per_label"] = int(m[1])
        elif m := re.fullmatch(r"r(\d+)-(\d+)", part):
            given["low"], given["high"] = int(m[1]), int(m[2])
        elif m := re.fullmatch(r"b([\d.]+)", part):
            given["shape"] = float(m[1])
        elif m := re.fullmatch(r"s(\d+)", part):
            given["seed"] = int(m[1])
        elif part:
            raise ValueError(f"unknown part {part!r} of a synthetic volume")
    if "low" not in given and "voxels_per_label" in given:
        side = given["voxels_per_label"] ** (1 / 3)
        given["low"], given["high"] = max(1, int(0.75 * side)), max(1, int(1.25 * side))
    elif "low" in given and "voxels_per_label" not in given:
        given["voxels_per_label"] = max(1, ((given["low"] + given["high"]) // 2) ** 3)
    return Spec(**given)


#: From a face of the unit cube to its corner: sqrt(3) - 1 (fixed value).
CORNER = 0.7320508


def _draw(spec: Spec, what: int, low: int, high: int) -> Column:
    """A number in [low, high] from the region's hash."""
    return (F.lit(low) + F.pmod(F.xxhash64(F.lit(spec.seed), F.col("region"), F.lit(what)), F.lit(high - low + 1))).cast("int")


def regions(spark: SparkSession, spec: Spec) -> DataFrame:
    """region, label, size and centre on each axis (doubled, to stay whole), and roundness."""
    count = -(-spec.dims[0] * spec.dims[1] * spec.dims[2] // spec.voxels_per_label)
    base = spark.range(count).withColumnRenamed("id", "region")
    label = F.lit(1).cast("long") + F.pmod(F.xxhash64(F.lit(spec.seed), "region", F.lit(0)), F.lit(spec.most_label))
    sizes = {f"w{a}": _draw(spec, 1 + k, spec.low, spec.high) for k, a in enumerate(AXES)}
    centres = {f"o{a}": _draw(spec, 4 + k, 0, d - 1) for k, (a, d) in enumerate(zip(AXES, spec.dims))}
    round_ = _draw(spec, 7, 0, 999) / 1000.0 + 2.0 * (spec.shape - 0.5)
    return base.withColumn("label", label).withColumns(sizes | centres).withColumn("roundness", round_)


def volume(spark: SparkSession, text: str | Spec) -> Volume:
    spec = parse(text) if isinstance(text, str) else text
    width, height, depth = spec.dims
    x, y, z = unlinear(F.col("id"), width, height)
    cell = max(8, spec.high)
    grid = spark.range(width * height * depth).select(x.alias("x"), y.alias("y"), z.alias("z"))
    grid = grid.withColumns({f"g{a}": F.call_function("div", F.col(a).cast("long"), F.lit(cell).cast("long")) for a in AXES})
    painted = regions(spark, spec)
    for a, d in zip(AXES, spec.dims):
        lo = F.floor(F.greatest(F.col(f"o{a}") - F.col(f"w{a}"), F.lit(0)) / cell)
        hi = F.floor(F.least(F.col(f"o{a}") + F.col(f"w{a}"), F.lit(d - 1)) / cell)
        painted = painted.withColumn(f"g{a}", F.explode(F.sequence(lo, hi)))
    # box (every axis inside) for a roundness under 0, ellipsoid grown by it otherwise
    gaps = [F.abs(F.col(a) - F.col(f"o{a}")) / (F.col(f"w{a}") / 2.0) for a in AXES]
    reach = F.greatest(F.col("roundness"), F.lit(-1.0)) * CORNER + 1.0
    inside = F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]) < reach
    bounded = (gaps[0] <= 1.0) & (gaps[1] <= 1.0) & (gaps[2] <= 1.0)
    hits = grid.join(painted, [f"g{a}" for a in AXES]).where(inside & bounded)
    last = hits.groupBy(*AXES).agg(F.max_by("label", "region").alias("label"))
    full = grid.select(*AXES).join(last, list(AXES), "left")
    return Volume(full.select(*AXES, F.coalesce("label", F.lit(0).cast("long")).alias("label")), width, height, depth)
