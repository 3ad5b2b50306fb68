"""A labelled volume as a relation ``(x, y, z, label)`` with its dimensions.

Labels are longs (unsigned 32-bit in files); absent voxels are absent rows.  Everything here is a
projection or filter, so Catalyst pushes it to the scan; bricks are derived columns that later
aggregations use as partitioning key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.spacefill import div, linear, morton3d, unlinear

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Volume:
    df: DataFrame
    width: int
    height: int
    depth: int

    @property
    def dims(self) -> tuple[int, int, int]:
        return self.width, self.height, self.depth

    def _with(self, df: DataFrame, dims: tuple[int, int, int] | None = None) -> Volume:
        return Volume(df, *(dims or self.dims))

    def with_index(self, name: str = "i") -> Volume:
        return self._with(self.df.withColumn(name, linear("x", "y", "z", self.width, self.height)))

    def with_morton(self, name: str = "morton") -> Volume:
        return self._with(self.df.withColumn(name, morton3d("x", "y", "z", max(1, max(self.dims).bit_length()))))

    def bricks(self, size: int) -> tuple[int, int, int]:
        return tuple((d - 1) // size + 1 for d in self.dims)

    def with_brick(self, size: int) -> Volume:
        """Adds bx, by, bz and the linear brick_idx."""
        nx, ny, _ = self.bricks(size)
        cells = {f"b{a}": div(a, size).cast("int") for a in AXES}
        return self._with(self.df.withColumns(cells).withColumn("brick_idx", linear("bx", "by", "bz", nx, ny)))

    def clip(self, low: tuple[int, int, int], high: tuple[int, int, int], brick: int | None = None) -> Volume:
        """Voxels with low <= p < high; with ``brick`` also the implied range of brick columns, which
        prunes the files of a volume stored by brick."""
        keep: Column = F.lit(True)
        for a, lo, hi in zip(AXES, low, high):
            keep = keep & (F.col(a) >= lo) & (F.col(a) < hi)
            if brick:
                keep = keep & (F.col(f"b{a}") >= lo // brick) & (F.col(f"b{a}") <= (hi - 1) // brick)
        return self._with(self.df.where(keep))

    def flip(self, *axes: str) -> Volume:
        size = dict(zip(AXES, self.dims))
        return self._with(self.df.withColumns({a: (F.lit(size[a] - 1) - F.col(a)).cast("int") for a in axes}))

    def transpose(self, order: tuple[str, str, str]) -> Volume:
        """The axes in a new order: the new x is the old ``order[0]``, and so on."""
        size = dict(zip(AXES, self.dims))
        rest = [c for c in self.df.columns if c not in AXES]
        df = self.df.select(*[F.col(o).alias(a) for a, o in zip(AXES, order)], *rest)
        return self._with(df, tuple(size[o] for o in order))

    def reshape(self, width: int, height: int, depth: int) -> Volume:
        """The same voxels in memory order under other dimensions (not a transposition)."""
        i = linear("x", "y", "z", self.width, self.height)
        rest = [c for c in self.df.columns if c not in AXES]
        x, y, z = unlinear(F.col("_i"), width, height)
        return self._with(self.df.withColumn("_i", i).select(x.alias("x"), y.alias("y"), z.alias("z"), *rest), (width, height, depth))

    def resize(self, width: int, height: int, depth: int, fill: int = 0) -> Volume:
        """Crops or extends to new dimensions; new voxels get ``fill``."""
        spark = self.df.sparkSession
        x, y, z = unlinear(F.col("id"), width, height)
        grid = spark.range(width * height * depth).select(x.alias("x"), y.alias("y"), z.alias("z"))
        kept = self.clip((0, 0, 0), (width, height, depth)).df.select(*AXES, "label")
        return self._with(grid.join(kept, list(AXES), "left").withColumn("label", F.coalesce("label", F.lit(fill).cast("long"))), (width, height, depth))

    def clamped(self, dx: int, dy: int, dz: int) -> DataFrame:
        """Each voxel's neighbour at an offset, clamped to the volume: x, y, z, label, other."""
        at = {a: F.least(F.greatest(F.col(a) + d, F.lit(0)), F.lit(s - 1)).cast("int") for a, d, s in zip(AXES, (dx, dy, dz), self.dims)}
        left = self.df.select(*AXES, "label", *[c.alias(f"_{a}") for a, c in at.items()])
        right = self.df.select(*[F.col(a).alias(f"_{a}") for a in AXES], F.col("label").alias("other"))
        return left.join(right, [f"_{a}" for a in AXES], "left").select(*AXES, "label", "other")
