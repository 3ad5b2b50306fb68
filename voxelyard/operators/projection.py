"""Axis-aligned projection: first hits, label changes and compositing along rays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RAYS = {"x": ("y", "z"), "y": ("x", "z"), "z": ("x", "y")}


def first_hit(voxels: DataFrame, axis: str = "z", more: tuple[str, ...] = ()) -> DataFrame:
    """Nearest voxel of each ray: ray coordinates, depth, label and further columns.  A least struct
    with map-side partials."""
    rays, carried = RAYS[axis], ("depth", "label", *more)
    nearest = F.min(F.struct(F.col(axis).alias("depth"), *carried[1:])).alias("h")
    return voxels.groupBy(*rays).agg(nearest).select(*rays, *[f"h.{c}" for c in carried])


def label_changes(voxels: DataFrame, axis: str = "z") -> DataFrame:
    """Voxels whose label differs from the one before on the ray (the first always counts)."""
    order = Window.partitionBy(*RAYS[axis]).orderBy(axis)
    marked = voxels.withColumn("_before", F.lag("label").over(order))
    return marked.where(F.col("_before").isNull() | (F.col("_before") != F.col("label"))).drop("_before")


def composite(voxels: DataFrame, alpha: Column, axis: str = "z") -> DataFrame:
    """Front-to-back transparency of each ray: ray, steps, throughput.  The product runs in ray order
    over the ray's own hits, which a volume's depth bounds."""
    rays = RAYS[axis]
    hits = label_changes(voxels, axis).select(*rays, F.struct(F.col(axis).alias("d"), alpha.cast("double").alias("a")).alias("h"))
    grouped = hits.groupBy(*rays).agg(F.sort_array(F.collect_list("h")).alias("hits"))
    through = F.aggregate("hits", F.lit(1.0), lambda t, h: t * (1.0 - h["a"]))
    return grouped.select(*rays, F.size("hits").cast("long").alias("steps"), through.alias("throughput"))


def transparency(voxels: DataFrame, alpha: Column, axis: str = "z") -> DataFrame:
    """Throughput after each voxel of a ray: exp of the running sum of log1p(-alpha), alpha < 1."""
    order = Window.partitionBy(*RAYS[axis]).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return voxels.withColumn("throughput", F.exp(F.sum(F.log1p(-alpha)).over(order)))


def pack_gbuffer(label: Column, axis: Column, negative: Column, depth: Column) -> Column:
    """48 bits: 32 of label over 13 of depth, one of sign, two of axis."""
    low = axis.cast("long").bitwiseOR(F.shiftleft(negative.cast("long"), 2))
    scaled = F.floor(F.least(F.greatest(depth, F.lit(0.0)), F.lit(0.9998)) * 8192).cast("long")
    return F.shiftleft(label.cast("long"), 16).bitwiseOR(F.shiftleft(scaled, 3)).bitwiseOR(low)


def unpack_gbuffer(packed: Column) -> dict[str, Column]:
    return {
        "label": F.shiftright(packed, 16),
        "axis": packed.bitwiseAND(F.lit(3)).cast("int"),
        "negative": F.shiftright(packed, 2).bitwiseAND(F.lit(1)) == 1,
        "depth": F.shiftright(packed, 3).bitwiseAND(F.lit(8191)) / 8192.0,
    }
