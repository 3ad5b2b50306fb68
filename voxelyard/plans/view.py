"""The engine's main plan: a volume, its attributes and materials to a projected image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.labels import gather, small
from ..operators.materials import Material, classify
from ..operators.projection import first_hit
from ..volume import Volume


def visible_voxels(volume: Volume, table: DataFrame, columns: list[str], materials: list[Material]) -> DataFrame:
    """Voxels with a material: one scan, joined with the labels that have one."""
    classified = table.select("label", *columns).withColumn("material", classify(materials))
    return volume.df.join(small(classified.where("material >= 0").select("label", "material")), "label").select("x", "y", "z", "label", "material")


def image(volume: Volume, table: DataFrame, columns: list[str], materials: list[Material], axis: str = "z") -> DataFrame:
    """First visible voxel of each ray with its material."""
    return first_hit(visible_voxels(volume, table, columns, materials), axis, ("material",))


def material_histogram(volume: Volume, table: DataFrame, columns: list[str], materials: list[Material]) -> DataFrame:
    return image(volume, table, columns, materials).groupBy("material").agg(F.count("*").alias("pixels"))


__all__ = ["gather", "image", "material_histogram", "visible_voxels"]
