"""Chunked volumes: unions at offsets, and new chunk sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spacefill import div
from ..volume import AXES, Volume


def stitch(chunks: list[tuple[Volume, tuple[int, int, int]]]) -> Volume:
    """Chunks at voxel offsets as one volume; its extent is the farthest on each axis."""
    moved = [v.df.select(*[(F.col(a) + o).cast("int").alias(a) for a, o in zip(AXES, offset)], "label") for v, offset in chunks]
    dims = [max(o[k] + v.dims[k] for v, o in chunks) for k in range(3)]
    return Volume(reduce(DataFrame.unionByName, moved), *dims)


def rechunk(df: DataFrame, old: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """Rows (cx, cy, cz, ux, uy, uz, label) of one chunking under another: recomputed keys, no assembly."""
    whole = {f"_{a}": F.col(f"c{a}") * s + F.col(f"u{a}") for a, s in zip(AXES, old)}
    df = df.withColumns(whole)
    cells = [div(f"_{a}", s).cast("int").alias(f"c{a}") for a, s in zip(AXES, new)]
    places = [(F.col(f"_{a}") % s).cast("int").alias(f"u{a}") for a, s in zip(AXES, new)]
    return df.select(*cells, *places, "label")
