"""Compressed volumes as folders: a brick table and what is needed to read it, both Parquet."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..volume import Volume
from . import bricks as B


def save(volume: Volume, path: str, side: int = 32, mode: str = "nibble", mask: str = "o", every: int = 8, overwrite: bool = False) -> dict:
    """Encodes and writes a volume.  Range-ANS modes count symbols first, on every ``every``-th brick an
    axis; symbols that this sample misses count once."""
    spark, tables = volume.df.sparkSession, None
    if mode.startswith("rans"):
        tables = np.maximum(B.symbol_counts(B.encode(volume, side, "nibble", mask), every), 1)
    info = {"dims": list(volume.dims), "side": side, "mode": mode, "mask": mask, "tables": None if tables is None else tables.tolist()}
    how = "overwrite" if overwrite else "errorifexists"
    B.encode(volume, side, mode, mask, tables).write.mode(how).parquet(f"{path}/bricks")
    spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode(how).parquet(f"{path}/layout")
    return info


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The brick table and its description."""
    info = json.loads(spark.read.parquet(f"{path}/layout").first().info)
    return spark.read.parquet(f"{path}/bricks"), info


def volume(spark: SparkSession, path: str) -> Volume:
    bricks, info = load(spark, path)
    tables = None if info["tables"] is None else np.array(info["tables"])
    return Volume(B.decode(bricks, tuple(info["dims"]), info["side"], info["mode"], info["mask"], tables), *info["dims"])
