"""Labels and attributes: dense ids, relabelling, attribute joins and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spacefill import div, morton3d
from ..volume import AXES, Volume

#: Rows of a dimension table that may be broadcast; larger ones are joined by shuffle.
MOST_BROADCAST = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """The table as a broadcast side if it is small enough (counted up to the bound), else as it is."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def first_appearance(volume: Volume, chunk: tuple[int, int, int] | None = None, low: int | None = None) -> DataFrame:
    """(label, csgv_id): ids from 0 by the first position on the Z-curve - of chunks, then of voxels
    in the chunk; or on the Z-curve of the ``low`` least bits of each axis, and where these are alike on
    that of the others.  Labels are ranked inside runs of 4096 positions, which hold that many at most; only
    the runs' counts pass the global window."""
    bits = max(1, max(volume.dims).bit_length())
    if chunk:
        at = [div(a, c) for a, c in zip(AXES, chunk)]
        inner = max(1, max(chunk).bit_length())
        place = F.shiftleft(morton3d(*at, bits), 3 * inner).bitwiseOR(morton3d(*[F.col(a) % c for a, c in zip(AXES, chunk)], inner))
    else:
        place = morton3d("x", "y", "z", bits)
        if low and low < bits:
            place = F.shiftleft(place.bitwiseAND(F.lit((1 << 3 * low) - 1)), 3 * (bits - low)).bitwiseOR(F.shiftright(place, 3 * low))
    first = volume.df.groupBy("label").agg(F.min(place).alias("first")).withColumn("run", F.shiftright("first", 12))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = first.groupBy("run").agg(F.count("*").alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("run").orderBy("first")) - 1
    return first.withColumn("_r", rank).join(runs, "run").select("label", (F.col("base") + F.col("_r")).cast("long").alias("csgv_id"))


def dummy_attributes(volume: Volume) -> DataFrame:
    """The table of a volume without a database: its one attribute is the label's own id, whose range
    is that of 32 bits whatever the volume holds."""
    ids = volume.df.select("label").distinct()
    return ids.select("label", F.col("label").alias("csgv_id"), F.lit(0.0).alias("lo"), F.lit(float(2**32 - 1)).alias("hi"))


def attribute_vectors(table: DataFrame, column: str, run: int = 4096) -> DataFrame:
    """(run, first_id, values): an attribute in the order of ids, in runs of ``run`` ids, so that no task holds
    more; missing values read 0."""
    entry = F.struct("csgv_id", F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("v"))
    grouped = table.groupBy(div("csgv_id", run).alias("run")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return grouped.select("run", F.get("e", F.lit(0))["csgv_id"].alias("first_id"), F.transform("e", lambda x: x["v"]).alias("values"))


def remap_strict(volume: Volume, mapping: DataFrame) -> Volume:
    """Every label replaced through (label, csgv_id); a label without entry raises when it is read."""
    joined = volume.df.join(small(mapping), "label", "left")
    value = F.coalesce("csgv_id", F.raise_error(F.concat(F.lit("no mapping for label "), F.col("label").cast("string"))).cast("long"))
    return volume._with(joined.select(*AXES, value.alias("label")))


def relabel(volume: Volume, table: DataFrame, default: int = 0) -> Volume:
    """Labels through (id, type); those without entry become ``default``."""
    ids = table.select(F.col("id").cast("long").alias("label"), F.col("type").cast("long").alias("_type"))
    return volume._with(volume.df.join(small(ids), "label", "left").select(*AXES, F.coalesce("_type", F.lit(default).cast("long")).alias("label")))


def attribute_table(labels: DataFrame, attributes: DataFrame, label: str) -> DataFrame:
    """labels (label, csgv_id) LEFT JOIN attributes: csgv_id, label, then the other columns in order."""
    rest = [c for c in attributes.columns if c.lower() != label.lower()]
    right = attributes.select(F.col(label).cast("long").alias("label"), *rest)
    return labels.join(right, "label", "left").select("csgv_id", "label", *rest)


def with_defaults(table: DataFrame, columns: list[str]) -> DataFrame:
    """Attributes as queries read them: doubles, 0 where missing."""
    return table.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def gather(volume: Volume, table: DataFrame, columns: list[str], key: str = "label") -> DataFrame:
    """Voxels with attributes of their label; missing ones read 0."""
    return with_defaults(volume.df.join(small(table.select(F.col(key).alias("label"), *columns)), "label", "left"), columns)


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(F.col(key).cast("long").alias("label")).agg(F.count("*").alias("n")).where("n > 1")


def attribute_ranges(table: DataFrame, columns: list[str]) -> DataFrame:
    """(attribute, lo, hi): one scan for all columns; nulls are skipped, all-null columns give 0."""
    low_high = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))]
    ranges = F.array(*[F.struct(F.lit(c).alias("attribute"), F.coalesce(f"lo_{c}", F.lit(0.0)).alias("lo"), F.coalesce(f"hi_{c}", F.lit(0.0)).alias("hi")) for c in columns])
    return table.agg(*low_high).select(F.explode(ranges).alias("r")).select("r.*")


def integral_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """(attribute, kind): INTEGER where every value equals its floor, else REAL."""
    whole = [F.bool_and(F.col(c).cast("double") == F.floor(F.col(c).cast("double"))).alias(c) for c in columns]
    kinds = F.array(*[F.struct(F.lit(c).alias("attribute"), F.when(F.coalesce(c, F.lit(True)), "INTEGER").otherwise("REAL").alias("kind")) for c in columns])
    return table.agg(*whole).select(F.explode(kinds).alias("k")).select("k.*")


def cast_integral(table: DataFrame, label: str) -> DataFrame:
    """A table of numbers with integral columns as longs and the label as a long."""
    names = [c for c in table.columns if c != label]
    kinds = {r.attribute: r.kind for r in integral_columns(table, names).collect()} if names else {}
    return table.select(F.col(label).cast("long").alias(label), *[F.col(c).cast("long" if kinds[c] == "INTEGER" else "double").alias(c) for c in names])


def label_union(volumes: list[Volume]) -> DataFrame:
    return reduce(DataFrame.unionByName, [v.df.select("label") for v in volumes]).distinct()


def volume_info(volume: Volume, chunk: tuple[int, int, int], label: str) -> DataFrame:
    names = [f"{p}_{n}" for p in ("volume", "chunk") for n in ("width", "height", "depth")]
    values = [F.lit(v).cast("int").alias(n) for n, v in zip(names, (*volume.dims, *chunk))]
    return volume.df.sparkSession.range(1).select(*values, F.lit(label).alias("label_column"))
