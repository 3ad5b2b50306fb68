"""Statistics and checks: gradients, histograms, images, frames, rates, round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import change_key
from ..functions.scalar import bytes_per_voxel
from ..volume import AXES, Volume


def _beside(axis: str, side: int, last: int) -> Column:
    """Label of the voxel next on an axis (1) or before (-1), its own at the border, null if absent."""
    ray = Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)
    step = F.lead if side > 0 else F.lag
    found = F.when(step(axis).over(ray) == F.col(axis) + side, step("label").over(ray))
    return F.when(F.col(axis) == (last if side > 0 else 0), F.col("label")).otherwise(found)


def gradient_range(volume: Volume) -> DataFrame:
    """Least and greatest value and gradient magnitude (central differences, clamped at the borders).
    A shuffle an axis brings the voxels of a ray together; there are no joins."""
    out, squares = volume.df.select(*AXES, "label"), []
    for a, size in zip(AXES, volume.dims):
        out = out.withColumn(f"_g{a}", F.pow((_beside(a, 1, size - 1) - _beside(a, -1, size - 1)) / 2.0, F.lit(2.0)))
        squares.append(F.col(f"_g{a}"))
    size = F.sqrt(squares[0] + squares[1] + squares[2])
    return out.select("label", size.alias("g")).agg(F.min("label").alias("min_value"), F.max("label").alias("max_value"), F.min("g").alias("min_gradient"), F.max("g").alias("max_gradient"))


def histogram(df: DataFrame, value: Column, bins: int, low: float, high: float, interpolate: bool = False) -> DataFrame:
    """(bin, weight) of equal bins, clamped to the edge bins; interpolated values split between the
    bins below and above them."""
    at = (value - F.lit(low)) / F.lit(high - low) * bins
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(bins - 1)).cast("int")
    if not interpolate:
        return df.select(clamp(F.when(at < 0, F.ceil(at)).otherwise(F.floor(at))).alias("bin")).groupBy("bin").agg(F.count("*").cast("double").alias("weight"))
    part = at - F.when(at < 0, F.ceil(at)).otherwise(F.floor(at))
    both = F.array(F.struct(clamp(F.floor(at)).alias("bin"), (1.0 - part).alias("w")), F.struct(clamp(F.ceil(at)).alias("bin"), part.alias("w")))
    return df.select(F.explode(both).alias("b")).groupBy("b.bin").agg(F.sum("b.w").alias("weight"))


# CIE XYZ of linear sRGB (fixed values)
_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))


def image_rmse(a: DataFrame, b: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Root mean square of the XYZ distances of two images (px, py, r, g, b) that exceed a threshold."""
    right = b.select("px", "py", *[F.col(c).alias(f"_{c}") for c in "rgb"])
    gap = [F.col(c) - F.col(f"_{c}") for c in "rgb"]
    square = None
    for row in _XYZ:
        part = F.pow(sum((F.lit(w) * g for w, g in zip(row[1:], gap[1:])), F.lit(row[0]) * gap[0]), F.lit(2.0))
        square = part if square is None else square + part
    far = F.when(F.sqrt(square) > threshold, square).otherwise(0.0)
    return a.join(right, ["px", "py"]).agg(F.sqrt(F.sum(far) / F.count("*")).alias("rmse"), F.count("*").alias("pixels"))


def frame_summary(frames: DataFrame, value: str = "ms") -> DataFrame:
    """min, mean, population deviation, upper median, max, total and count of frame times.  The median
    is one ranked row: rows are ranked inside buckets of equal leading value, and only the buckets'
    counts pass the global window."""
    v = F.col(value)
    summary = frames.agg(F.min(v).alias("min_ms"), F.avg(v).alias("avg_ms"), F.stddev_pop(v).alias("sdv_ms"), F.max(v).alias("max_ms"), F.sum(v).alias("total_ms"), F.count("*").alias("frames"))
    bucket = F.floor(v * 16).cast("long")
    counts = frames.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    placed = counts.withColumn("_end", F.sum("n").over(Window.orderBy("bucket"))).withColumn("_all", F.sum("n").over(total))
    middle = F.call_function("div", F.col("_all"), F.lit(2).cast("long"))
    chosen = placed.where((F.col("_end") > middle) & (F.col("_end") - F.col("n") <= middle)).select("bucket", (middle - (F.col("_end") - F.col("n"))).alias("_k"))
    ranked = frames.withColumn("bucket", bucket).join(F.broadcast(chosen), "bucket").withColumn("_r", F.row_number().over(Window.partitionBy("bucket").orderBy(v)) - 1)
    median = ranked.where("_r = _k").select(v.alias("med_ms"))
    return summary.crossJoin(F.broadcast(median)).select("min_ms", "avg_ms", "sdv_ms", "med_ms", "max_ms", "total_ms", "frames")


def first_frames(frames: DataFrame, order: str, value: str = "ms", n: int = 16) -> DataFrame:
    """(slot, ms) of the first frames, 0 where there are fewer."""
    first = frames.orderBy(order).limit(n).select((F.row_number().over(Window.orderBy(order)) - 1).cast("int").alias("slot"), F.col(value).alias("_v"))
    return frames.sparkSession.range(n).select(F.col("id").cast("int").alias("slot")).join(F.broadcast(first), "slot", "left").select("slot", F.coalesce("_v", F.lit(0.0)).alias("ms"))


def extremes(samples: DataFrame, count: str = "n", x: str = "px", y: str = "py") -> DataFrame:
    """Pixels with the fewest and most samples; ties to the least (y, x)."""
    key = F.struct(count, y, x)
    other = F.struct(F.col(count), -F.col(y), -F.col(x))
    got = samples.agg(F.min(key).alias("a"), F.max_by(F.struct(count, y, x), other).alias("b"))
    return got.select(F.col(f"a.{count}").alias("min_n"), F.col(f"a.{x}").alias("min_px"), F.col(f"a.{y}").alias("min_py"), F.col(f"b.{count}").alias("max_n"), F.col(f"b.{x}").alias("max_px"), F.col(f"b.{y}").alias("max_py"))


def errors(original: Volume, other: Volume) -> DataFrame:
    """(voxels, wrong, percent): voxels that differ or are missing on one side."""
    right = other.df.select(*AXES, F.col("label").alias("_other"))
    wrong = (~F.col("label").eqNullSafe(F.col("_other"))).cast("long")
    joined = original.df.select(*AXES, "label").join(right, list(AXES), "full")
    return joined.agg(F.count("*").alias("voxels"), F.sum(wrong).alias("wrong")).withColumn("percent", 100.0 * F.col("wrong") / F.col("voxels"))


def first_errors(original: Volume, other: Volume, n: int = 8) -> DataFrame:
    """The first differing voxels, for a report."""
    right = other.df.select(*AXES, F.col("label").alias("other"))
    joined = original.df.select(*AXES, "label").join(right, list(AXES), "full")
    return joined.where(~F.col("label").eqNullSafe(F.col("other"))).orderBy("z", "y", "x").limit(n)


def difference(original: Volume, other: Volume) -> DataFrame:
    """Rows of either volume that the other lacks, with their side."""
    a, b = (v.df.select(*AXES, "label") for v in (original, other))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def compression_rate(volume: Volume, stored_bytes: Column | int) -> DataFrame:
    """voxels, labels, bytes a voxel, original and stored bytes, and their rate."""
    stored = F.lit(stored_bytes) if isinstance(stored_bytes, int) else stored_bytes
    base = volume.df.agg(F.count("*").alias("voxels"), F.count_distinct("label").alias("labels"))
    base = base.withColumn("bytes_per_voxel", bytes_per_voxel(F.col("labels"))).withColumn("original_bytes", F.col("voxels") * F.col("bytes_per_voxel"))
    return base.withColumn("stored_bytes", stored.cast("long")).withColumn("rate", F.col("stored_bytes") / F.col("original_bytes"))


def label_count(volume: Volume, exact: bool = True) -> DataFrame:
    return volume.df.agg((F.count_distinct("label") if exact else F.approx_count_distinct("label")).alias("labels"))


def dtype_guard(df: DataFrame, column: str, low: int, high: int, lossless: bool = False) -> DataFrame:
    """The column fitted to a type's range: spread over it if the data span more (null if it must be
    ``lossless``, as spread values may merge), else shifted up or down as needed, else as it is."""
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    v, lo, hi = F.col(column).cast("double"), F.col("_lo").cast("double"), F.col("_hi").cast("double")
    scaled = F.floor((v - lo) / F.greatest(hi - lo, F.lit(1.0)) * (high - low) + low)
    fitted = F.when(hi - lo > high - low, F.lit(None) if lossless else scaled).when(lo < low, v + (low - lo)).when(hi > high, v - (hi - high)).otherwise(v)
    return df.crossJoin(F.broadcast(span)).withColumn(column, fitted.cast("long")).drop("_lo", "_hi")


def brick_keys(volume: Volume, brick: int) -> DataFrame:
    """(brick_idx, change): a key of a brick's voxels in any order, to find bricks that changed."""
    return volume.with_brick(brick).df.groupBy("brick_idx").agg(F.bit_xor(change_key(*AXES, "label")).alias("change"))
