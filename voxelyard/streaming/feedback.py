"""The frame loop as streams: request counts, detail lookups, and running pixel means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.labels import small


def request_counts(requests: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests by event-time window and brick; state older than the watermark goes."""
    timed = requests.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "brick_idx").agg(F.count("*").alias("requests")).select(F.col("w.start").alias("start"), "brick_idx", "requests")


def with_details(requests: DataFrame, details: DataFrame) -> DataFrame:
    """Streamed requests joined with the static detail table, which alone may be broadcast: the size of a
    batch is only guessed."""
    found = small(details)
    return requests.join(found if found is not details else details.hint("merge"), "brick_idx")


def accumulate(samples: DataFrame) -> DataFrame:
    """Mean of the valid samples (px, py, epoch, value); a new epoch starts afresh."""
    return samples.where("value is not null").groupBy("epoch", "px", "py").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def upsert_state(path: str):
    """A foreachBatch sink that keeps the newest cache state a brick in a Parquet folder by epoch, so
    that a replayed epoch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def run_available(result: DataFrame, mode: str, folder: str) -> DataFrame:
    """Drains the stream's available input into Parquet files below ``folder`` and returns the table: all
    batches of an appending stream, else the last, which holds the whole result.  No row passes the driver."""
    epochs: set[int] = set()
    write = upsert_state(f"{folder}/rows")

    def sink(batch: DataFrame, epoch: int) -> None:
        write(batch, epoch)
        epochs.add(epoch)

    query: StreamingQuery = result.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = result.sparkSession
    if not epochs:
        return spark.createDataFrame([], result.schema)
    kept = sorted(epochs) if mode == "append" else [max(epochs)]
    return spark.read.schema(result.schema).parquet(*[f"{folder}/rows/epoch={e}" for e in kept])


def orbit(spark: SparkSession, frames: int = 256, radius: float = 2.0) -> DataFrame:
    """Camera poses of a full turn: frame, angle, x, z."""
    angle = F.col("id") / frames * (2 * 3.141592653589793)
    return spark.range(frames).select(F.col("id").cast("int").alias("frame"), angle.alias("angle"), (F.sin(angle) * radius).alias("x"), (F.cos(angle) * radius).alias("z"))


def smooth_pose(a: tuple[float, ...], b: tuple[float, ...], t: float) -> tuple[float, ...]:
    """Between two poses, eased in and out."""
    s = t * t * (3 - 2 * t)
    return tuple(p * (1 - s) + q * s for p, q in zip(a, b))
