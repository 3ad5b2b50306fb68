"""The brick cache as tables: requests, provisioning by level, slots, and detail admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def requests(state: DataFrame, wanted: DataFrame, fill_rate: float) -> DataFrame:
    """state (brick_idx, current_lod, slot) against wanted (brick_idx, requested_lod, visible): which
    bricks are released and which allocated.  A full cache forces releases; under 75 % a brick with
    nothing new to allocate stays."""
    joined = state.join(wanted, "brick_idx", "full")
    asked = F.coalesce("visible", F.lit(False)) & F.col("requested_lod").isNotNull()
    allocate = asked & ~F.col("requested_lod").eqNullSafe(F.col("current_lod"))
    leave = F.col("slot").isNotNull() & (~asked | allocate)
    lazy = ~allocate & F.lit(fill_rate < 0.75)
    return joined.select("brick_idx", "current_lod", "requested_lod", "slot", (leave & ~lazy).alias("released"), allocate.alias("allocated"))


def provision(demand: DataFrame, capacity: int) -> DataFrame:
    """demand (lod, requested, free): new blocks a level, their first element and how many are granted.
    A block of inverse level l takes 8^(l - 1) elements; what does not fit is cut to whole blocks.
    One row a level, so the running sum is tiny."""
    size = F.pow(F.lit(8.0), F.greatest(F.col("lod") - 1, F.lit(0))).cast("long")
    new = F.greatest(F.col("requested") - F.col("free"), F.lit(0)).cast("long")
    sized = demand.withColumn("block", size).withColumn("new_blocks", new)
    before = Window.orderBy("lod").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("new_blocks") * F.col("block")).over(before), F.lit(0).cast("long"))
    fits = F.floor(F.greatest(F.lit(capacity) - F.col("start"), F.lit(0)) / F.col("block")).cast("long")
    return sized.withColumn("start", start).withColumn("granted", F.least("new_blocks", fits)).select("lod", "block", "new_blocks", "start", "granted")


def assign(allocated: DataFrame, provisioned: DataFrame) -> DataFrame:
    """(brick_idx, lod, offset) of the granted bricks, in brick order within a level.  Bricks are ranked
    inside runs of 65536 indices; of a level only the runs' counts meet in one window."""
    run = allocated.withColumn("_run", F.shiftright(F.col("brick_idx").cast("long"), 16))
    before = Window.partitionBy("lod").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = run.groupBy("lod", "_run").agg(F.count("*").alias("_n")).select("lod", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("lod", "_run").orderBy("brick_idx")) - 1
    joined = run.withColumn("_r", rank).join(runs, ["lod", "_run"]).withColumn("_k", F.col("_base") + F.col("_r"))
    joined = joined.join(F.broadcast(provisioned), "lod").where("_k < granted")  # a row a level
    return joined.select("brick_idx", "lod", (F.col("start") + F.col("_k") * F.col("block")).alias("offset"))


def clear(state: DataFrame, lods: int) -> DataFrame:
    """The state after a hard reset: no brick has a slot, all are at the level past the coarsest."""
    return state.withColumn("current_lod", F.lit(lods).cast("int")).withColumn("slot", F.lit(None).cast("long"))


def admit_details(asked: DataFrame, capacity: int) -> DataFrame:
    """asked (brick_idx, size), repeats collapse: bricks in ascending order join while they fit; one that
    does not is skipped.  The walk depends on every earlier choice, so it runs as one fold over the
    frame's request list, which the request buffer bounds."""
    items = F.sort_array(F.collect_set(F.struct("brick_idx", "size")))
    empty = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<brick_idx:bigint,offset:bigint,size:bigint>>").alias("taken"))

    def step(acc, x):
        size = x["size"].cast("long")
        fits = acc["total"] + size <= capacity
        entry = F.array(F.struct(x["brick_idx"].cast("long").alias("brick_idx"), acc["total"].alias("offset"), size.alias("size")))
        return F.struct(F.when(fits, acc["total"] + size).otherwise(acc["total"]).alias("total"), F.when(fits, F.concat(acc["taken"], entry)).otherwise(acc["taken"]).alias("taken"))

    return asked.agg(F.aggregate(items, empty, step)["taken"].alias("t")).select(F.explode("t").alias("t")).select("t.*")


def memory(bricks: DataFrame, used: int, capacity: int) -> DataFrame:
    """Bytes of the encoding, cache size and use, and fill rate."""
    size = F.octet_length("ops") + F.octet_length("detail") + 8 * F.size("palette") + 4 * F.size("starts")
    return bricks.agg((F.sum(size) / 1e6).alias("mem_encoding_mb")).withColumn("mem_cache_mb", F.lit(capacity / 1e6)).withColumn("mem_cache_used_mb", F.lit(used / 1e6)).withColumn("mem_cache_fillrate", F.lit(used / capacity if capacity else 0.0))
