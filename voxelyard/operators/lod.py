"""Level-of-detail pyramid: 2x2x2 modes inside bricks, constant regions, empty space.

A pyramid is shuffled once, by brick; every level then groups by keys that the brick's
partitioning already clusters, so no level adds an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spacefill import div, linear, morton3d
from ..volume import AXES, Volume

CELL = ("brick_idx", "px", "py", "pz")


def base_nodes(volume: Volume, brick: int, partitions: int | None = None) -> DataFrame:
    """Level 0: brick_idx, px, py, pz (cell coordinates in the whole grid), label, is_constant."""
    df = volume.with_brick(brick).df.select("brick_idx", *[F.col(a).alias(f"p{a}") for a in AXES], "label", F.lit(False).alias("is_constant"))
    return df.repartition(partitions, "brick_idx") if partitions else df.repartition("brick_idx")


def _winner(children: Column) -> Column:
    """Most frequent label of up to eight (child, label, ...) structs; ties go to the first child."""
    votes = F.transform(children, lambda c: F.struct(F.size(F.filter(children, lambda d: d["label"] == c["label"])).alias("n"), (-c["child"]).alias("before"), c["label"].alias("label")))
    return F.array_max(votes)["label"]


def reduce_level(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of ``level`` from those of the level below; cells without a valid child drop out.  A node
    is constant when its valid children share one label and, above the first level, are constant."""
    child = (F.col("px") % 2 + 2 * (F.col("py") % 2) + 4 * (F.col("pz") % 2)).alias("child")
    up = nodes.select("brick_idx", *[div(f"p{a}", 2).cast("int").alias(f"p{a}") for a in AXES], F.struct(child, "label", "is_constant").alias("c"))
    packed = up.groupBy(*CELL).agg(F.collect_list("c").alias("children"))
    same = F.size(F.array_distinct(F.transform("children", lambda c: c["label"]))) == 1
    deep = F.forall("children", lambda c: c["is_constant"]) if level > 1 else F.lit(True)
    return packed.select(*CELL, _winner(F.col("children")).alias("label"), (same & deep).alias("is_constant"))


def pyramid(volume: Volume, brick: int) -> Iterator[tuple[int, DataFrame]]:
    """(level, nodes) from the voxels to one node a brick."""
    nodes = base_nodes(volume, brick)
    yield 0, nodes
    for level in range(1, brick.bit_length()):
        nodes = reduce_level(nodes, level)
        yield level, nodes


def at_lod(volume: Volume, brick: int, level: int) -> DataFrame:
    return next(n for k, n in pyramid(volume, brick) if k == level)


def fill_from_parent(volume: Volume, brick: int, level: int) -> DataFrame:
    """All nodes of ``level`` in the bricks, those outside the volume with their parent's label:
    brick_idx, px, py, pz, label."""
    levels = dict(pyramid(volume, brick))
    top = max(levels)
    full = levels[top].select(*CELL, "label")
    steps = F.array(*[F.struct(F.lit(k % 2).alias("x"), F.lit(k // 2 % 2).alias("y"), F.lit(k // 4).alias("z")) for k in range(8)])
    for k in range(top - 1, level - 1, -1):
        spread = full.select("brick_idx", *[f"p{a}" for a in AXES], F.col("label").alias("above"), F.explode(steps).alias("s"))
        spread = spread.select("brick_idx", *[(2 * F.col(f"p{a}") + F.col(f"s.{a}")).cast("int").alias(f"p{a}") for a in AXES], "above")
        full = spread.join(levels[k].select(*CELL, "label"), list(CELL), "left").select(*CELL, F.coalesce("label", "above").alias("label"))
    return full


def region_mode(volume: Volume, size: int) -> DataFrame:
    """Mode of every size^3 region over its voxels, ties to the least label: bx, by, bz, label."""
    counted = volume.with_brick(size).df.groupBy("bx", "by", "bz", "label").agg(F.count("*").alias("n"))
    return counted.groupBy("bx", "by", "bz").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


def homogeneous_bricks(volume: Volume, size: int) -> DataFrame:
    """(brick_idx, label) of bricks whose voxels share one label."""
    return volume.with_brick(size).df.groupBy("brick_idx").agg(F.min("label").alias("label"), F.max("label").alias("_hi")).where("label = _hi").select("brick_idx", "label")


def brick_palette(volume: Volume, size: int) -> DataFrame:
    """Distinct labels of each brick."""
    return volume.with_brick(size).df.select("brick_idx", "label").distinct()


def visible_bricks(palette: DataFrame, visible: DataFrame) -> DataFrame:
    """Bricks with a visible label: the palettes semi-joined, never the voxels."""
    return palette.join(visible.select("label"), "label", "left_semi").select("brick_idx").distinct()


def empty_cells(volume: Volume, visible: DataFrame, size: int) -> DataFrame:
    """(cell, empty): cells of size^3 without a visible voxel."""
    nx, ny, _ = volume.bricks(size)
    seen = volume.df.join(visible.select("label", F.lit(True).alias("_seen")), "label", "left")
    cell = linear(div("x", size), div("y", size), div("z", size), nx, ny)
    return seen.groupBy(cell.alias("cell")).agg((~F.bool_or(F.coalesce("_seen", F.lit(False)))).alias("empty"))


def neighbours(nodes: DataFrame, parents: DataFrame, axis: str, brick_cells: int) -> DataFrame:
    """Each node's neighbour on one axis inside its brick: toward lower coordinates at the same
    level, toward higher ones (odd nodes) at the parent level; null outside the brick."""
    p = F.col(f"p{axis}")
    odd = p % 2 == 1
    step = F.when(odd, 1).otherwise(-1)
    inside = div(p + step, brick_cells) == div(p, brick_cells)
    inside = inside & (p + step >= 0)
    others = [f"p{a}" for a in AXES if a != axis]
    want = nodes.select(*CELL, "label", odd.alias("_odd"), inside.alias("_in"), (p + step).alias("_n"))
    low = nodes.select("brick_idx", *others, p.alias("_n"), F.col("label").alias("_same"))
    up = parents.select("brick_idx", *[F.col(c).alias(f"_u{c}") for c in ("px", "py", "pz")], F.col("label").alias("_up"))
    want = want.withColumns({f"_up{a}": div(F.col("_n") if a == axis else F.col(f"p{a}"), 2).cast("int") for a in AXES})
    joined = want.join(low, ["brick_idx", *others, "_n"], "left").join(up, ["brick_idx", *[f"_up{a}" for a in AXES]], "left")
    return joined.select(*CELL, "label", F.when(~F.col("_in"), None).when(F.col("_odd"), F.col("_up")).otherwise(F.col("_same")).alias("neighbour"))


def finest_operations(volume: Volume, brick: int) -> DataFrame:
    """The order-free part of the finest level's operations: brick_idx, px, py, pz, op - 0 parent,
    1 to 3 neighbour on x, y, z, 4 palette - of nodes whose parent is not constant."""
    levels = dict(k for k in pyramid(volume, brick) if k[0] < 2)
    nodes, parents = levels[0], levels[1]
    out = nodes.select(*CELL, "label", *[div(f"p{a}", 2).cast("int").alias(f"_q{a}") for a in AXES])
    up = parents.select("brick_idx", *[F.col(f"p{a}").alias(f"_q{a}") for a in AXES], F.col("label").alias("_parent"), F.col("is_constant").alias("_stop"))
    out = out.join(up, ["brick_idx", *[f"_q{a}" for a in AXES]]).where("not _stop")
    for a in AXES:
        out = out.join(neighbours(nodes, parents, a, brick).select(*CELL, F.col("neighbour").alias(f"_n{a}")), list(CELL))
    op = F.when(F.col("label") == F.col("_parent"), 0)
    for k, a in enumerate(AXES, 1):
        op = op.when(F.col("label") == F.col(f"_n{a}"), k)
    return out.select(*CELL, "label", op.otherwise(4).cast("int").alias("op"))


def in_brick_morton(brick: int) -> Column:
    return morton3d(*[F.col(f"p{a}") % brick for a in AXES], max(1, brick.bit_length()))


def dense_histogram(ops: DataFrame, symbols: int = 16, scale: int = 1, possible: tuple[int, ...] = ()) -> DataFrame:
    """(op, n) for all symbols; counts are scaled, and possible symbols that a sample missed count 1."""
    counted = ops.groupBy("op").agg((F.count("*") * scale).alias("n"))
    every = ops.sparkSession.range(symbols).select(F.col("id").cast("int").alias("op"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    floor = F.when(F.col("op").isin(*possible), F.greatest(n, F.lit(1).cast("long"))).otherwise(n) if possible else n
    return every.join(F.broadcast(counted), "op", "left").select("op", floor.alias("n"))


def sampled_bricks(volume: Volume, brick: int, every: int) -> Volume:
    """Every ``every``-th brick on each axis; a deterministic filter on derived brick columns."""
    df = volume.with_brick(brick).df.where((F.col("bx") % every == 0) & (F.col("by") % every == 0) & (F.col("bz") % every == 0))
    return volume._with(df.select(*AXES, "label"))


def palette_rank(ops: DataFrame, brick: int) -> DataFrame:
    """Running number of palette operations before each node of a brick, in Z order."""
    from pyspark.sql import Window

    order = Window.partitionBy("brick_idx").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    marked = ops.withColumn("m", in_brick_morton(brick))
    return marked.select("brick_idx", "m", "op", F.coalesce(F.sum((F.col("op") == 4).cast("long")).over(order), F.lit(0).cast("long")).alias("rank"))


def start_offsets(sizes: DataFrame, key: str = "brick_idx", length: str = "n") -> DataFrame:
    """Exclusive prefix sums by key.  Sums of key ranges come first, so that no task orders all rows."""
    from pyspark.sql import Window

    # bricks are ordered inside blocks of 65536 keys; one row a block passes the global window
    blocks = sizes.withColumn("_b", div(key, 65536))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("_b").agg(F.sum(length).alias("_t")).select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0).cast("long")).alias("_base"))
    inside = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(length).over(inside), F.lit(0).cast("long"))
    return blocks.withColumn("_own", own).join(F.broadcast(base), "_b").select(key, length, (F.col("_base") + F.col("_own")).alias("start"))
