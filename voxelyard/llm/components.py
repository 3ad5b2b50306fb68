"""Connected components of a link table (distributed union-find).

``components`` takes DataFrame functions only: alternating large-star and small-star steps, each an
aggregation with map-side partials and a join of links of 16 bytes.  ``forest`` first lets every task
join the links that it holds (at most ``TASK_LINKS``) into stars, so that a table of no more links is
settled by that alone; beyond it the stars go through the same steps.  Every pair of steps is written
to the shared folder, which bounds the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Links that one task joins, 16 bytes each.
TASK_LINKS = 1 << 20


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and those hang on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v; each node's chosen neighbours are tied to the least of them and itself."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = around.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _steps(edges: DataFrame) -> DataFrame:
    while not _settled(edges):
        edges = materialize(_star(_star(edges, True), False), "stars")
    return edges


def _edges(links: DataFrame, a: str, b: str) -> DataFrame:
    return links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every linked node; comp is the least node of its component."""
    return _named(_steps(materialize(_edges(links, a, b).distinct(), "edges")))


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (u, v), u > v, of the links of one task."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        first = x
        while (y := above.get(x, x)) != x:
            x = y
        while first != x:
            above[first], first = x, above[first]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(u), top(v)
            if x != y:
                above[max(x, y)] = min(x, y)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["u", "v"])


def forest(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """As ``components``, of a written table of links."""
    tasks = -(-links.count() // TASK_LINKS)
    stars = _edges(links, a, b)
    stars = materialize((stars.coalesce(1) if tasks <= 1 else stars.repartition(tasks, "v")).mapInArrow(_join, "u long, v long"), "stars")
    return _named(stars if tasks <= 1 else _steps(stars.distinct()))
