"""Regions of a Jaccard metric space joined by pivots, exactly.

``settle`` takes regions in which any two partners (Jaccard distance at most ``T``) meet, and gives
the components of all links:

1. Each region names its most central member its pivot.  Every node is measured against the most
   central of its regions' pivots; within ``T`` of it, it joins the pivot's Voronoi cell, else it is
   the pivot of a cell of its own.  A cell is a star of links, so it lies in one component, and its
   radius is known.  (With ``native``, crowds of nodes that are still alone choose pivots again.)
2. A region then is a short list of cells.  Regions that hold one component are settled; of regions
   with the same cells one is joined.  Two cells can hold a link only if their pivots are as near as
   their radii and ``T`` together.  ``close_pairs`` finds such cells by recursion: pivots among the
   cells, Voronoi cells around these, and windows of the triangle inequality that replicate whatever
   lies near a border.  Regions beyond a task's bound are cut the same way by ``_divide``, as
   tables, until they fit; what no pivot can cut is joined block by block.
3. Of two such cells that are still in different components, the members near the border (by the
   triangle inequality) meet in the region of the wider one, again by ``close_pairs``: its own as
   hosts, the replicas of the other's as guests, which need no test among themselves.  (With
   ``native``, of every two components the pair that is nearest by key bits is measured first, and
   the others are listed only where the components are still apart.)

Only links between different components are looked for, which loses no component.  No list of all
pairs of a region is ever written: tables hold members, cells, and the pairs that come near.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import components, forest

#: Jaccard distance of partners, at most.
T = 0.25
#: Cells, and keys, that one task joins at once.
BLOCK, BLOCK_KEYS = 4096, 1 << 20
#: Members that a recursion measures against each other without further pivots, and pivots it takes.
LEAF, PIVOTS = 32, 16
#: Pivots of a region that is cut as a table.
CUTS = 32
#: Nodes of a region in no cell of another's, from which on they choose pivots anew, and how often.
CROWD, ROUNDS = 32, 2
#: Longs of the key bits that spare most exact distances, and longs that they are folded to for the first
#: look; powers of two.  A bit is the parity of the keys at its place, so that keys of both sides cancel
#: out and what differs shows however many keys there are in common.
BITS, FOLDS = 16, 16
_EPS = 1e-12
#: So that sets without a common key, at distance 1, lie in no cell of each other.
_STRICT = 1e-9


class Points:
    """Sets of keys as rows, with their size, radius and colour (points of one colour need no test,
    nor do guests among themselves)."""

    def __init__(self, keys: list[np.ndarray], size: np.ndarray, radius: np.ndarray, colour: np.ndarray, guest: np.ndarray):
        self.size, self.radius, self.colour, self.guest = size.astype(np.float64), radius, colour, guest
        edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
        _, ids = np.unique(np.concatenate(keys) if len(keys) else np.empty(0, np.int64), return_inverse=True)
        self.keys = [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]
        self.width = int(ids.max()) + 1 if len(ids) else 0

    def distances(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Exact Jaccard distances, a row for each of ``rows``."""
        both = np.zeros((len(rows), len(others)))
        few = max(1, (1 << 22) // max(1, self.width))
        for first in range(0, len(rows), few):
            part = rows[first : first + few]
            mark = np.zeros((len(part), self.width), np.float32)
            for k, r in enumerate(part):
                mark[k, self.keys[r]] = 1
            for j, o in enumerate(others):
                both[first : first + few, j] = mark[:, self.keys[o]].sum(axis=1, dtype=np.float64)
        return 1 - both / np.maximum(1, self.size[rows][:, None] + self.size[others][None, :] - both)


def close_pairs(points: Points, reach: float = T, counts: dict | None = None) -> list[tuple[int, int, float]]:
    """(i, j, distance), i < j, of all points of different colours whose distance is at most the sum of
    their radii and ``reach``; ``counts`` counts the regions that were cut."""
    found: dict[tuple[int, int], float] = {}

    def leaf(rows: np.ndarray) -> None:
        guest = points.guest[rows]
        hosts = rows[~guest]
        names, times = np.unique(points.colour[hosts], return_counts=True)
        # hosts of the main colour need no test among themselves
        asking = rows[guest] if len(names) == 1 else rows[guest | (points.colour[rows] != names[np.argmax(times)])]
        for first in range(0, len(asking), 256):
            some = asking[first : first + 256]
            d = points.distances(some, hosts)
            near = d <= points.radius[some][:, None] + points.radius[hosts][None, :] + reach + _EPS
            near &= points.colour[some][:, None] != points.colour[hosts][None, :]
            for a, b in zip(*np.nonzero(near)):
                i, j = int(some[a]), int(hosts[b])
                found[min(i, j), max(i, j)] = float(d[a, b])

    stack = [np.arange(len(points.size))]
    while stack:
        rows = stack.pop()
        if len(rows) < 2 or points.guest[rows].all() or (points.colour[rows] == points.colour[rows[0]]).all():
            continue
        if len(rows) <= LEAF:
            leaf(rows)
            continue
        window = points.radius[rows] + points.radius[rows].max() + reach + _EPS
        limit = 1 - window.max() - _STRICT
        d = points.distances(rows[:1], rows)
        while len(d) < PIVOTS and d.min(axis=0).max() >= limit:  # the next pivot is the farthest from all
            d = np.vstack([d, points.distances(rows[[int(np.argmax(d.min(axis=0)))]], rows)])
        # y within the limit, in the cell of p, and x beyond it: d(x, p) <= d(x, nearest) + 2 d(x, y),
        # and d(x, p) <= limit + d(x, y); whatever is farther from all pivots than the limit is a cell too
        nearest = d.min(axis=0)
        inside = (d <= nearest + 2 * window) & (d < limit + window)
        parts = [rows[m] for m in [*inside, nearest >= limit - window] if m.any()]
        if max(map(len, parts)) > 0.8 * len(rows) or sum(map(len, parts)) > 2 * len(rows):
            leaf(rows)
        else:
            if counts is not None:
                counts["cut"] = counts.get("cut", 0) + 1
            stack += parts
    return [(i, j, d) for (i, j), d in found.items()]


def _read_points(part: pa.Table) -> Points:
    lists = part["keys"].combine_chunks()
    values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return Points([values[a:b] for a, b in zip(at[:-1], at[1:])], part["size"].to_numpy(), part["radius"].to_numpy(), part["colour"].to_numpy(), part["guest"].to_numpy(zero_copy_only=False))


def _join_block(part: pa.Table) -> pa.Table:
    points, cell = _read_points(part), part["cell"].to_numpy()
    pairs = close_pairs(points)
    i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    a, b = cell[i], cell[j]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "d": np.array([p[2] for p in pairs], np.float64)})


def _measure(part: pa.Table) -> pa.Table:
    """Of one block of a region, with the region's pivots: its cells' distances to them."""
    points, kind = _read_points(part), part["pivot"].to_numpy()
    rows, pivots = np.flatnonzero(kind < 0), np.flatnonzero(kind >= 0)
    pivots = pivots[np.argsort(kind[pivots], kind="stable")]
    d = points.distances(pivots, rows).T
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, len(pivots)), pa.int32()), pa.array(d.reshape(-1)))
    table = part.select(["region", "cell", "radius", "colour", "guest"]).take(pa.array(rows))
    return table.append_column("d", lists)


def _blocked(rows: DataFrame, loads: DataFrame) -> DataFrame:
    """(.., block, blocks) of each row of a region; a block is what a task holds."""
    rows = rows.join(loads.select("region", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("load") / BLOCK_KEYS)).cast("int").alias("blocks")), "region")
    return rows.withColumn("block", F.pmod(F.xxhash64("cell", F.lit(7)), "blocks").cast("int"))


def _loads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.sum("load").alias("load"), F.max("radius").alias("widest"))


def _divide(rows: DataFrame, loads: DataFrame, sets: DataFrame, turn: int) -> tuple[DataFrame, DataFrame | None]:
    """Regions beyond a block, cut into Voronoi cells with their windows; and those that no pivot cuts."""
    slot = F.pmod(F.xxhash64("cell", F.lit(turn)), F.lit(CUTS)).cast("int")
    pivots = rows.groupBy("region", slot.alias("pivot")).agg(F.min(F.struct(F.xxhash64("cell", F.lit(turn + 1)).alias("h"), "cell")).alias("p")).select("region", "pivot", F.col("p.cell").alias("cell"))
    pivots = pivots.withColumn("pivot", F.row_number().over(Window.partitionBy("region").orderBy("pivot")) - 1)
    pivots = materialize(pivots, "pivots")
    blocks = _blocked(rows, loads)
    every = loads.select("region", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("load") / BLOCK_KEYS)).cast("int") - 1)).alias("block"))
    asked = pivots.join(every, "region").select("region", "block", "pivot", "cell", F.lit(0.0).alias("radius"), F.lit(0).cast("long").alias("colour"), F.lit(False).alias("guest"))
    asked = blocks.select("region", "block", F.lit(-1).alias("pivot"), "cell", "radius", "colour", "guest").unionByName(asked)
    asked = asked.join(sets.select(F.col("node").alias("cell"), "size", "keys"), "cell")
    far = materialize(asked.groupBy("region", "block").applyInArrow(_measure, "region long, cell long, radius double, colour long, guest boolean, d array<double>"), "far")
    far = far.join(loads.select("region", "n", "widest"), "region").join(rows.select("region", "cell", "load"), ["region", "cell"])
    # pivots near an earlier one are left out; then the windows of close_pairs
    limit = 1 - (2 * F.col("widest") + T + _EPS) - _STRICT
    first = far.join(pivots, ["region", "cell"]).where(F.forall(F.slice("d", F.lit(1), F.col("pivot")), lambda x: x >= limit))
    far = far.join(first.groupBy("region").agg(F.collect_set("pivot").alias("ks")), "region")
    far = far.withColumn("d", F.transform("d", lambda x, k: F.when(F.array_contains("ks", k), x))).drop("ks")
    window, nearest = F.col("radius") + F.col("widest") + T + _EPS, F.array_min("d")
    cells = F.filter(F.transform("d", lambda x, k: F.when((x <= nearest + 2 * window) & (x < limit + window), k)), lambda k: k.isNotNull())
    far = far.withColumn("cells", F.when(nearest >= limit - window, F.array_append(cells, F.lit(-1))).otherwise(cells))
    shares = far.select("region", "n", F.explode("cells").alias("k")).groupBy("region", "k").agg(F.first("n").alias("n"), F.count("*").alias("m"))
    cut = shares.groupBy("region").agg(F.sum("m").alias("replicas"), F.max("m").alias("most"), F.first("n").alias("n"))
    cut = materialize(cut.select("region", ((F.col("most") <= 0.8 * F.col("n")) & (F.col("replicas") <= 2 * F.col("n"))).alias("ok")), "cut")
    far = far.join(cut, "region")
    names = ["cell", "radius", "colour", "guest", "load"]
    parts = far.where("ok").select("region", F.explode("cells").alias("k"), *names).select(F.xxhash64("region", "k", F.lit(turn)).alias("region"), *names)
    return materialize(parts, "parts"), far.where("not ok").select("region", *names)


def close_cells(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, d) of the cells of one region and of different colours, not both guests, that come near;
    ``rows`` has (region, cell, radius, colour, guest, load)."""
    rows, blocky, turn = materialize(rows, "points"), None, 0
    while True:
        large = _loads(rows).where((F.col("n") > BLOCK) | (F.col("load") > BLOCK_KEYS))
        if large.isEmpty():
            break
        large = materialize(large, "large")
        parts, rest = _divide(rows.join(large.select("region"), "region", "left_semi"), large, sets, turn)
        rest = materialize(rest, "uncut")
        blocky = rest if blocky is None else blocky.unionByName(rest)
        rows = materialize(rows.join(large.select("region"), "region", "left_anti").unionByName(parts), "points")
        turn += 2
    schema = "a long, b long, d double"
    keyed = sets.select(F.col("node").alias("cell"), "size", "keys")
    found = rows.join(keyed, "cell").groupBy("region").applyInArrow(_join_block, schema)
    if blocky is not None:
        blocks = _blocked(blocky, _loads(blocky))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        pairs = blocks.select("region", "cell", "radius", "colour", "guest", "block", other.alias("other"))
        pairs = pairs.select("region", "cell", "radius", "colour", "guest", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        found = found.unionByName(pairs.join(keyed, "cell").groupBy("region", "lo", "hi").applyInArrow(_join_block, schema))
    return found.distinct()


def _folds(sets: DataFrame) -> dict[str, Column]:
    """The key bits of sets that have them, folded to ``FOLDS`` longs."""
    bits = [c for c in sets.columns if c.startswith("bits")]
    return {f"fold{k}": reduce(Column.bitwiseXOR, [F.col(c) for c in bits[k::FOLDS]]) for k in range(min(FOLDS, len(bits)))}


def _apart(bits: Iterable[tuple[Column, Column]]) -> Column:
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in bits), F.lit(0))


def _can_be_near(bits: Iterable[tuple[Column, Column]], n: Column, most: Column) -> Column:
    """Whether the key bits of two sets of ``n`` keys in all allow a distance of ``most``: every bit that
    differs stands for an odd number of keys of one side only, and there are n (1 - J) / (1 + J) of these."""
    return _apart(bits) * (2 - most) <= n * most + _EPS


def _listed(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Every cell beside each list that it passes, (.., m), and the names of its key bits: a region's cells
    lie in lists of at most a block each."""
    folds = _folds(sets)
    names = ["cell", "radius", "colour", "guest", "size", *folds]
    rows = rows.withColumn("load", F.lit(0)).join(sets.select(F.col("node").alias("cell"), "size", *[c.alias(n) for n, c in folds.items()]), "cell")
    rows = materialize(rows, "points")
    blocks = _blocked(rows, _loads(rows))
    lists = blocks.groupBy("region", F.col("block").alias("other")).agg(F.collect_list(F.struct(*names)).alias("m"))
    mine = blocks.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    return mine.join(lists, ["region", "other"]), folds


def _meets(y: Column, folds: Iterable[str], radius: Column) -> Column:
    """Whether a cell's guests and hosts, colour, size and key bits allow it to be near y."""
    reach = F.least(F.lit(1.0), radius + T + _EPS)
    near = (F.col("colour") != y["colour"]) & ~(F.col("guest") & y["guest"]) & (F.least("size", y["size"]) >= (1 - reach) * F.greatest("size", y["size"]))
    return near & _can_be_near(((F.col(n), y[n]) for n in folds), F.col("size") + y["size"], reach) if folds else near


def close_cells_by_lists(rows: DataFrame, sets: DataFrame, keys: Callable[[Column], Column]) -> DataFrame:
    """As ``close_cells``, in DataFrame functions only: every cell passes the lists of its region once, and
    cells whose sizes or key bits are too far apart are left out."""
    listed, folds = _listed(rows, sets)

    def meets(y: Column) -> Column:
        once = (F.col("block") < F.col("other")) | (F.col("cell") < y["cell"])
        return once & _meets(y, folds, F.col("radius") + y["radius"])

    pairs = listed.select("cell", "radius", F.explode(F.filter("m", meets)).alias("y"))
    pairs = pairs.groupBy(F.least("cell", "y.cell").alias("a"), F.greatest("cell", "y.cell").alias("b")).agg(F.max(F.col("radius") + F.col("y.radius")).alias("reach"))
    pairs = materialize(pairs, "pairs")
    return measured(pairs, sets, keys, F.least(F.lit(1.0), F.col("reach") + T), tested=True)


def nearest_cells(rows: DataFrame, sets: DataFrame, keys: Callable[[Column], Column]) -> DataFrame:
    """(a, b), colours: links between cells, whose radius is not regarded, of different colours.  Every cell
    names the one of another colour in each list that is nearest by key bits, and of two colours the
    nearest such pair is measured, so no more rows are made than cells, and not all links are found."""
    listed, folds = _listed(rows, sets)

    def far(y: Column) -> Column:
        return F.struct((_apart((F.col(n), y[n]) for n in folds) / (F.col("size") + y["size"])).alias("far"), y["cell"].alias("cell"), y["colour"].alias("colour"))

    nearest = F.array_min(F.transform(F.filter("m", lambda y: _meets(y, folds, F.lit(0.0))), far))
    pairs = listed.select("cell", "colour", nearest.alias("y")).where("y is not null")
    pair = F.struct("y.far", F.least("cell", "y.cell").alias("a"), F.greatest("cell", "y.cell").alias("b"), "colour", F.col("y.colour").alias("other"))
    pairs = pairs.groupBy(F.least("colour", "y.colour"), F.greatest("colour", "y.colour")).agg(F.min(pair).alias("p"))
    pairs = materialize(pairs.select("p.a", "p.b", "p.colour", "p.other"), "nearest")
    near = measured(pairs.select("a", "b"), sets, keys, T, tested=True)
    return pairs.join(near, ["a", "b"]).select(F.col("colour").alias("a"), F.col("other").alias("b"))


def measured(pairs: DataFrame, sets: DataFrame, keys: Callable[[Column], Column], most: float | Column = 1.0, tested: bool = False) -> DataFrame:
    """(a, b, d): the pairs (a, b) whose exact distance is at most ``most``, which may be a column of the pairs;
    only those are measured whose sizes and key bits allow it (``tested``: which is known of all of them)."""
    bits = [c for c in sets.columns if c.startswith("bits")]
    folds = _folds(sets)

    def both(pairs: DataFrame, columns: dict[str, Column]) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(side), *[c.alias(f"{side}_{n}") for n, c in columns.items()]), side)
        return pairs

    def fits(names: Iterable[str]) -> Column:
        return _can_be_near(((F.col(f"a_{n}"), F.col(f"b_{n}")) for n in names), F.col("n"), F.col("most"))

    most = most if isinstance(most, Column) else F.lit(float(most))
    n = F.col("a_size") + F.col("b_size")
    near = pairs.select("a", "b", most.alias("most"))
    if not tested:
        near = both(near, {"size": F.col("size"), **folds}).withColumn("n", n)
        near = near.where((F.least("a_size", "b_size") >= (1 - F.col("most") - _EPS) * F.greatest("a_size", "b_size")) & fits(folds)).select("a", "b", "most")
    bits = bits if len(folds) < len(bits) else []
    near = both(near, {"size": F.col("size"), "keys": F.col("keys"), **{c: F.col(c) for c in bits}}).withColumn("n", n).where(fits(bits) if bits else F.lit(True))
    inter = F.size(F.array_intersect(keys(F.col("a_keys")), keys(F.col("b_keys"))))
    if keys is _same:
        out = near.select("a", "b", "most", "n", inter.alias("inter"))
    else:
        # written, or the keys are made anew for every use of the number; and counted in a lambda, which keeps
        # them out of the join's generated method: in there they are too much for the JVM to compile
        alone = F.element_at(F.transform(F.array(inter), lambda x: x), 1)
        out = materialize(near.select("a", "b", "most", "n", alone.alias("inter")), "measured")
    out = out.select("a", "b", "most", (1 - F.col("inter") / (F.col("n") - F.col("inter"))).alias("d"))
    return out.where(F.col("d") <= F.col("most") + _EPS).select("a", "b", "d")


def with_bits(sets: DataFrame, keys: Callable[[Column], Column]) -> DataFrame:
    """(node, size, keys, bits..) of (node, keys): the number of distinct keys, and ``BITS`` longs in which
    every key flips one bit."""
    h = F.col("h")
    each = sets.select("node", F.explode(F.array_distinct(keys(F.col("keys")))).alias("k")).select("node", F.xxhash64("k").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    place = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(BITS - 1))
    bits = [F.bit_xor(F.when(place == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{k}") for k in range(BITS)]
    return sets.join(each.groupBy("node").agg(F.count("*").alias("size"), *bits), "node")


def _linked(d: Column) -> Column:
    return d <= T + _EPS


def _coloured(place: DataFrame, links: DataFrame, native: bool) -> DataFrame:
    """(node, cell, d, colour): the nodes with their component by the links so far."""
    comp = components(links) if native else forest(links)
    return materialize(place.select("node", "cell", "d").join(comp, "node", "left").withColumn("colour", F.coalesce("comp", "cell")).drop("comp"), "places")


def _merged(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the colours of a component of ``links``, (a, b) of colours, made one."""
    comp = components(links).toDF("colour", "comp")
    return rows.join(comp, "colour", "left").withColumn("colour", F.coalesce("comp", "colour")).drop("comp")


def _colours(pairs: DataFrame, place: DataFrame) -> DataFrame:
    """(a, b): the two colours of each of the pairs (a, b) of nodes."""
    for side in "ab":
        pairs = pairs.join(place.select(F.col("node").alias(side), F.col("colour").alias(f"c{side}")), side)
    return pairs.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def _same(keys: Column) -> Column:
    return keys


def _more_stars(members: DataFrame, stars: DataFrame, sets: DataFrame, keys: Callable[[Column], Column]) -> DataFrame:
    """The stars (a, b, d) with those of further rounds: where many nodes of a region are still alone, they
    choose pivots among themselves (of its regions' pivots each node the one that it shares most regions
    with), so that a group whose pivot lay apart from it does not stay a crowd of cells of one node."""
    alone, new = members.select("region", "node", "weight", F.col("hub.node").alias("tried")), stars
    for _ in range(ROUNDS):
        placed = new.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        alone = alone.where("node <> tried").drop("tried").join(placed, "node", "left_anti")
        hubs = alone.groupBy("region").agg(F.max(F.struct("weight", "node")).alias("hub"), F.count("*").alias("n")).where(F.col("n") >= CROWD)
        alone = materialize(alone.join(hubs.select("region", F.col("hub.node").alias("tried")), "region"), "alone")
        if alone.isEmpty():
            break
        shares = alone.where("node <> tried").groupBy("node", "tried").agg(F.count("*").alias("n"))
        asked = shares.groupBy("node").agg(F.max(F.struct("n", "tried")).alias("most")).select(F.col("node").alias("a"), F.col("most.tried").alias("b"))
        new = materialize(measured(asked, sets, keys, T), "more-stars")
        stars = stars.unionByName(new)
    return stars


def settle(members: DataFrame, sets: DataFrame, keys: Callable[[Column], Column] = _same, native: bool = False) -> DataFrame:
    """(node, comp) of the linked nodes; ``members`` has (region, node, weight), any two partners share
    a region; ``sets`` has (node, size, keys), where ``keys`` may be anything that the function ``keys``
    turns into the set (less the keys that no other set holds), and may come from ``with_bits``.
    ``native``: DataFrame functions only."""
    load = F.col("size").cast("long")
    close_ = (lambda rows: close_cells_by_lists(rows, sets, keys)) if native else (lambda rows: close_cells(rows, sets))
    hubs = members.groupBy("region").agg(F.max(F.struct("weight", "node")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("region", "hub")
    members = materialize(members.join(hubs, "region"), "regions")
    first = members.where("node <> hub.node").groupBy("node").agg(F.max("hub").alias("hub")).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
    stars = materialize(measured(first, sets, keys, T), "stars")
    if native:
        stars = _more_stars(members, stars, sets, keys)
    links = stars.select("a", "b")
    place = sets.select("node").join(stars.select(F.col("a").alias("node"), F.col("b").alias("cell"), "d"), "node", "left")
    place = _coloured(place.select("node", F.coalesce("cell", "node").alias("cell"), F.coalesce("d", F.lit(0.0)).alias("d")), links, native)

    # the regions as lists of cells; one of those that are alike
    cells = members.select("region", "node").join(place, "node").groupBy("region", "cell").agg(F.first("colour").alias("colour"), F.lit(False).alias("guest"))
    sign = [F.bit_xor(F.xxhash64("cell", F.lit(k))).alias(f"s{k}") for k in range(2)]
    cells = materialize(cells, "cells")
    open_ = cells.groupBy("region").agg(F.count("*").alias("n"), F.min("colour").alias("lo"), F.max("colour").alias("hi"), *sign).where("lo <> hi")
    open_ = open_.groupBy("n", "s0", "s1").agg(F.min("region").alias("region")).select("region")
    radius = place.groupBy("cell").agg(F.max("d").alias("radius"))
    rows = cells.join(open_, "region", "left_semi").join(radius, "cell").join(sets.select(F.col("node").alias("cell"), load.alias("load")), "cell")
    close = materialize(close_(rows), "close")
    more = close.where(_linked(F.col("d"))).select("a", "b")
    if close.isEmpty():
        return _result(place)
    if native:
        place = materialize(_merged(place, _colours(more, place)), "places")
    else:
        links = materialize(links.unionByName(more), "links")
        place = _coloured(place, links, native)

    # the windows of the cells that are still apart
    side = place.groupBy("cell").agg(F.max("d").alias("r"), F.first("colour").alias("colour"))
    both = close.where(~_linked(F.col("d"))).join(side.toDF("a", "ra", "ca"), "a").join(side.toDF("b", "rb", "cb"), "b").where("ca <> cb and ra + rb > 0")
    wide, thin = (f(F.struct(F.col("ra").alias("r"), F.col("a").alias("cell")), F.struct(F.col("rb").alias("r"), F.col("b").alias("cell"))) for f in (F.greatest, F.least))
    both = materialize(both.select(wide.alias("host"), thin.alias("guest"), "d"), "borders")
    if both.isEmpty():
        return _result(place)
    slack = T + _EPS
    own = both.groupBy(F.col("host.cell").alias("cell")).agg(F.min(F.col("d") - F.col("guest.r")).alias("from"))
    own = place.join(own, "cell").where(F.col("d") + slack >= F.col("from")).select(F.col("cell").alias("region"), "node", "colour", F.lit(False).alias("guest"))
    come = place.withColumnRenamed("d", "far").join(both.withColumn("cell", F.col("guest.cell")).drop("guest"), "cell").where(F.col("far") + F.col("host.r") + slack >= F.col("d"))
    near = own.unionByName(come.select(F.col("host.cell").alias("region"), "node", "colour", F.lit(True).alias("guest")))
    near = near.withColumnRenamed("node", "cell").withColumn("radius", F.lit(0.0)).join(sets.select(F.col("node").alias("cell"), load.alias("load")), "cell")
    if native:
        # two colours mostly have many pairs near their border, and one that is linked is enough
        near, found = materialize(near, "near"), materialize(nearest_cells(near, sets, keys), "colour-links")
        near, place = _merged(near, found), materialize(_merged(place, found), "places")
        near = materialize(near, "near")
        open_ = near.groupBy("region").agg(F.min("colour").alias("lo"), F.max("colour").alias("hi")).where("lo <> hi").select("region")
        more = close_(near.join(open_, "region", "left_semi")).where(_linked(F.col("d")))
        return _result(_merged(place, materialize(_colours(more, place), "colour-links")))
    links = materialize(links.unionByName(close_(near).where(_linked(F.col("d"))).select("a", "b")), "links")
    return _result(_coloured(place, links, native))


def _result(place: DataFrame) -> DataFrame:
    return place.select("node", F.col("colour").alias("comp"))
