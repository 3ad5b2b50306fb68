"""N-gram Jaccard join in the metric space of shingle sets, exact at every similarity of 3/4 or more.

Jaccard distance is a metric, but whole documents make poor first pivots: nearly all pairs lie at
distance 1, so every window would hold everything.  The first pivots are therefore the single
shingles.  For a set x, d(x, {s}) is 1 - 1/|x| where x holds s and 1 elsewhere, so the nearest
pivots of x are its own shingles; ties are broken by rarity.  A partner of x shares at least
ceil(3|x|/4) shingles with it, hence a document must be replicated to just the regions of its m -
ceil(3|x|/4) + 1 rarest shared shingles (m of its shingles occur in other documents): that window
follows from the distance bound, and any two partners meet in the region of their rarest common
shingle.  A document with fewer than ceil(3|x|/4) shared shingles has no partner and leaves at once.

Regions then join with documents as pivots: Voronoi cells around them, windows of the triangle
inequality that replicate boundary documents, and recursion (``voronoi.py``).

Shuffled keys are the upper 48 bits of the shingles' hashes.  Postings travel in compressed pieces
of one flush of one task; a shingle that occurs twice or more in a flush travels as a count and its
postings wait with the flush's documents, so a bucket gets one entry a flush of the most frequent
shingle.  Equal texts are one node, named by 64 bits of a 128-bit hash; texts whose names clash
are found beforehand and named anew.

Defined results: null and blank texts have no shingles and link with nothing; a null id takes part
but is never a component's id unless it is alone; repeated rows are equal texts; an empty table
gives no rows; other columns are ignored.  ``keep_one`` keeps one row of each component (the least
id, null last, and of repeated rows any one) and every blank text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, materialize, plus, slices, text_buffers, trim
from .shingles import shingle_sets
from .voronoi import settle

WIDTH = 5
#: Postings that a task gathers before it writes them out (some 100 bytes each meanwhile, here and
#: where they come together again), and bytes of text whose words are hashed at once (some 40 each).
FLUSH, HASHED_BYTES = 1_000_000, 1 << 19
#: Documents that a posting bucket stands for; beyond ``MANY_BUCKETS`` of them, buckets and their
#: size both grow with the square root of the input (20,000 documents for 5 * 10^10).
BUCKET_DOCS, MANY_BUCKETS = 2000, 1 << 18
#: Equal texts known beforehand to every task, at most (16 bytes each); beyond it all copies travel
#: and are united after the shuffle, with the same result.
MOST_KNOWN = 4_000_000
KEY_BITS = 48


def _hash(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_128_intdigest(text)


def _text_hashes(column, clashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(name, check) of each lower-cased text; names among ``clashes`` are mixed with the check."""
    data, at = text_buffers(column)
    raw = data.tobytes()
    both = b"".join([_hash(raw[a:b].translate(ASCII_LOWER)).to_bytes(16, "little") for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
    name, check = np.frombuffer(both, "<i8").reshape(-1, 2).T.copy()
    if clashes is not None and len(clashes):
        twin = np.isin(name, clashes)
        name[twin] ^= check[twin] * np.int64(0x5851F42D4C957F2D)
    return name, check


def _pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of the arrays, compressed; integers keep as many bytes as the largest needs."""
    import zstandard

    out = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        a = a.astype("<u8")
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T)
        out += [width.to_bytes(1, "little"), len(a).to_bytes(8, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 1, []
    for _ in range(raw[0]):
        width, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        at += 9
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T
        out.append(a.reshape(-1).view("<u8"))
        at += width * n
    return out


def _deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.uint64(0))


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col)).alias("row_key"))


def _names(docs: DataFrame, kind: str, clashes: np.ndarray | None = None) -> DataFrame:
    """(doc_id, row_key, node, check) of every row, written once."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, check = _text_hashes(batch.column(1), clashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node), pa.array(check)], ["doc_id", "row_key", "node", "check"])

    return materialize(docs.mapInArrow(name, f"doc_id {kind}, row_key long, node long, check long"), "nodes")


def _named(docs: DataFrame, kind: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The names of all rows, the texts that occur again, and the names that had clashed."""
    clashes = np.empty(0, np.int64)
    while True:
        nodes = _names(docs, kind, clashes)
        again = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("row_key").alias("row_key"), F.min("check").alias("lo"), F.max("check").alias("hi")).where("n > 1")
        again = materialize(again, "copies")
        more = [r.node for r in again.where("lo <> hi").select("node").limit(MOST_KNOWN).collect()]  # some hundred among 10^11 texts
        if not more:
            return nodes, again.select("node", "row_key"), clashes
        clashes = np.union1d(clashes, np.array(more, np.int64))


def _known_copies(again: DataFrame):
    """Broadcast (node, row_key of the row that stands for it), sorted, of the texts that occur again."""
    if again.count() > MOST_KNOWN:
        return None
    got = again.toArrow()
    a, b = (got.column(k).to_numpy() for k in range(2))
    order = np.argsort(a)
    return again.sparkSession.sparkContext.broadcast((a[order], b[order]))


def _stands(nodes: np.ndarray, keys: np.ndarray, known) -> np.ndarray:
    """Whether each row stands for its text."""
    if known is None or not len(known.value[0]):
        return np.ones(len(nodes), bool)
    again, rows = known.value
    at = np.minimum(np.searchsorted(again, nodes), len(again) - 1)
    return (again[at] != nodes) | (rows[at] == keys)


def _flushed(sets: list[np.ndarray], nodes: list[int], src: int, buckets: int) -> pa.RecordBatch:
    """The rows of one flush."""
    size = np.array([len(s) for s in sets], np.int64)
    keys = np.concatenate(sets)
    keys >>= np.uint64(64 - KEY_BITS)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    docs_at = np.repeat(np.arange(len(sets), dtype=np.uint64), size)[order]
    del order
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(np.append(start, len(keys)))
    several = np.repeat(times > 1, times)
    mine = _pack(np.array(nodes, np.int64).view(np.uint64), size.astype(np.uint64), _deltas(keys[several]), docs_at[several])
    said = np.where(times > 1, times.astype(np.uint64) * np.uint64(2) + np.uint64(1), docs_at[start] * np.uint64(2))
    keys = keys[start]
    edge = np.searchsorted((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(edge)).tolist()
    blobs = [_pack(_deltas(keys[edge[b] : edge[b + 1]]), said[edge[b] : edge[b + 1]]) for b in used]
    return pa.RecordBatch.from_arrays([pa.array([*used, -1 - src], pa.int64()), pa.array([src] * (len(used) + 1), pa.int64()), pa.array([*blobs, mine], pa.binary())], ["bucket", "src", "blob"])


def _postings(docs: DataFrame, buckets: int, known, clashes: np.ndarray) -> DataFrame:
    """(bucket, src, blob): of one flush of one task, the shingles that fall into a bucket, each with
    its document or, if it has several, with their number; and in bucket -1 - src the flush's own
    documents (node, size) and postings of the shingles with several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        src = TaskContext.get().partitionId() << 24
        sets: list[np.ndarray] = []
        nodes: list[int] = []
        held, seen = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal src, held
            yield _flushed(sets, nodes, src, buckets)
            sets.clear(), nodes.clear()
            src, held = src + 1, 0
            trim()

        for batch in batches:
            node, _ = _text_hashes(batch.column(1), clashes)
            keep = _stands(node, batch.column(2).to_numpy(), known)
            data, at = text_buffers(batch.column(1))
            for first, last in slices(at, HASHED_BYTES):
                if not keep[first:last].any():
                    continue
                for k, s in enumerate(shingle_sets(data[at[first] : at[last]], at[first : last + 1] - at[first], WIDTH), first):
                    if keep[k] and len(s) and int(node[k]) not in seen:
                        seen.add(int(node[k]))
                        sets.append(s), nodes.append(int(node[k]))
                        held += len(s)
                if held >= FLUSH:
                    seen.clear()
                    yield from flush()
        if sets:
            yield from flush()

    return docs.mapInArrow(run, "bucket long, src long, blob binary")


def _trimmed(f):
    """``f``, after which its worker gives back what it has freed."""

    def run(*args):
        try:
            return f(*args)
        finally:
            trim()

    return run


def _shared(key: tuple, part: pa.Table) -> pa.Table:
    """Of one bucket: its entries whose shingle occurs in two documents or more, by source again."""
    src = part["src"].to_numpy()
    if key[0].as_py() < 0:
        return part.select(["src", "blob"])
    keys, said, owner = [], [], []
    for k, blob in enumerate(part["blob"]):
        d, a = _unpack(blob.as_py())
        keys.append(np.cumsum(d, dtype=np.uint64)), said.append(a), owner.append(np.full(len(a), k, np.int32))
    keys, said, owner = np.concatenate(keys), np.concatenate(said), np.concatenate(owner)
    order = np.argsort(keys, kind="stable")
    keys, said, owner = keys[order], said[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    df = np.add.reduceat(np.where(said & np.uint64(1), said >> np.uint64(1), np.uint64(1)), start)
    df = np.repeat(df, np.diff(np.append(start, len(keys))))
    keep = df > 1
    keys, said, owner, df = keys[keep], said[keep], owner[keep], df[keep]
    order = np.argsort(owner, kind="stable")
    edge = np.searchsorted(owner[order], np.arange(len(src) + 1))
    used = [k for k in range(len(src)) if edge[k + 1] > edge[k]]
    blobs = []
    for k in used:
        o = order[edge[k] : edge[k + 1]]
        blobs.append(_pack(_deltas(keys[o]), said[o], df[o]))
    return pa.table({"src": pa.array(src[used], pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _survivors(part: pa.Table) -> pa.Table:
    """Of one source: the documents that share enough, their shared shingles by rarity, and all sizes."""
    own, blobs = None, []
    for blob in part["blob"]:
        arrays = _unpack(blob.as_py())
        if len(arrays) == 4:
            own = arrays
        else:
            blobs.append(arrays)
    nodes, size = own[0].view(np.int64), own[1].astype(np.int64)
    keys = np.concatenate([np.empty(0, np.uint64), *(np.cumsum(b[0], dtype=np.uint64) for b in blobs)])
    said, df = (np.concatenate([np.empty(0, np.uint64), *(b[k] for b in blobs)]) for k in (1, 2))
    several = (said & np.uint64(1)).astype(bool)
    names, counts = keys[several], df[several]
    order = np.argsort(names)
    names, counts = names[order], counts[order]
    mine = np.cumsum(own[2], dtype=np.uint64)
    keys = np.concatenate([keys[~several], mine]).view(np.int64)
    docs_at = np.concatenate([said[~several] >> np.uint64(1), own[3]]).view(np.int64)
    df = np.concatenate([df[~several], counts[np.searchsorted(names, mine)]]).view(np.int64)
    del blobs, own, said, several, names, counts, mine
    many = np.bincount(docs_at, minlength=len(nodes))
    keep = 4 * many >= 3 * size
    chosen = keep[docs_at]
    keys, docs_at, df = keys[chosen], docs_at[chosen], df[chosen]
    order = np.lexsort((keys, df, docs_at))
    kept = np.where(keep, many, 0)
    weight = np.bincount(docs_at, weights=df, minlength=len(nodes)) / np.maximum(size, 1)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(keys[order]), mask=pa.array(~keep))
    return pa.table({"node": pa.array(nodes), "size": pa.array(size), "weight": pa.array(weight), "keys": lists})


def _components(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(doc_id, row_key, node) of every row; (node, least, comp, n_shingles) of every text; clashes."""
    rows = _inputs(docs, id_col, text_col)
    nodes, again, clashes = _named(rows, rows.schema["doc_id"].dataType.simpleString())
    known = _known_copies(again)
    buckets = max(16, nodes.count() // BUCKET_DOCS)
    if buckets > MANY_BUCKETS:
        buckets = int((buckets * MANY_BUCKETS) ** 0.5)
    shared = _postings(rows, buckets, known, clashes).groupBy("bucket").applyInArrow(lambda key, part: _trimmed(_shared)(key, part), "src long, blob binary")
    found = materialize(shared.groupBy("src").applyInArrow(lambda part: _trimmed(_survivors)(part), "node long, size long, weight double, keys array<long>"), "sets")
    sizes = found.select("node", "size").dropDuplicates(["node"])
    sets = found.where("keys is not null")
    if known is None:
        sets = materialize(sets.dropDuplicates(["node"]), "distinct-sets")
    window = F.size("keys") - F.ceil(3 * F.col("size") / 4).cast("int") + 1
    comp = settle(sets.select("node", "weight", F.explode(F.slice("keys", F.lit(1), window)).alias("region")), sets)
    least = nodes.groupBy("node").agg(F.min("doc_id").alias("least"))
    texts = least.join(comp, "node", "left").join(sizes, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(0)).cast("long").alias("n_shingles"))
    return nodes, materialize(texts, "texts"), clashes


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    nodes, texts, _ = _components(docs, id_col, text_col)
    # the least document of every component; most texts are a component of their own
    ids = texts.groupBy("comp").agg(F.min("least").alias("component"), F.count("*").alias("n")).where("n > 1").select("comp", "component")
    texts = texts.join(ids, "comp", "left").select("node", "n_shingles", F.coalesce("component", "least").alias("component"))
    out = nodes.join(materialize(texts, "text-ids"), "node")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each component, with all their columns."""
    nodes, texts, clashes = _components(docs, id_col, text_col)
    rows = nodes.join(texts.where("n_shingles > 0").select("node", "comp"), "node")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    groups = rows.groupBy("comp").agg(F.min(best).alias("best"), F.count("*").alias("n")).where("n > 1").select("comp", "best")
    groups = texts.join(groups, "comp").select("node", F.col("best.doc_id").alias("best_id"), (F.col("node") == F.col("best.node")).alias("stays"))
    groups = materialize(groups, "groups")
    names, columns = [f"c{k}" for k in range(len(docs.columns))], docs.columns
    where, key = columns.index(text_col), f"c{columns.index(id_col)}"

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, _ = _text_hashes(batch.column(where), clashes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], [*names, "node"])

    plain = docs.toDF(*names)
    if dict(docs.dtypes)[text_col] != "string":
        raise ValueError("the text must be a string")
    marked = plain.mapInArrow(name, plus(plain.schema, "node long"))
    few = groups.count() <= MOST_KNOWN
    marked = marked.join(F.broadcast(groups) if few else groups, "node", "left")
    best = marked.where(F.col("stays") & F.col(key).eqNullSafe(F.col("best_id")))
    best = best.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy(F.lit(0)))).where("rn = 1")
    return marked.where("stays is null").select(names).unionByName(best.select(names)).toDF(*columns)
