"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

One scan gives every line its hash and, from ``LEAST_CHARS`` characters on, a bottom-k MinHash
signature: the ``K`` least hashes of its character shingles that start at words.  Every pair of the
K values is a band, so lines of similarity 3/4 meet in one with a probability of about 0.94, and of
0.9 with one of about 0.99.  Lines with few word starts for their length (no spaces, long tokens)
also have the ``K_WIDE`` least hashes of the shingles at all their characters, in pairs as well.
Lines of at most ``MOST_KEYS`` character shingles, which are all that a line under ``LEAST_CHARS``
can resemble, meet without loss: in the regions of their rarest shared shingles, as documents do in
the Jaccard join (of lines of ``HEAD`` characters or more, those with few word starts; a line with
many word starts and so few distinct shingles is left to its bands).
Lines that meet are verified by the exact Jaccard similarity of all their character shingles, and
regions and components are settled as in the Jaccard join: by central pivots, cross-component pairs
and distributed union-find.  Of each component, and of each group of equal lines, the occurrence
that is first by document id and line number stays.

Only hashes move; of the texts, just those of lines that share a band are fetched.

Defined results: blank lines always stay; a line under a shingle's width goes only as an exact repeat;
a null text is one blank line; a null id comes before all others; repeated rows are documents of their own, whose later
lines go; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .jaccard_join import MOST_KNOWN
from .voronoi import settle, with_bits

SPACES = " \t\x0b\x0c\r"
LEAST_CHARS = 40
#: Characters of a shingle of the signature, which starts at a word, and of one that is verified.
START_CHARS, WIDTH = 16, 5
K = 5
#: Characters of a shingle at every place, and their number, of lines with fewer distinct word starts
#: than FEW_STARTS or than one in START_CHARS characters.
WIDE_CHARS, K_WIDE, FEW_STARTS = 8, 6, 12
#: A line under LEAST_CHARS has at most LEAST_CHARS - WIDTH shingles, and a line 4/3 of them if alike.
MOST_KEYS = 4 * (LEAST_CHARS - WIDTH) // 3
#: Lines with few word starts that are longer are first counted over so many characters.
HEAD = 64


def _everywhere(line: Column, width: int) -> Column:
    return F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))


def _hashes(parts: Column) -> Column:
    return F.array_distinct(F.transform(parts, lambda x: F.xxhash64(x)))


def _parts(line: Column) -> Column:
    """Character shingles of a line; a shorter line is one shingle."""
    return F.when(F.length(line) >= WIDTH, _everywhere(line, WIDTH)).otherwise(F.array(line))


def _shingles(line: Column) -> Column:
    """Distinct character shingles of a line, as hashes."""
    return _hashes(_parts(line))


def _starts(line: Column) -> Column:
    return _hashes(F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{1,{START_CHARS}}}))[^ ]*+ ?"), F.lit(1)))


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def _pairs(signature: str, k: int) -> Column:
    """Hashes of all pairs of a signature; of the only value where there is one."""
    s = F.col(signature)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.transform(F.slice(s, i + 1, k), lambda y: F.xxhash64(F.element_at(s, i), y))))
    return F.when(F.size(s) > 1, pairs).otherwise(s)


def _lines(docs: DataFrame, id_col: str, text_col: str, rid: Column | None = None) -> DataFrame:
    """(rid, doc_id, line_no, line) with the line's ends trimmed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select((F.monotonically_increasing_id() if rid is None else rid).alias("rid"), F.col(id_col).alias("doc_id"), text.alias("_t"))
    return rows.select("rid", "doc_id", F.posexplode(F.split("_t", "\n")).alias("line_no", "_l")).select("rid", "doc_id", "line_no", F.btrim("_l", F.lit(SPACES)).alias("line"))


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid: Column | None = None) -> DataFrame:
    """(rid, doc_id, line_no, node, bands, keys), written once; node is null for blank lines."""
    line, starts, keys, few = F.col("line"), F.col("starts"), F.col("keys"), F.col("few")
    long_ = F.length("line") >= LEAST_CHARS
    rows = _lines(docs, id_col, text_col, rid).withColumn("node", F.when(line != "", F.xxhash64("line"))).withColumn("starts", F.when(long_, _starts(line)))
    rows = rows.withColumn("few", ~long_ | (F.size(starts) < FEW_STARTS) | (START_CHARS * F.size(starts) < F.length("line")))
    # no line has fewer shingles than its beginning
    head = (F.length("line") < HEAD) | (few & (F.size(F.array_distinct(_everywhere(F.substring("line", 1, HEAD), WIDTH))) <= MOST_KEYS))
    rows = rows.withColumn("keys", F.when(F.col("node").isNotNull() & head, _shingles(line)))
    wide = F.when(few & long_, _least(_hashes(_everywhere(line, WIDE_CHARS)), K_WIDE))
    rows = rows.select("rid", "doc_id", "line_no", "node", F.when(long_, _least(starts, K)).alias("s"), wide.alias("w"), F.when(F.size(keys) <= MOST_KEYS, keys).alias("keys"))
    wide_bands = F.transform(_pairs("w", K_WIDE), lambda h: F.xxhash64(F.lit("wide"), h))
    bands = F.when(F.col("w").isNull(), _pairs("s", K)).otherwise(F.concat(_pairs("s", K), wide_bands))
    return materialize(rows.select("rid", "doc_id", "line_no", "node", bands.alias("bands"), "keys"), "lines")


def _prefixes(lines: DataFrame) -> DataFrame:
    """(node, region) of the lines with few shingles: their rarest shared shingles, as many as two
    lines of similarity 3/4 need to meet in the rarest that they share."""
    sets = lines.where("keys is not null").groupBy("node").agg(F.first("keys").alias("keys"))
    postings = materialize(sets.select("node", F.size("keys").alias("size"), F.explode("keys").alias("key")), "short-postings")
    shared = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    sets = postings.join(shared, "key").groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "key"))).alias("m"))
    window = F.size("m") - F.ceil(3 * F.col("size") / 4).cast("int") + 1
    return sets.where(window > 0).select("node", F.explode(F.slice("m", F.lit(1), window)).alias("x")).select("node", F.xxhash64(F.lit("key"), F.col("x.key")).alias("region"))


def line_components(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, comp) of the lines that resemble another."""
    prefixes = materialize(_prefixes(lines), "prefixes")
    bands = lines.where("bands is not null").select("node", F.explode("bands").alias("region")).unionByName(prefixes)
    shared = materialize(bands.groupBy("region").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("region"), "shared-bands")
    few = shared.count() <= MOST_KNOWN
    members = materialize(bands.join(F.broadcast(shared) if few else shared, "region", "left_semi").distinct(), "banded")
    nodes = materialize(members.groupBy("node").agg(F.count("*").cast("double").alias("weight")), "candidates")
    few = nodes.count() <= MOST_KNOWN
    texts = _lines(docs, id_col, text_col).select(F.xxhash64("line").alias("node"), "line").join(F.broadcast(nodes) if few else nodes, "node")
    sets = materialize(texts.groupBy("node").agg(F.first("line").alias("keys"), F.first("weight").alias("weight")), "candidate-lines")
    marked = materialize(with_bits(sets.select("node", "keys"), _parts), "candidate-bits")
    return settle(members.join(sets.select("node", "weight"), "node"), marked, _parts, native=True)


def _gone(docs: DataFrame, id_col: str, text_col: str, rid: Column | None = None) -> DataFrame:
    """One row a document: rid, doc_id, n_lines, gone (its dropped lines' numbers, sorted)."""
    lines = hashed_lines(docs, id_col, text_col, rid)
    comp = line_components(docs, lines, id_col, text_col)
    place = F.struct("doc_id", "rid", "line_no")
    least = lines.where("node is not null").groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    nodes = materialize(least.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "nodes")
    first = nodes.groupBy("comp").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    kept = materialize(nodes.select("node", "comp").join(first.select("comp", "first"), "comp").select("node", F.col("first.rid").alias("keep_rid"), F.col("first.line_no").alias("keep_line")), "kept")
    marked = lines.select("rid", "doc_id", "line_no", "node").join(kept, "node", "left")
    drop = F.coalesce((F.col("rid") != F.col("keep_rid")) | (F.col("line_no") != F.col("keep_line")), F.lit(False))
    return marked.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.when(drop, F.col("line_no")))).alias("gone"))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, dropped (its line numbers from 0, joined)."""
    out = _gone(docs, id_col, text_col)
    return out.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_dropped"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("dropped"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the dropped lines, with all their columns; rows are numbered and written
    once, so ids may repeat or be null."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    c = dict(zip(docs.columns, names))
    rows = materialize(docs.toDF(*names).withColumn("rid", F.monotonically_increasing_id()), "rows")
    gone = materialize(_gone(rows, c[id_col], c[text_col], F.col("rid")).where(F.size("gone") > 0).select("rid", "gone"), "gone")
    lines = F.split(F.col(c[text_col]), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    rest = F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")
    joined = rows.join(gone, "rid", "left").withColumn(c[text_col], F.when(F.col("gone").isNotNull(), rest).otherwise(F.col(c[text_col])))
    return joined.select(*names).toDF(*docs.columns)
