"""Packing by concatenate-and-cut.

Pass one tokenises every document and writes ids and the running token offset inside its task;
the totals of the tasks - one row a task - give every task its global offset by a prefix sum.
Pass two cuts the concatenation into fixed windows: a document that crosses a window's edge leaves
one boundary record on either side.  Both passes are narrow: nothing shuffles but the totals.

Token ids are those of the ``tokenizers`` library and file.  The same vocabulary and merge order
drive tiktoken's faster engine; texts with special tokens, or with characters whose Unicode classes
may differ between the two libraries, are encoded by ``tokenizers`` itself.

Defined results: a null text is empty and packs as its end id alone; a null id is carried; an empty
table gives no rows; repeated rows are packed once each.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialize, slices, text_buffers

WINDOW = 2048
END_ID = 1
#: Long-assigned characters, on whose classes all Unicode versions agree.
PLAIN = "\\x00-\u052f\u1e00-\u2064\u2070-\u20bf\u2100-\u218b\u2190-\u23ff\u3000-\u303f\u3041-\u3096\u3099-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uffdc"

#: Task totals that the driver may broadcast; beyond it they are joined.
MOST_TOTALS = 1_000_000

_workers: dict[str, BytePieces] = {}


class BytePieces:
    """ids of texts under a byte-level BPE file of the tokenizers library, as little-endian uint32."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [c for c in range(256) if c not in shown]
        byte_of = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in t): k for t, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
        # GPT-2's published pre-token pattern (a fixed value)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.engine = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.other = re.compile("|".join([f"[^{PLAIN}]", *map(re.escape, special)])).search

    @classmethod
    def of(cls, path: str) -> BytePieces:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def encode(self, text: str) -> np.ndarray:
        if self.other(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.engine.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def token_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """(part, local, doc_id, n, ids) of every document, written once: ``local`` tokens lie before it
    among those of its task ``part``; ids are packed in two bytes where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, local = TaskContext.get().partitionId(), 0
        pieces = BytePieces.of(tokenizer_path)
        narrow = pieces.tokenizer.get_vocab_size() <= 1 << 16
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            for first, last in slices(at, SLICE_BYTES):
                raw, edge = data[at[first] : at[last]].tobytes(), (at[first : last + 1] - at[first]).tolist()
                ids = [np.append(pieces.encode(raw[a:b].decode()), tail) for a, b in zip(edge, edge[1:])]
                n = np.array([len(x) for x in ids], np.int64)
                before = local + np.cumsum(n) - n
                local += int(n.sum())
                packed = [x.astype("<u2" if narrow else "<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(before), batch.column(0).slice(first, len(ids)), pa.array(n), pa.array(packed, pa.binary())], ["part", "local", "doc_id", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"part int, local long, doc_id {kind}, n long, ids binary"), "tokens")


def _starts(tokens: DataFrame) -> DataFrame:
    """(part, base): tokens in all earlier tasks.  One row a task goes through the window."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    base = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return totals.select("part", base.alias("base"))


def _cut(batches: Iterator[pa.RecordBatch], window: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, local, doc, n, ids = (batch.column(k) for k in range(5))
        rows, start, length, crc, total, seq, off, raw = [], [], [], [], [], [], [], []
        for k, (b, lo, m) in enumerate(zip(base.to_pylist(), local.to_pylist(), n.to_pylist())):
            packed = ids[k].as_buffer()
            wide = np.frombuffer(packed, "<u2" if m and len(packed) == 2 * m else "<u4").astype("<u4").tobytes()
            at, done = b + lo, 0
            while done < m:
                take = min(m - done, window - (at + done) % window)
                piece = wide[4 * done : 4 * (done + take)]
                rows.append(k), start.append(done), length.append(take), crc.append(zlib.crc32(piece)), total.append(m)
                seq.append((at + done) // window), off.append((at + done) % window)
                if with_ids:
                    raw.append(piece)
                done += take
        out = [doc.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, seq, off))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            out.append(pa.array(raw, pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(out, names)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).
    Every sequence but the last is full."""
    tokens = token_table(docs, tokenizer_path, id_col, text_col, end_id)
    starts = materialize(_starts(tokens), "starts")
    few = starts.count() <= MOST_TOTALS
    placed = tokens.join(F.broadcast(starts) if few else starts, "part").select("base", "local", "doc_id", "n", "ids")
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return placed.mapInArrow(lambda batches: _cut(batches, window, with_ids), schema)
