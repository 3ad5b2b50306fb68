"""Offset-preserving SentencePiece encoding and decoding.

Normalisation walks the text with the model's compiled character map: at every place the longest
prefix that the map's double-array trie knows is replaced, other characters stay, and every
normalised byte keeps the source bytes it came from.  Pieces, which tile the normalised text, are
then projected to spans of original bytes.

A model without a character map only turns spaces into the space mark.  There, when no piece has
the mark behind another character (so that no merge crosses a space), a text is split at single
spaces and each distinct part is encoded once a worker; texts with other runs of spaces, or with
the mark itself, are encoded whole.  Ids are always those of the sentencepiece library.

Defined results: a null text is empty and encodes to the begin and end ids alone; a null id is
carried; repeated rows are encoded once each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffers

MARK = "▁"
#: Distinct parts that a worker remembers before it starts afresh.
MEMO = 400_000

_workers: dict[str, Codec] = {}


class CharsMap:
    """The compiled character map of a model: trie size, double-array trie, replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, place of the replacement), or (0, 0)."""
        units, found = self.units, (0, 0)
        unit = units[0]
        node = (unit >> 10) << ((unit & 1 << 9) >> 6)
        for k in range(at, len(text)):
            byte = text[k]
            node ^= byte
            unit = units[node]
            if unit & (1 << 31 | 0xFF) != byte:
                break
            node ^= (unit >> 10) << ((unit & 1 << 9) >> 6)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    def replacement(self, place: int) -> bytes:
        return self.strings[place : self.strings.index(b"\0", place)]


class Normalizer:
    """Normalised bytes of a text, and for each of them the source span it stands for."""

    def __init__(self, spec):
        self.map = CharsMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.seen: dict[bytes, bytes] = {}

    def _units(self, text: bytes) -> Iterator[tuple[bytes, int, int]]:
        at = 0
        while at < len(text):
            n, place = self.map.longest(text, at) if self.map else (0, 0)
            if n:
                yield self.map.replacement(place), at, at + n
            else:
                first = text[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                yield text[at : at + n], at, at + n
            at += n

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        space = MARK.encode() if self.escape else b" "
        out, spans = [], []

        def put(piece: bytes, a: int, b: int) -> None:
            out.append(piece)
            spans.append((len(piece), a, b))

        units = list(self._units(text))
        if self.squeeze:
            while units and units[0][0].strip(b" ") == b"":
                units.pop(0)
            while units and units[-1][0].strip(b" ") == b"":
                units.pop()
        if self.prefix and units:
            put(space, units[0][1], units[0][1])
        before = self.squeeze
        for piece, a, b in units:
            if self.squeeze and before:
                piece = piece.lstrip(b" ")
            if piece:
                if self.squeeze:
                    piece = re.sub(rb" +", b" ", piece)
                put(piece.replace(b" ", space), a, b)
                before = piece.endswith(b" ")
        while self.squeeze and out and out[-1].endswith(space):  # marks at the end go, those of the text too
            out[-1] = out[-1].removesuffix(space)
            spans[-1] = (len(out[-1]), *spans[-1][1:])
            if not out[-1]:
                out.pop(), spans.pop()
        n = [s[0] for s in spans]
        return b"".join(out), np.repeat([s[1] for s in spans], n).astype(np.int64), np.repeat([s[2] for s in spans], n).astype(np.int64)


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.normalize = Normalizer(model.normalizer_spec)
        kinds = model_pb2.ModelProto.SentencePiece
        self.size = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        # bytes of the source that a piece covers when only spaces change: a mark stands for one
        self.covers = self.size - np.array([0 if p.type == kinds.BYTE else 2 * p.piece.count(MARK) for p in model.pieces], np.int64)
        self.unk = self.sp.unk_id()
        spec = model.normalizer_spec
        self.by_part = (
            not self.normalize.map and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
            and model.trainer_spec.model_type == model_pb2.TrainerSpec.BPE and model.trainer_spec.byte_fallback
            and not any(p.type == kinds.USER_DEFINED or re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)
        )
        self.memo: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.sp.encode(text), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without begin and end."""
        if not self.by_part:
            return [np.frombuffer(self._whole(t), "<u4") for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        parts = [t.split(" ") if t and "  " not in t and t[0] != " " and t[-1] != " " and MARK not in t else None for t in texts]
        missing = list({p for ps in parts if ps for p in ps if p not in memo})
        memo.update((p, np.array(ids, "<u4").tobytes()) for p, ids in zip(missing, self.sp.encode(missing, num_threads=1)))
        get = memo.__getitem__
        return [np.frombuffer(b"".join(map(get, ps)) if ps else self._whole(t), "<u4") for t, ps in zip(texts, parts)]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, in bytes of the text, of what each id stands for."""
        if not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        raw = text.encode()
        if self.by_part:
            ends = np.cumsum(self.covers[ids])
            ends += len(raw) - int(ends[-1])  # the prefix has no source; a mark in the text has three bytes
            if MARK not in text:
                return np.concatenate([[0], ends[:-1]]), ends
        norm, first, last = self.normalize(raw)
        if self.unk in ids:
            proto = self.sp.encode(text, out_type="immutable_proto")
            size = np.array([len(p.surface.encode()) if p.id == self.unk else self.size[p.id] for p in proto.pieces])
        else:
            size = self.size[ids]
        ends = np.cumsum(size)
        if ends[-1] != len(norm):
            raise ValueError("pieces do not tile the normalised text")
        return first[ends - size], last[ends - 1]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids with begin and end, byte spans of the pieces between them, and the decoded text; with
    ``digests`` their SHA-256 instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model_path)
        begin, end = np.array([codec.sp.bos_id()], "<u4"), np.array([codec.sp.eos_id()], "<u4")
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            raw = data.tobytes()
            for k in range(0, batch.num_rows, 128):
                texts = [raw[at[j] : at[j + 1]].decode() for j in range(k, min(k + 128, batch.num_rows))]
                bare = codec.encode(texts)
                ids = [np.concatenate([begin, x, end]) for x in bare]
                spans = [codec.spans(t, x) for t, x in zip(texts, bare)]
                decoded = [codec.decode(x.tolist()) for x in ids]
                n = pa.array([len(x) for x in ids], pa.int64())
                head = [batch.column(0).slice(k, len(texts)), n]
                if digests:
                    rows = [*head, pa.array([_sha(x.tobytes()) for x in ids]), pa.array([_sha(x.encode()) for x in decoded]), pa.array([_sha(np.stack(s, 1).astype("<u4").tobytes()) for s in spans])]
                else:
                    rows = [*head, *(pa.array(x, pa.list_(pa.int64())) for x in ([y.astype(np.int64) for y in ids], [s[0] for s in spans], [s[1] for s in spans])), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(rows, names)

    kind = docs.schema[id_col].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string, spans_sha256 string" if digests else "ids array<long>, starts array<long>, ends array<long>, decoded string"
    names = ["doc_id", "n_tokens", *(x.split(" ")[0] for x in rest.split(", "))]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, {rest}")
