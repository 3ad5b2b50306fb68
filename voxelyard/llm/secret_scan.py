"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are runs of token characters of at least ``WINDOW`` bytes, found for a whole slice of
the table at once, and their parts between separators.  A window slides over each; its entropy is
kept by incremental counts (one character leaves, one enters) and held against the threshold of the
candidate's character class.  Windows over the threshold merge into spans.  Allow-listed candidates
(words of one case, Capitalised or in camelCase with humps of at least four letters, paths of such
words, identifiers, placeholders) are suppressed, and so are letters of one case alone.

Defined results: a null text counts as empty and has no spans; a null id is carried; repeated rows
are scanned once each; an empty table gives no rows; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, slices, text_buffers

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
#: What every keyword of ASSIGN holds, in lower case.
HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
WINDOW = 20
#: Least entropy in bits a character of a window, by class; digits alone and one case alone are no secrets.
#: ``mixed`` and ``letters`` hold separators; the others are one alphabet throughout, and under 1 % of
#: random windows of base32 to base62 lie below.
THRESHOLDS = {"hex": 3.0, "mixed": 3.7, "letters": 4.1, "base32": 3.2, "base36": 3.3, "base52": 3.5, "base62": 3.5}
_WORD = rb"(?:[A-Z]+|[A-Z]?[a-z]+|[a-z]+(?:[A-Z][a-z]{3,})+|(?:[A-Z][a-z]{3,}){2,})(?![A-Za-z])"
ALLOWED = (
    rb"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",  # UUID
    _WORD + rb"(?:[/_=+-]+" + _WORD + rb")*[/_=+-]*",  # words and paths
    rb"[0-9_/=+-]+(?:T[0-9]+Z?)?",  # numbers, dates
    rb"(?i:.*(?:example|placeholder|xxxx|changeme|your_?).*)",
    rb"(?:sha(?:1|256|384|512)|md5)[-=:].*",
)

_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True


def _runs(mask: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True of at least ``least``; a run ends at every edge."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1]
    closes[:-1] &= ~mask[1:]
    inner = edges[(edges > 0) & (edges < len(mask))]
    opens[inner] |= mask[inner]
    closes[inner - 1] |= mask[inner - 1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    keep = b - a >= least
    return a[keep], b[keep]


def char_class(run: bytes) -> str | None:
    """Of a candidate: hex; base32, base36 (one case and digits), base52 (letters of both cases) or base62; with
    separators mixed (a digit and a letter) or letters (both cases); or none that hides a secret."""
    digit, lower, upper = (any(x <= c <= y for c in run) for x, y in ((48, 57), (97, 122), (65, 90)))
    if re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", run):
        return "hex" if digit and (lower or upper) else None
    plain = run.isalnum()
    if lower and upper:
        return ("base62" if plain else "mixed") if digit else "base52" if plain else "letters"
    if digit and (lower or upper):
        return ("base32" if re.fullmatch(rb"[a-z2-7]+|[A-Z2-7]+", run) else "base36") if plain else "mixed"
    return None


def entropy_spans(run: bytes, window: int, least: float) -> list[tuple[int, int]]:
    """Merged windows with at least so much entropy."""
    term = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts, total, out = [0] * 256, 0.0, []
    bound = window * (math.log2(window) - least) + 1e-9  # entropy >= least, in terms of the sum of n log n
    for k, c in enumerate(run):
        total += term[counts[c] + 1] - term[counts[c]]
        counts[c] += 1
        if k >= window:
            old = run[k - window]
            total += term[counts[old] - 1] - term[counts[old]]
            counts[old] -= 1
        if k >= window - 1 and total <= bound:
            a = k - window + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], k + 1)
            else:
                out.append((a, k + 1))
    return out


class Scanner:
    def __init__(self, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, allowed: tuple[bytes, ...] = ALLOWED):
        self.window, self.thresholds = window, thresholds
        self.allowed = re.compile(b"|".join(b"(?:" + a + b")" for a in allowed), re.S).fullmatch

    def high(self, run: bytes) -> list[tuple[int, int]]:
        """Merged spans of a candidate and of its parts between separators."""
        if self.allowed(run):
            return []
        parts = [(m.start(), m[0]) for m in re.finditer(rb"[A-Za-z0-9]+", run) if self.window <= len(m[0]) < len(run)]
        spans, out = [], []
        for start, part in [(0, run), *((x, p) for x, p in parts if not self.allowed(p))]:
            kind = char_class(part)
            if kind:
                spans += [(start + x, start + y) for x, y in entropy_spans(part, self.window, self.thresholds[kind])]
        for x, y in sorted(spans):
            if out and x <= out[-1][1]:
                out[-1] = (out[-1][0], max(y, out[-1][1]))
            else:
                out.append((x, y))
        return out

    def scan(self, data: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """(start, kind, end) in bytes of the text, sorted, for each row that has any."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        raw = data.tobytes()
        row_of = lambda p: int(np.searchsorted(at, p, "right")) - 1

        def put(start: int, end: int, kind: int) -> None:
            k = row_of(start)
            found.setdefault(k, []).append((start - int(at[k]), kind, end - int(at[k])))

        low, rows = raw.translate(ASCII_LOWER), set()
        for hint in HINTS:
            p = low.find(hint)
            while p >= 0:
                k = row_of(p)
                rows.add(k)
                p = low.find(hint, int(at[k + 1]))
        for k in rows:
            base = int(at[k])
            for m in ASSIGN.finditer(raw[base : at[k + 1]]):
                if m.end(2) - m.start(2) >= 8:
                    put(base + m.start(), base + m.end(), 0)
        if b"AKIA" in raw:
            for a, b in zip(*(x.tolist() for x in _runs(_UPPER[data], at, 16))):
                p = raw.find(b"AKIA", a, b)
                if p >= 0 and b - p >= 16:
                    put(p, b, 1)
        for a, b in zip(*(x.tolist() for x in _runs(_HEX[data], at, 32))):
            put(a, b, 2)
        for a, b in zip(*(x.tolist() for x in _runs(_TOKEN[data], at, self.window))):
            for x, y in self.high(raw[a:b]):
                put(a + x, a + y, 3)
        for k, spans in found.items():
            base = [s for s in spans if s[1] < 3]
            found[k] = sorted(base + [s for s in spans if s[1] == 3 and not any(b[0] <= s[0] and s[2] <= b[2] for b in base)])
        return found


def _code_points(data: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    extra = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
    return [(s - int(extra[s]), k, e - int(extra[e])) for s, k, e in spans]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    args = scanner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = args or Scanner()
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            for first, last in slices(at):
                edges = at[first : last + 1] - at[first]
                part = data[at[first] : at[last]]
                found = scanner.scan(part, edges)
                rows = [_code_points(part[edges[k] : edges[k + 1]], found[k]) if k in found else [] for k in range(last - first)]
                counts = [pa.array([sum(s[1] == kind for s in spans) for spans in rows], pa.int64()) for kind in range(3)]
                base = pa.array([hashlib.sha256(_joined([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *counts, base, pa.array([_joined(s) for s in rows])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", scanner: Scanner | None = None) -> DataFrame:
    """The documents with every found span replaced by ``mark``; texts without any stay as they are."""
    where, args, sign = docs.columns.index(text_col), scanner, mark.encode()
    columns, names = docs.columns, [f"c{k}" for k in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = args or Scanner()
        for batch in batches:
            data, at = text_buffers(batch.column(where))
            for first, last in slices(at):
                part, edges = data[at[first] : at[last]], at[first : last + 1] - at[first]
                column = batch.column(where).slice(first, last - first)
                found = scanner.scan(part, edges)
                if found:
                    texts = column.to_pylist()
                    for k, spans in found.items():
                        raw, out, done = part[edges[k] : edges[k + 1]].tobytes(), [], 0
                        for s, _, e in spans:
                            if s >= done:
                                out += [raw[done:s], sign]
                            done = max(done, e)
                        texts[k] = b"".join([*out, raw[done:]]).decode()
                    column = pa.array(texts, column.type)
                yield pa.RecordBatch.from_arrays([column if j == where else batch.column(j).slice(first, last - first) for j in range(batch.num_columns)], names)

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*columns)
