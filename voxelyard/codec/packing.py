"""Packing of operation streams: nibbles, range-ANS, bit vectors with rank, wavelet matrices."""

from __future__ import annotations

import bisect

import numpy as np


# --- nibbles, eight to a 32-bit word, the first in the highest bits ---------------------------------


def pack_nibbles(nibbles: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(nibbles) // 8) * 8, np.uint32)
    padded[: len(nibbles)] = nibbles
    return (padded.reshape(-1, 8) << np.arange(28, -1, -4, dtype=np.uint32)).sum(1, dtype=np.uint32)


def unpack_nibbles(words: np.ndarray, n: int) -> np.ndarray:
    return (words[:, None] >> np.arange(28, -1, -4, dtype=np.uint32) & np.uint32(15)).reshape(-1)[:n].astype(np.uint8)


# --- static range-ANS over 16 symbols ----------------------------------------------------------------

SCALE_BITS = 14
LOW = 1 << 23


def normalized(counts: np.ndarray, total: int = 1 << SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to ``total``: one for every counted symbol, and the rest by largest remainders."""
    counts = [int(c) for c in counts]
    used, whole = [k for k, c in enumerate(counts) if c > 0], sum(counts)
    out = np.zeros(len(counts), np.int64)
    if not used:
        return out
    spare = total - len(used)
    shares = {k: divmod(counts[k] * spare, whole) for k in used}
    left = spare - sum(q for q, _ in shares.values())
    favoured = sorted(used, key=lambda k: (-shares[k][1], k))[:left]
    for k in used:
        out[k] = 1 + shares[k][0] + (k in favoured)
    return out


class RangeANS:
    """One state, renormalised byte by byte; symbols are coded last to first."""

    def __init__(self, counts: np.ndarray):
        self.freq = normalized(counts).tolist()
        self.start = np.concatenate([[0], np.cumsum(self.freq)]).tolist()
        self.slot = np.repeat(np.arange(len(self.freq)), self.freq).tolist()

    def encode(self, symbols: np.ndarray) -> bytes:
        state, out = LOW, bytearray()
        for s in reversed(symbols.tolist()):
            f = self.freq[s]
            most = (LOW >> SCALE_BITS << 8) * f
            while state >= most:
                out.append(state & 255)
                state >>= 8
            state = (state // f << SCALE_BITS) + state % f + self.start[s]
        out += state.to_bytes(4, "little")
        return bytes(out[::-1])

    def decode(self, data: bytes, n: int) -> np.ndarray:
        state, at, out = int.from_bytes(data[:4], "big"), 4, np.empty(n, np.uint8)
        for k in range(n):
            low = state & (1 << SCALE_BITS) - 1
            s = self.slot[low]
            out[k] = s
            state = self.freq[s] * (state >> SCALE_BITS) + low - self.start[s]
            while state < LOW and at < len(data):
                state = state << 8 | data[at]
                at += 1
        return out


# --- bit vectors --------------------------------------------------------------------------------------


class BitVector:
    """Bits with a two-level rank directory: counts before blocks, and popcounts of words inside.  Only
    the words are stored; the directory is counted again when they are read."""

    WORDS = 20  # 64-bit words a block

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self._index(len(bits), np.packbits(padded, bitorder="little").view("<u8"))

    def _index(self, n: int, words: np.ndarray) -> None:
        self.n, self.words = n, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])  # L1 and L2 in one directory of word prefixes
        self.blocks = self.before[:: self.WORDS]

    def to_bytes(self) -> bytes:
        return self.n.to_bytes(4, "little") + self.words.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int = 0) -> tuple[BitVector, int]:
        """The vector stored at a place, and the place after it."""
        n = int.from_bytes(data[at : at + 4], "little")
        size = -(-(n + 1) // 64)
        out = cls.__new__(cls)
        out._index(n, np.frombuffer(data, "<u8", size, at + 4))
        return out, at + 4 + 8 * size

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little")

    def __getitem__(self, k: int) -> int:
        return int(self.words[k >> 6]) >> (k & 63) & 1

    def rank1(self, k: int) -> int:
        """Ones before place k."""
        return int(self.before[k >> 6]) + (int(self.words[k >> 6]) & (1 << (k & 63)) - 1).bit_count()

    def rank0(self, k: int) -> int:
        return k - self.rank1(k)

    def overhead(self) -> float:
        """Bytes of the directory against those of the bits, with 19 bits an L2 entry as stored."""
        return (8 * len(self.blocks) + 2 * (len(self.before) - len(self.blocks))) / max(1, 8 * len(self.words))


def _read_vectors(data: bytes, at: int = 0) -> list[BitVector]:
    out = []
    while at < len(data):
        vector, at = BitVector.read(data, at)
        out.append(vector)
    return out


# --- wavelet matrices ---------------------------------------------------------------------------------


class WaveletMatrix:
    """Symbols of 4 bits, one bit vector a bit from the highest, zeros first on the way down."""

    def __init__(self, symbols: np.ndarray, bits: int = 4):
        self.bits, self.levels, self.zeros = bits, [], []
        rest = np.asarray(symbols, np.uint8)
        for b in range(bits - 1, -1, -1):
            plane = rest >> b & 1
            self.levels.append(BitVector(plane))
            self.zeros.append(int((plane == 0).sum()))
            rest = np.concatenate([rest[plane == 0], rest[plane == 1]])

    def to_bytes(self) -> bytes:
        return b"".join(v.to_bytes() for v in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        out = cls.__new__(cls)
        out.levels = _read_vectors(data)
        out.bits, out.zeros = len(out.levels), [v.rank0(v.n) for v in out.levels]
        return out

    def symbols(self) -> np.ndarray:
        """All symbols in order, a level of all of them at a time."""
        at, out = np.arange(self.levels[0].n), np.zeros(self.levels[0].n, np.uint8)
        for vector, zeros in zip(self.levels, self.zeros):
            plane = vector.bits()
            ones = np.concatenate([[0], np.cumsum(plane, dtype=np.int64)])[at]
            bit = plane[at]
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out

    def access(self, k: int) -> int:
        out = 0
        for bits, zeros in zip(self.levels, self.zeros):
            bit = bits[k]
            out = out << 1 | bit
            k = zeros + bits.rank1(k) if bit else bits.rank0(k)
        return out

    def rank(self, symbol: int, k: int) -> int:
        """Occurrences of the symbol before place k."""
        first = 0
        for b, (bits, zeros) in zip(range(self.bits - 1, -1, -1), zip(self.levels, self.zeros)):
            if symbol >> b & 1:
                first, k = zeros + bits.rank1(first), zeros + bits.rank1(k)
            else:
                first, k = bits.rank0(first), bits.rank0(k)
        return k - first


class HuffmanWaveletMatrix:
    """Symbols 0 to 5 under the codes 1, 01, 001, 0001, 00001, 00000: at each level the symbol that
    ends there leaves, the others go on in order."""

    def __init__(self, symbols: np.ndarray, last: int = 5):
        self.last, self.levels = last, []
        rest = np.asarray(symbols, np.uint8)
        for s in range(last):
            self.levels.append(BitVector((rest == s).astype(np.uint8)))
            rest = rest[rest != s]

    def to_bytes(self) -> bytes:
        return b"".join(v.to_bytes() for v in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> HuffmanWaveletMatrix:
        out = cls.__new__(cls)
        out.levels = _read_vectors(data, at)
        out.last = len(out.levels)
        return out

    def symbols(self) -> np.ndarray:
        """All symbols in order, from the longest codes up."""
        rest = np.full(self.levels[-1].rank0(self.levels[-1].n), self.last, np.uint8)
        for s in range(self.last - 1, -1, -1):
            plane = self.levels[s].bits()
            out = np.full(len(plane), s, np.uint8)
            out[plane == 0] = rest
            rest = out
        return rest

    def access(self, k: int) -> int:
        for s, bits in enumerate(self.levels):
            if bits[k]:
                return s
            k = bits.rank0(k)
        return self.last

    def rank(self, symbol: int, k: int) -> int:
        for bits in self.levels[:symbol]:
            k = bits.rank0(k)
        return self.levels[symbol].rank1(k) if symbol < self.last else k


class StoppedStream:
    """A complete tree of operations of which those below stopped nodes are not stored.  A stop bit for
    every stored node above the finest level leads from the root to any place: the children of the
    j-th node that goes on lie in the j-th group of eight of the next level."""

    def __init__(self, complete: np.ndarray, starts: np.ndarray, stop: np.ndarray):
        """``stop`` marks, in the complete order, nodes below which every operation is 0."""
        self.starts = [int(s) for s in starts]
        stored, inner = np.ones(len(complete), bool), self.starts[-1]
        for a, b, c in zip(self.starts, self.starts[1:], [*self.starts[2:], len(complete)]):
            stored[b:c] = np.repeat(stored[a:b] & (stop[a:b] == 0), 8)
        self.stop = BitVector(stop[:inner][stored[:inner]])
        self.kept = HuffmanWaveletMatrix(complete[stored])
        self._place_levels()

    def _place_levels(self) -> None:
        """Where the stored nodes of each level begin."""
        self.at, n = [0], 1
        for _ in self.starts[1:]:
            self.at.append(self.at[-1] + n)
            n = 8 * (self.stop.rank0(self.at[-1]) - self.stop.rank0(self.at[-2]))

    def to_bytes(self) -> bytes:
        return self.stop.to_bytes() + self.kept.to_bytes()

    @classmethod
    def from_bytes(cls, data: bytes, starts) -> StoppedStream:
        out = cls.__new__(cls)
        out.starts = [int(s) for s in starts]
        out.stop, at = BitVector.read(data)
        out.kept = HuffmanWaveletMatrix.from_bytes(data, at)
        out._place_levels()
        return out

    def _walk(self, k: int) -> tuple[int, bool]:
        """(stored place of a node or of the stopped node above it, whether it is the latter)."""
        level = bisect.bisect_right(self.starts, k) - 1
        i, j = k - self.starts[level], 0
        for up in range(level):
            place = self.at[up] + j
            if self.stop[place]:
                return place, True
            j = 8 * (self.stop.rank0(place) - self.stop.rank0(self.at[up])) + (i >> 3 * (level - up - 1) & 7)
        return self.at[level] + j, False

    def translate(self, k: int) -> int:
        """Stored place of a node, or of the stopped node above it."""
        return self._walk(k)[0]

    def access(self, k: int) -> int:
        place, below = self._walk(k)
        return 0 if below else self.kept.access(place)

    def rank(self, symbol: int, k: int) -> int:
        """Occurrences of a symbol but 0 before a stored node."""
        return self.kept.rank(symbol, self.translate(k))

    def symbols(self) -> np.ndarray:
        """The complete tree's operations in order."""
        kept, stop, at, out = self.kept.symbols(), self.stop.bits(), np.zeros(1, np.int64), []
        for level, first in enumerate(self.at):
            mine = np.zeros(8**level, np.uint8)
            mine[at] = kept[first : first + len(at)]
            out.append(mine)
            if level + 1 < len(self.at):
                on = at[stop[first : first + len(at)] == 0]
                at = (on[:, None] * 8 + np.arange(8)).reshape(-1)
        return np.concatenate(out)
