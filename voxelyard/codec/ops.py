"""Brick operations: what a brick's pyramid is described with, and its replay.

A brick of side B is a complete octree in Z order: level L has (B >> L)^3 nodes, and node i of level
L has the children 8i ... 8i + 7 of level L - 1.  Nodes are written from the root down.  Arrays of
labels use -1 for nodes outside the volume or not decoded.  All of it is numpy on one brick.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PARENT, NEIGHBOR_X, NEIGHBOR_Y, NEIGHBOR_Z, PALETTE_ADV, PALETTE_LAST, PALETTE_D = range(7)  # fixed values
STOP = 8
MOST_DELTA = 1 << 24
#: Letters of operation masks: parent, neighbours, last, delta (d- with one nibble), stop bits.
ALL, DEFAULT = frozenset("pxyzlds"), frozenset("pxyzls")


def parse_mask(text: str) -> tuple[frozenset[str], bool]:
    """(operations, single-nibble deltas) of a comma-separated mask: p, x, y, z, n (= x, y, z), l, d,
    d-, s, a (all) or o (all but deltas)."""
    ops: set[str] = set()
    short = False
    for item in filter(None, (t.strip() for t in text.split(","))):
        if item == "a":
            ops |= ALL
        elif item == "o":
            ops |= DEFAULT
        elif item == "n":
            ops |= set("xyz")
        elif item in ("d", "d-"):
            ops.add("d")
            short = item == "d-"
        elif item in ALL:
            ops.add(item)
        else:
            raise ValueError(f"unknown operation {item!r}")
    if "d" in ops and "l" not in ops:
        raise ValueError("deltas need the last-entry operation: distance 0 has no code of its own")
    return frozenset(ops), short


def mask_text(ops: frozenset[str]) -> str:
    return ",".join(c for c in "pxyzlds" if c in ops)


@lru_cache(maxsize=16)
def z_order(side: int) -> np.ndarray:
    """(side^3, 3) coordinates of a cube's cells in Z order."""
    n = np.arange(side**3)
    out = np.zeros((side**3, 3), np.int64)
    for k in range(max(1, side.bit_length())):
        for a in range(3):
            out[:, a] |= (n >> (3 * k + a) & 1) << k
    return out


@lru_cache(maxsize=16)
def z_index(side: int) -> np.ndarray:
    """[x, y, z] -> place in Z order."""
    out = np.empty((side,) * 3, np.int64)
    p = z_order(side)
    out[p[:, 0], p[:, 1], p[:, 2]] = np.arange(len(p))
    return out


@lru_cache(maxsize=16)
def neighbour_table(side: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node of a level with ``side`` nodes an axis, and each axis: the node it is compared
    with (-1: outside), and whether that is one of the level above.  Odd coordinates look ahead, at
    the coarser level; even ones look back, at their own."""
    p, index = z_order(side), z_index(side)
    at, above = np.full((len(p), 3), -1, np.int64), np.zeros((len(p), 3), bool)
    for a in range(3):
        odd = p[:, a] % 2 == 1
        q = p.copy()
        q[:, a] += np.where(odd, 1, -1)
        ok = (q[:, a] >= 0) & (q[:, a] < side)
        n = index[q[ok, 0], q[ok, 1], q[ok, 2]]
        at[ok, a] = np.where(odd[ok], n >> 3, n)
        above[:, a] = odd
    return at, above


def pyramid(cells: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(labels, constant flags) by level, finest first, of a brick's labels in Z order (-1: outside)."""
    labels, flags = [cells.astype(np.int64)], [np.zeros(len(cells), bool)]
    while len(labels[-1]) > 1:
        kids, deep = labels[-1].reshape(-1, 8), flags[-1].reshape(-1, 8)
        valid = kids >= 0
        votes = ((kids[:, :, None] == kids[:, None, :]) & valid[:, None, :]).sum(2) * valid
        best = votes.argmax(1)
        label = np.where(valid.any(1), kids[np.arange(len(kids)), best], -1)
        same = ((kids == label[:, None]) | ~valid).all(1) & valid.any(1)
        if len(labels) > 1:
            same &= (deep | ~valid).all(1)
        labels.append(label)
        flags.append(same)
    return labels, flags


def fill(labels: list[np.ndarray]) -> list[np.ndarray]:
    """The pyramid with outside nodes taking their parent's label, top down."""
    out = [labels[-1]]
    for level in range(len(labels) - 2, -1, -1):
        out.append(np.where(labels[level] < 0, np.repeat(out[-1], 8), labels[level]))
    return out[::-1]


class _Palette:
    """Labels in the order they were pushed, and where each was pushed last."""

    def __init__(self) -> None:
        self.entries: list[int] = []
        self.last: dict[int, int] = {}

    def push(self, label: int) -> None:
        self.last[label] = len(self.entries)
        self.entries.append(label)

    def distance(self, label: int) -> int | None:
        at = self.last.get(label)
        return None if at is None else len(self.entries) - 1 - at


def delta_nibbles(distance: int, short: bool) -> list[int]:
    """Nibbles of distance - 1: one alone, or groups of three bits, highest first, bit 3 for more."""
    value = distance - 1
    if short:
        return [value]
    groups = [value & 7]
    while value := value >> 3:
        groups.append(value & 7)
    return [g | 8 for g in groups[:0:-1]] + [groups[0]]


def encode(cells: np.ndarray, ops: frozenset[str] = DEFAULT, short: bool = False) -> tuple[np.ndarray, list[int], list[int]]:
    """(nibbles, start of each level from the root, palette in push order) of a brick's labels."""
    labels, flags = pyramid(cells)
    if "s" not in ops:
        flags = [np.zeros_like(f) for f in flags]
    palette = _Palette()
    out: list[int] = []
    starts: list[int] = []
    top = len(labels) - 1
    skipped = np.zeros(1, bool)
    for level in range(top, -1, -1):
        starts.append(len(out))
        mine = labels[level]
        live = np.flatnonzero((mine >= 0) & ~skipped)
        if level < top:
            up = labels[level + 1]
            at, above = neighbour_table(len(z_index(round(len(mine) ** (1 / 3)))))
            near = np.where(at < 0, -2, np.where(above, up[np.maximum(at, 0) % len(up)], mine[np.maximum(at, 0)]))
            code = np.full(len(mine), PALETTE_ADV)
            for k, letter in ((NEIGHBOR_Z, "z"), (NEIGHBOR_Y, "y"), (NEIGHBOR_X, "x")):
                if letter in ops:
                    code[near[:, k - 1] == mine] = k
            if "p" in ops:
                code[np.repeat(up, 8) == mine] = PARENT
        else:
            code = np.full(1, PALETTE_ADV)
        stop = flags[level] if level else np.zeros(len(mine), bool)
        for i in live.tolist():
            op, tail = int(code[i]), []
            if op == PALETTE_ADV:
                label = int(mine[i])
                far = palette.distance(label)
                if level < top and far == 0 and "l" in ops:
                    op = PALETTE_LAST
                elif level < top and far and "d" in ops and far <= (16 if short else MOST_DELTA):
                    op, tail = PALETTE_D, delta_nibbles(far, short)
                else:
                    palette.push(label)
            out.append(op | (STOP if stop[i] else 0))
            out += tail
        skipped = np.repeat(skipped | stop, 8)
    return np.array(out, np.uint8), starts, palette.entries


def decode(nibbles: np.ndarray, palette: list[int], side: int, valid: np.ndarray, short: bool = False, inv_lod: int | None = None) -> np.ndarray:
    """Labels of the level ``inv_lod`` (0: the root; default: the voxels) in Z order; -1 where a node
    lies outside.  ``valid`` marks the voxels in the volume."""
    top = side.bit_length() - 1
    inside = [valid]
    while len(inside[-1]) > 1:
        inside.append(inside[-1].reshape(-1, 8).any(1))
    stream, at, pushed = nibbles.tolist(), 0, 0
    seen: list[int] = []
    up = stopped = None
    for level in range(top, top - (top if inv_lod is None else inv_lod) - 1, -1):
        n = len(inside[level])
        mine, stop = np.full(n, -1, np.int64), np.zeros(n, bool)
        if up is not None:
            held = np.repeat(stopped, 8) & inside[level]
            mine[held] = np.repeat(up, 8)[held]
            stop |= np.repeat(stopped, 8)
            near, above = (t.tolist() for t in neighbour_table(round(n ** (1 / 3))))
        for i in np.flatnonzero(inside[level] & ~stop).tolist():
            word = stream[at]
            at += 1
            op = word & 7
            if op == PARENT:
                label = up[i >> 3]
            elif op <= NEIGHBOR_Z:
                k = near[i][op - 1]
                label = up[k] if above[i][op - 1] else mine[k]
            elif op == PALETTE_ADV:
                label = palette[pushed]
                pushed += 1
                seen.append(label)
            elif op == PALETTE_LAST:
                label = seen[-1]
            else:
                value = stream[at]
                at += 1
                if not short:
                    more, value = value & 8, value & 7
                    while more:
                        word2 = stream[at]
                        at += 1
                        more, value = word2 & 8, value << 3 | word2 & 7
                label = seen[-2 - value]
            mine[i] = label
            if word & STOP and level:
                stop[i] = True
        up, stopped = mine, stop
    return up


def encode_all(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(nibbles, start of each level, palette) with every node stored, so that any voxel can be read
    alone: no stop bits and no deltas; outside nodes take their parent's label."""
    labels = fill(pyramid(cells)[0])
    out, starts, palette, n = [], [], [], 0
    for level in range(len(labels) - 1, -1, -1):
        starts.append(n)
        mine = labels[level]
        code = np.full(len(mine), PALETTE_ADV)
        if level < len(labels) - 1:
            up = labels[level + 1]
            at, above = neighbour_table(round(len(mine) ** (1 / 3)))
            near = np.where(at < 0, -2, np.where(above, up[np.maximum(at, 0) % len(up)], mine[np.maximum(at, 0)]))
            for k in (NEIGHBOR_Z, NEIGHBOR_Y, NEIGHBOR_X):
                code[near[:, k - 1] == mine] = k
            code[np.repeat(up, 8) == mine] = PARENT
        pushes = np.flatnonzero(code == PALETTE_ADV)
        previous = np.concatenate([[palette[-1] if palette else -2], mine[pushes[:-1]]]) if len(pushes) else np.empty(0, np.int64)
        again = mine[pushes] == previous
        code[pushes[again]] = PALETTE_LAST
        palette += mine[pushes[~again]].tolist()
        out.append(code)
        n += len(mine)
    return np.concatenate(out).astype(np.uint8), np.array(starts), palette


def read_voxel(symbol, adv_rank, starts: np.ndarray, palette: list[int], side: int, i: int, inv_lod: int) -> int:
    """Label of node ``i`` (Z order) of a level, from ``symbol(k)`` and ``adv_rank(k)`` of the stream."""
    while True:
        k = int(starts[inv_lod]) + i
        op = symbol(k)
        if op == PARENT:
            inv_lod, i = inv_lod - 1, i >> 3
        elif op <= NEIGHBOR_Z:
            at, above = neighbour_table(1 << inv_lod)
            up = bool(above[i, op - 1])
            i = int(at[i, op - 1])
            inv_lod -= up
        else:
            return palette[adv_rank(k) - (op == PALETTE_LAST)]


def read_level(stream: np.ndarray, starts, palette: list[int], inv_lod: int) -> np.ndarray:
    """Labels of a whole level of a complete stream: every node points to the one it copies, and the
    pointers are doubled until all end at palette entries."""
    to = np.arange(int(starts[inv_lod]) + 8**inv_lod)
    for level in range(1, inv_lod + 1):
        up, first = int(starts[level - 1]), int(starts[level])
        code = stream[first : first + 8**level]
        copies = np.flatnonzero(code == PARENT)
        to[first + copies] = up + (copies >> 3)
        copies = np.flatnonzero((code != PARENT) & (code <= NEIGHBOR_Z))
        at, above = (t[copies, code[copies] - 1] for t in neighbour_table(1 << level))
        to[first + copies] = np.where(above, up, first) + at
    while (to[to] != to).any():
        to = to[to]
    ops = stream[: len(to)]
    pushed = np.cumsum(ops == PALETTE_ADV)
    ends = to[int(starts[inv_lod]) :]
    return np.asarray(palette, np.int64)[pushed[ends] - 1]


def constant_below(stream: np.ndarray, starts) -> np.ndarray:
    """For every node of a complete stream, 1 if all operations below it copy their parents."""
    stop = np.ones(len(stream), np.uint8)
    ends = [*[int(s) for s in starts[1:]], len(stream)]
    for level in range(len(starts) - 2, -1, -1):
        a, b, c = int(starts[level]), ends[level], ends[level + 1]
        stop[a:b] = ((stream[b:c] == PARENT) & (stop[b:c] == 1)).reshape(-1, 8).all(1)
    return stop
