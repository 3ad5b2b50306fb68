"""License scan by conditional compression.

Lines with a licence's cue words, joined over short gaps, are candidate blocks.  A block, of any
length, is laid out in bounded windows of words, which overlap so that every place of a template lies
whole in one: windows over all of the block for templates of which words may differ, and windows
around the cues for short ones, of which none may and which hold a cue.  Every window is compressed on
its own and with each template as zstandard raw dictionary; a template that saves bytes is a candidate
there.  Its words are then aligned (edit distance in words, free ends in the window), and a licence
counts only if few words differ.  Where confirmed templates overlap, the one that saves most bytes of
the place stays.

Defined results: a null text counts as empty and has no blocks; a null id is carried; repeated rows
are scanned once each; an empty table gives no rows; blocks are taken whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, slices, text_buffers

# Public wordings of common licences (notice, name or full text), by SPDX-like id.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
)
#: Every template holds one of them; lower case.
CUES = (b"licen", b"copyright", b"spdx", b"redistribut", b"all rights reserved", b"public domain", b"free software", b"permission")
#: Lines without a cue that a block may bridge.
GAP = 3
#: Words that may differ, as a part of the template's; a notice of under ten words allows none.
DIFFERENT = 0.1


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())


def wording_differences(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """(words that differ, first and last place in the block) of the best alignment."""
    number: dict[str, int] = {}
    t, b = (np.array([number.setdefault(w, len(number)) for w in x], np.int64) for x in (template, block))
    steps = np.arange(len(b) + 1)
    row, origin = np.zeros(len(b) + 1, np.int64), steps.copy()
    for k, w in enumerate(t, 1):
        swap, drop = row[:-1] + (b != w), row[1:] + 1
        best = np.concatenate([[k], np.minimum(swap, drop)])
        came = np.concatenate([[0], np.where(swap <= drop, origin[:-1], origin[1:])])
        low = np.minimum.accumulate(best - steps)
        at = np.maximum.accumulate(np.where(best - steps == low, steps, 0))
        row, origin = low + steps, came[at]
    end = int(np.argmin(row))
    return int(row[end]), int(origin[end]), end


def cue_words(block: list[str]) -> list[int]:
    """Places of the words in which a cue begins."""
    text, at = " ".join(block), np.cumsum([0] + [len(w) + 1 for w in block])
    found = [m.start() for cue in CUES for m in re.finditer(re.escape(cue.decode()), text)]
    return sorted({int(k) for k in np.searchsorted(at, found, "right") - 1})


class LicenseScanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        import zstandard

        self.templates = [(name, words(text)) for name, text in templates]
        self.plain = zstandard.ZstdCompressor(level=3)
        self.conditional = []
        for _, w in self.templates:
            known = zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=3)
            self.conditional.append(zstandard.ZstdCompressor(dict_data=known))

    @staticmethod
    def blocks(raw: bytes) -> list[tuple[int, int]]:
        """Byte spans of candidate blocks."""
        low, lines = raw.translate(ASCII_LOWER), []
        for cue in CUES:
            p = low.find(cue)
            while p >= 0:
                a, b = low.rfind(b"\n", 0, p) + 1, low.find(b"\n", p)
                b = len(low) if b < 0 else b
                lines.append((a, b))
                p = low.find(cue, b)
        out: list[tuple[int, int]] = []
        for a, b in sorted(set(lines)):
            if out and low.count(b"\n", out[-1][1], a) <= GAP + 1:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    @staticmethod
    def _allowed(template: list[str]) -> int:
        return int(DIFFERENT * len(template)) if len(template) >= 10 else 0

    def windows(self, k: int, block: list[str], cues: list[int]) -> list[tuple[int, int]]:
        """Ends of the windows that hold every place of a template whole; ``cues`` are the places of cue words."""
        n = len(self.templates[k][1])
        allowed = self._allowed(self.templates[k][1])
        starts = range(allowed - n, len(block), n - allowed) if allowed else [c - n + 1 for c in cues]
        width = 2 * n if allowed else 2 * n - 1
        return [(max(0, x), min(len(block), x + width)) for x in starts if x + width > 0]

    def places(self, k: int, block: list[str], cues: list[int], plain: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
        """Words that differ, by first and last place in the block, of every confirmed place of a template;
        ``plain`` keeps the compressed sizes of windows."""
        template, out = self.templates[k][1], {}
        allowed = self._allowed(template)
        for low, high in self.windows(k, block, cues):
            part = block[low:high]
            if self.saving(k, part, plain, (low, high)) <= 0:
                continue
            seen = set(part)
            if sum(w not in seen for w in template) > allowed:  # as many words differ at least
                continue
            differ, first, last = wording_differences(template, part)
            if differ <= allowed:
                out[low + first, low + last] = differ
        kept: dict[tuple[int, int], int] = {}
        for (x, y), differ in sorted(out.items(), key=lambda p: (p[1], p[0])):  # a window may hold a part of a place
            if not any(x < b and a < y for a, b in kept):
                kept[x, y] = differ
        return kept

    def saving(self, k: int, part: list[str], plain: dict[tuple[int, int], int] | None = None, place: tuple[int, int] = (0, 0)) -> int:
        """Bytes that a template's dictionary saves."""
        data, plain = " ".join(part).encode(), {} if plain is None else plain
        if place not in plain:
            plain[place] = len(self.plain.compress(data))
        return plain[place] - len(self.conditional[k].compress(data))

    def scan(self, raw: bytes) -> list[tuple[int, int, str, int]]:
        """(start, end, licence, words that differ) of every block with a confirmed licence, in bytes."""
        out = []
        for a, b in self.blocks(raw):
            block = words(raw[a:b].decode("utf-8", "replace"))
            if not block:
                continue
            cues, plain, confirmed, taken = cue_words(block), {}, [], []
            found = [(k, *place, differ) for k in range(len(self.templates)) for place, differ in self.places(k, block, cues, plain).items()]
            for _, differ, k, first, last in sorted((-self.saving(k, block[x:y]), differ, k, x, y) for k, x, y, differ in found):
                if not any(first < y and x < last for x, y in taken):
                    confirmed.append((a, b, self.templates[k][0], differ))
                    taken.append((first, last))
            out += dict.fromkeys(confirmed)
        return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row a document: doc_id, n_blocks, licenses (sorted ids), spans (licence:start:end:differences
    of its block in code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates)
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            for first, last in slices(at):
                part, edges = data[at[first] : at[last]].tobytes(), at[first : last + 1] - at[first]
                low = part.translate(ASCII_LOWER)
                rows = set()
                for cue in CUES:
                    p = low.find(cue)
                    while p >= 0:
                        k = int(np.searchsorted(edges, p, "right")) - 1
                        rows.add(k)
                        p = low.find(cue, int(edges[k + 1]))
                n, ids, spans = [0] * (last - first), [""] * (last - first), [""] * (last - first)
                for k in rows:
                    raw = part[edges[k] : edges[k + 1]]
                    n[k], found = len(scanner.blocks(raw)), scanner.scan(raw)
                    place = lambda p, raw=raw: len(raw[:p].decode())
                    ids[k] = ",".join(sorted({f[2] for f in found}))
                    spans[k] = ",".join(f"{f[2]}:{place(f[0])}:{place(f[1])}:{f[3]}" for f in found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(ids), pa.array(spans)], ["doc_id", "n_blocks", "licenses", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_blocks long, licenses string, spans string")
