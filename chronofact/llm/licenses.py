"""License scans: MinHash bands over overlapping windows, then exact containment.

Templates of like length share a window length, chosen so that every
occurrence lies whole in some window. The number of bands follows from the
least similarity that a window with an occurrence can have, so that it meets
its template in a band with the wanted probability. What a band retrieves is
verified by the share of the template's shingles that the window contains,
word by word. Nothing is shuffled; the templates travel with the plan.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .shingles import byte_word_hashes, hash_functions, minhash, mixed, windows

WIDTH = 3
CONTAINMENT = 0.8
ROWS = 2
COLLISION = 0.9999
SEED = 5

_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software")
_MIT_TERMS = (", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
              "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
              "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
              "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
              "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
              "OTHER DEALINGS IN THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.")
_ISC_TERMS = (" THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
              "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
              "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
              "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met")
_BSD_TWO = (": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution.")
_BSD_THREE = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
              "this software without specific prior written permission.")
_FREE = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."

#: Customary statements, opening notices and, where they are short, whole texts of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": _MIT,
    "MIT-text": _MIT + _MIT_TERMS,
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                         "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-notice": "This program is free software: " + _FREE.format("General Public License", "3"),
    "LGPL-notice": "This library is free software; " + _FREE.format("Lesser General Public License", "2.1"),
    "AGPL-notice": "This program is free software: " + _FREE.format("Affero General Public License", "3"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
                      "software to the public domain worldwide. This software is distributed without any warranty.",
    "BSD-notice": _BSD,
    "BSD-2-Clause-text": _BSD + _BSD_TWO,
    "BSD-3-Clause-text": _BSD + _BSD_TWO + _BSD_THREE,
    "ISC-notice": _ISC,
    "ISC-text": _ISC + _ISC_TERMS,
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                      "distributed with this file, You can obtain one at",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
                      "available at",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                      "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                      "non-commercial, and by any means.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
                 "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
                 "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}

#: Letters in lower case and digits stay, other ASCII becomes a space, the rest of Unicode is kept.
_plain = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_plain)


def bands_for(similarity: float, rows: int = ROWS, collision: float = COLLISION) -> int:
    """Bands so that sets of this similarity share one with probability ``collision``."""
    return max(1, math.ceil(math.log(1 - collision) / math.log(1 - similarity**rows)))


@dataclass(frozen=True)
class LengthClass:
    """Templates of like length: window and step in shingles, and their keys in each band."""

    names: tuple[str, ...]
    window: int
    step: int
    functions: tuple[np.ndarray, np.ndarray]
    keys: tuple[dict[int, tuple[int, ...]], ...]


class Scanner:
    def __init__(self, templates: Mapping[str, str], containment: float = CONTAINMENT):
        self.containment = containment
        words = {n: plain_bytes(t).split() for n, t in templates.items()}
        short = [n for n, w in words.items() if len(w) < WIDTH]
        if short:
            raise ValueError(f"templates of fewer than {WIDTH} words: {short}")
        self.shingles = {n: frozenset(zip(*[w[k:] for k in range(WIDTH)], strict=False)) for n, w in words.items()}
        self.reach = {n: math.ceil(1.1 * (len(w) - WIDTH + 1)) for n, w in words.items()}
        hashed = {n: np.unique(windows(byte_word_hashes(plain_bytes(t))[0], WIDTH)) for n, t in templates.items()}
        self.known = np.unique(np.concatenate(list(hashed.values())))
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.classes: list[LengthClass] = []
        left = sorted(words, key=lambda n: (-len(words[n]), n))
        while left:
            longest = len(words[left[0]]) - WIDTH + 1
            names = tuple(n for n in left if (len(words[n]) - WIDTH + 1) * 1.5 > longest or n == left[0])
            left = [n for n in left if n not in names]
            step = max(1, longest // 4)
            window = math.ceil(1.1 * longest) + step
            least = min(len(hashed[n]) for n in names)
            bands = bands_for(containment * least / (window + (1 - containment) * least))
            functions = hash_functions(bands * ROWS, SEED)
            tables: list[dict[int, list[int]]] = [{} for _ in range(bands)]
            for k, n in enumerate(names):
                for band, key in enumerate(self._keys(hashed[n], functions)):
                    tables[band].setdefault(key, []).append(k)
            self.classes.append(LengthClass(names, window, step, functions, tuple({k: tuple(v) for k, v in t.items()} for t in tables)))

    @staticmethod
    def _keys(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> list[int]:
        signature = minhash(shingles, *functions).astype(np.uint64).reshape(-1, ROWS)
        return mixed((signature[:, 0] << np.uint64(32)) | signature[:, 1]).tolist()

    def _tightest(self, name: str, places: list[int], words: list[bytes]) -> tuple[int, int, float]:
        """First and last place of the run, about as long as the template, that contains most of it.

        A window may reach into the next occurrence.
        """
        best = (places[0], places[0], 0.0) if places else (0, 0, 0.0)
        for first in places:
            run = [i for i in places if first <= i < first + self.reach[name]]
            share = len({tuple(words[i:i + WIDTH]) for i in run}) / len(self.shingles[name])
            if (share, first - run[-1]) > (best[2], best[0] - best[1]):
                best = (first, run[-1], share)
        return best

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first character, last character + 1, containment) of every occurrence, in order.

        Where occurrences of several templates overlap, the most complete, then the longest is given.
        """
        raw = plain_bytes(text or "")
        hashes, starts, ends = byte_word_hashes(raw)
        if len(hashes) < WIDTH:
            return []
        shingles = windows(hashes, WIDTH)
        hits = np.flatnonzero(self.flags[(shingles & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, shingles[hits]), len(self.known) - 1)
        hits = hits[self.known[at] == shingles[hits]]
        if not len(hits):
            return []
        words = raw.split()
        out: list[tuple[int, int, float, str]] = []
        for group in self.classes:
            spans: dict[str, list[tuple[int, int, float]]] = {}
            # only windows with a shingle of some template can resemble one
            near = (hits[:, None] // group.step - np.arange(-(-group.window // group.step) + 1)[None, :]).ravel()
            for index in np.unique(near[near >= 0]).tolist():
                start = index * group.step
                part = shingles[start:start + group.window]
                keys = self._keys(part, group.functions)
                found = {k for table, key in zip(group.keys, keys, strict=True) for k in table.get(key, ())}
                for k in sorted(found):
                    name = group.names[k]
                    places = [i for i in range(start, start + len(part)) if tuple(words[i:i + WIDTH]) in self.shingles[name]]
                    first, last, share = self._tightest(name, places, words)
                    if share >= self.containment:
                        spans.setdefault(name, []).append((first, last + WIDTH, share))
            for name, listed in spans.items():
                out.extend((*span, name) for span in _best(listed, lambda s: (-s[2], s[1] - s[0], s[0])))
        return [(name, len(raw[:starts[a]].decode("utf-8", "replace")), len(raw[:ends[b - 1]].decode("utf-8", "replace")), share)
                for a, b, share, name in _best(out, lambda s: (-s[2], s[0] - s[1], s[3]))]


def _best(spans: list[tuple], order: Callable[[tuple], tuple]) -> list[tuple]:
    """Spans (start, end, ...) in ``order`` unless a better one overlaps them, then by start."""
    out: list[tuple] = []
    group: list[tuple] = []
    reach = 0
    for span in [*sorted(spans), None]:
        if group and (span is None or span[0] >= reach):
            chosen: list[tuple] = []
            for s in sorted(group, key=order):
                if all(s[1] <= c[0] or c[1] <= s[0] for c in chosen):
                    chosen.append(s)
            out.extend(sorted(chosen))
            group = []
        if span is not None:
            group.append(span)
            reach = span[1] if len(group) == 1 else max(reach, span[1])
    return out


@functools.lru_cache(4)
def _scanner(templates: tuple[tuple[str, str], ...], containment: float) -> Scanner:
    return Scanner(dict(templates), containment)


def find_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES,
                  containment: float = CONTAINMENT) -> DataFrame:
    """``key, license, start_char, end_char, containment``: a row per occurrence of a template in a whole text.

    Case and punctuation do not count. Null, empty and license-free texts have
    no rows, repeated rows have theirs each, and other columns are not looked
    at. Templates need three words; of overlapping occurrences the most complete,
    then the longest gives the row.
    """
    listed = tuple(templates.items())
    schema = T.StructType([docs.schema[key], T.StructField("license", T.StringType()), T.StructField("start_char", T.IntegerType()),
                           T.StructField("end_char", T.IntegerType()), T.StructField("containment", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(listed, containment)
        for batch in batches:
            found = [(i, *hit) for i, t in enumerate(batch.column(text).to_pylist()) for hit in scanner.scan(t)]
            rows, names, starts, ends, shares = zip(*found, strict=True) if found else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int32()),
                 pa.array(ends, pa.int32()), pa.array(shares, pa.float64())], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
