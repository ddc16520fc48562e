"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Texts and templates become shingles of five lower-case words. For each size m of template in shingles, windows of
SPAN m + t - 1 shingles are laid every t = max(1, m // 2), so one of them covers any copy whole that spans at most
SPAN m shingles, inserted words included; longer ones are no copies. A copy that keeps
``least`` of a template's shingles then has a Jaccard similarity of at least ``worst_similarity`` to its window, and
``bands`` bands of one row collide with probability 1 - (1 - s) ** bands, 0.9999 or more. A text none of whose
shingles is a template's minimum in some band cannot collide, so most texts end at that test. Around each collision
the shingles of the window and of as many to both sides are compared as words with the template's.

Nulls: a null text is empty and has no licenses; a null id stays null. Very long texts are scanned whole. Where several
templates fit a place each is reported, ties in start by name. Repeated rows give repeated results, an empty table none.
Further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import splitmix, worker_state

SHINGLE = 5
#: The longest copy, as a multiple of its template's shingles.
SPAN = 2
_TOKEN = re.compile(r"\w+")

#: Wording of common notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "MIT-disclaimer": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _words(text: str) -> list[str]:
    """Words as they are written; they are folded one by one, as folding a whole text may move its positions."""
    return _TOKEN.findall(text)


class Templates:
    def __init__(self, templates: dict[str, str], least: float = 0.8, bands: int = 28, seed: int = 11):
        self.least, self.bands = least, bands
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands, dtype=np.uint64)
        self.known: dict[str, int] = {}
        self.by_size: dict[int, list] = {}
        minima = []
        for name, text in templates.items():
            words = [w.lower() for w in _words(text)]
            if len(words) < SHINGLE:
                raise ValueError(f"{name} has fewer than {SHINGLE} words")
            grams = Counter(tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1))
            hashes = np.unique(self.hashes(words))
            signature = np.array([self._permuted(hashes, k).min() for k in range(bands)])
            minima += [hashes[self._permuted(hashes, k).argmin()] for k in range(bands)]
            self.by_size.setdefault(len(words) - SHINGLE + 1, []).append((name, grams, signature))
        self.minima = np.unique(np.array(minima, np.uint64))
        if (p := min(map(self.collision_probability, self.by_size), default=1.0)) < 0.9999:
            raise ValueError(f"{bands} bands find a copy with probability {p} only")

    def _permuted(self, hashes: np.ndarray, band: int) -> np.ndarray:
        return splitmix(hashes * self.a[band] + self.b[band])

    def stride(self, m: int) -> int:
        return max(1, m // 2)

    def worst_similarity(self, m: int) -> float:
        kept = self.least * m
        return kept / (SPAN * m + self.stride(m) - 1 + m - kept)

    def collision_probability(self, m: int) -> float:
        return 1 - (1 - self.worst_similarity(m)) ** self.bands

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.lower())
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - SHINGLE + 1
        out = np.zeros(max(0, n), np.uint64)
        for i in range(SHINGLE if n > 0 else 0):
            out = splitmix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        return out

    def _copies(self, words: list[str], lo: int, hi: int, grams: dict[tuple, int]) -> list[tuple[int, int, int]]:
        """(different shingles, first, last) of the copies in shingles lo to hi, one after the other."""
        at = [(i, g) for i in range(lo, hi) if (g := tuple(words[i : i + SHINGLE])) in grams]
        need, most, out, first, k = self.least * len(grams), SPAN * sum(grams.values()), [], 0, 0
        seen: Counter = Counter()
        while k < len(at):
            i, g = at[k]
            seen[g] += 1
            while i - at[first][0] >= most or seen[at[first][1]] > 1 and first < k:
                seen[at[first][1]] -= 1
                first += 1
            n = sum(c > 0 for c in seen.values()) if seen[g] == 1 else 0
            k += 1
            if n >= need:
                last = k - 1
                for j in range(k, len(at)):  # to the copy's end, or where a next one begins
                    i, g = at[j]
                    if i - at[first][0] >= most or seen[g] >= grams[g]:
                        break
                    n += seen[g] == 0
                    seen[g] += 1
                    last = j
                out.append((n, at[first][0], at[last][0]))
                first = k = last + 1
                seen.clear()
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, containment, start, end) in code points, by start; one for each separate place of a template."""
        words = _words(text or "")
        s = self.hashes(words)
        if not len(s):
            return []
        at = np.minimum(np.searchsorted(self.minima, s), len(self.minima) - 1)
        if not (self.minima[at] == s).any():
            return []
        permuted = [self._permuted(s, k) for k in range(self.bands)]
        places, words = [m.span() for m in _TOKEN.finditer(text or "")], [w.lower() for w in words]
        found = []
        for m, templates in self.by_size.items():
            t = self.stride(m)
            width = min(SPAN * m + t - 1, len(s))
            starts = np.arange(0, max(1, len(s) - width + t), t)
            ends = np.minimum(starts + width, len(s))
            signatures = [np.lib.stride_tricks.sliding_window_view(np.append(p, np.full(width, np.uint64(2**64 - 1))), width)[starts].min(axis=1) for p in permuted]
            for name, grams, signature in templates:
                hit = np.zeros(len(starts), bool)
                for k in range(self.bands):
                    hit |= signatures[k] == signature[k]
                done = 0
                for w in np.flatnonzero(hit).tolist():
                    lo, hi = max(done, int(starts[w]) - width), min(len(s), int(ends[w]) + width)
                    # one that begins after the window may end beyond hi; its own windows find it
                    if copies := [c for c in self._copies(words, lo, hi, grams) if c[1] < int(ends[w])]:
                        found += [(name, round(n / len(grams), 6), places[i][0], places[j + SHINGLE - 1][1]) for n, i, j in copies]
                        done = copies[-1][2] + 1
        return sorted(found, key=lambda f: (f[2], f[0]))


def scan_licenses(df: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, licenses) for every row; licenses is an array of (license, containment, start, end).

    Null, empty and shorter texts than a shingle have an empty array. The templates travel with the function.
    """
    match = pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = worker_state(("licenses", tuple(templates.items()), least), lambda: Templates(templates, least)).scan
        for b in parts:
            rows = [[dict(zip(("license", "containment", "start", "end"), f, strict=True)) for f in scan(t.as_py())] for t in b[1]]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(rows, pa.list_(match))], names=["doc_id", "licenses"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, licenses array<struct<license:string,containment:double,start:int,end:int>>")
