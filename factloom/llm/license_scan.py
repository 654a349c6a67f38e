"""License scans: an inverted index of winnowed template fingerprints picks candidates, banded alignment confirms them.

Templates are split into words. As many edits as the coverage allows, wherever they are, leave some row of words whole (2 to 4
words at 0.8, by the template's length). Fingerprints are hashes of a few words in a row, and of each ``window`` of them next to each other the
least is kept, in templates and documents alike; word count and window fill the row that stays whole, so one kept
fingerprint of it is in both. Rows of two words have a window of one: of them every fingerprint is kept. Hits on one template near one
diagonal make a candidate; a local alignment in a band around it counts the matched words, with its span in the document.
Matches that cover enough of their template are returned, unless another license's match in the same place has as many
words with fewer edits (CC BY in a CC BY-SA notice).

The index is as large as the given templates; it travels with the job, and documents are scanned in one pass,
in time that grows with their length.

Edge cases: null and empty texts match nothing; templates of fewer than five words are refused. Spans count characters of
the text as given, also where its lower case is longer. A template that comes twice in a document gives two rows. Repeated documents are scanned each for itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import table

WORD = re.compile(r"[^\W_]+")
SHORTEST = 5
BAND = 8
COVERAGE = 0.8

# Notices of public licenses.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def words_of(text: str) -> list[str]:
    """Lower-cased words, one for each match of WORD in the text as it is: lower-casing may lengthen a text and split its words."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def gram_of(n: int, coverage: float = COVERAGE) -> int:
    """Words in a row that stay whole somewhere in a template of n words after as many edits as the coverage allows."""
    edits = int(n - coverage * n + 1e-9)
    return max(1, -(-(n - edits) // (edits + 1)))


def window_of(n: int, coverage: float = COVERAGE) -> tuple[int, int]:
    """(words of a fingerprint, fingerprints of a window) for a template of n words: together they span what stays whole."""
    whole = gram_of(n, coverage)
    return (whole - 1, 2) if whole > 2 else (whole, 1)


def _kept(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every window, the last of equal ones; 0 is no hash."""
    if window == 1 or len(h) < window:
        return np.flatnonzero(h)
    by = np.where(h > 0, h, np.uint64(2**64 - 1))
    wide = np.lib.stride_tricks.sliding_window_view(by, window)[:, ::-1]
    at = np.unique(np.arange(len(wide)) + window - 1 - wide.argmin(1))
    return at[h[at] > 0]


def _hash(ids: np.ndarray, gram: int) -> np.ndarray:
    """Of every ``gram`` ids in a row; rows with an unknown word (-1) get 0."""
    n = len(ids) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(gram):
        part = ids[k : k + n]
        known &= part >= 0
        out = (out + (part + 2).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.where(known, out | np.uint64(1), np.uint64(0))


class Index:
    def __init__(self, templates: Mapping[str, str], coverage: float = COVERAGE):
        self.names, self.vocabulary = list(templates), {}
        self.words: list[np.ndarray] = []
        entries: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for t, text in enumerate(templates.values()):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int32)
            if len(ids) < SHORTEST:
                raise ValueError(f"template {self.names[t]} has fewer than {SHORTEST} words")
            self.words.append(ids)
            gram, window = window_of(len(ids), coverage)
            h = _hash(ids, gram)
            entries.setdefault((gram, window), []).extend((int(h[i]), t, i) for i in _kept(h, window).tolist())
        #: By length and window: hashes (sorted), their templates and places.
        self.grams = {g: (np.array([e[0] for e in sorted(x)], np.uint64), np.array([e[1] for e in sorted(x)], np.int64), np.array([e[2] for e in sorted(x)], np.int64)) for g, x in entries.items()}

    def band(self, template: int) -> int:
        """Narrower than a template is long, so that a repeat right after it has a band of its own."""
        return min(BAND, max(1, len(self.words[template]) // 4))

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Rows (template, place in the document, place in the template)."""
        out = [np.empty((0, 3), np.int64)]
        for (gram, window), (hashes, template, place) in self.grams.items():
            h = _hash(ids, gram)
            at = _kept(h, window)
            lo, hi = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], side="right")
            n = hi - lo
            row = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            out.append(np.stack([template[row], np.repeat(at, n), place[row]], 1))
        return np.concatenate(out)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal): hits in order of their diagonal, one candidate while it moves within the band."""
        hits = self.hits(ids)
        out: list[tuple[int, int]] = []
        last = None
        for t, d in np.unique(np.stack([hits[:, 0], hits[:, 1] - hits[:, 2]], 1), axis=0).tolist():
            if last is None or t != last[0] or d > last[1] + self.band(t):
                out.append((t, d))
                last = (t, d)
        return out


def align(template: np.ndarray, docs: list[np.ndarray], diagonals: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of one template with each document in a band around its diagonal: matched words, from, to (in words).

    A match scores 2, a mismatch or a gap -1; all documents side by side.
    """
    c, width = len(docs), 2 * band + 1
    size = max(map(len, docs)) + 2 * band + len(template) + 2
    text = np.full((c, size), -1, np.int64)
    pad = band + len(template)
    for i, d in enumerate(docs):
        text[i, pad : pad + len(d)] = d
    every = np.arange(c)
    zero = np.zeros(c, np.int64)
    best, result = zero.copy(), [zero.copy() for _ in range(3)]
    above = [(zero, zero, zero)] * (width + 1)  # score, matched, from
    for i, word in enumerate(template):
        row: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for o in range(width):
            j = diagonals + i + o - band
            inside = (j >= 0) & (j + pad < size)
            same = inside & (text[every, np.clip(j + pad, 0, size - 1)] == word)
            score, matched, start = above[o]
            start = np.where(score > 0, start, j)
            score, matched = score + np.where(same, 2, -1), matched + same
            for other in (above[o + 1], *row[-1:]):
                up = other[0] - 1 > score
                score, matched, start = np.where(up, other[0] - 1, score), np.where(up, other[1], matched), np.where(up, other[2], start)
            score, matched = np.maximum(score, 0), np.where(score > 0, matched, 0)
            row.append((score, matched, start))
            more = score > best
            best = np.where(more, score, best)
            result = [np.where(more, x, y) for x, y in zip((matched, start, j + 1), result, strict=True)]
        above = [*row, (zero, zero, zero)]
    return result[0], result[1], result[2]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, text: str = "text", doc_id: str = "doc_id", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, n_matched, from_char, to_char), one row a match; to_char is excluded."""
    index = Index(templates, coverage)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.vocabulary.get
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found: dict[int, list[tuple[int, int]]] = {}
            words: dict[int, np.ndarray] = {}
            for row, t in enumerate(texts):
                if not t:
                    continue
                w = np.array([get(x, -1) for x in words_of(t)], np.int32)
                for template, diagonal in index.candidates(w):
                    found.setdefault(template, []).append((row, diagonal))
                    words[row] = w
            out, places = [], {}
            for template, rows in sorted(found.items()):
                for row in {r for r, _ in rows} - places.keys():
                    places[row] = np.array([m.span() for m in WORD.finditer(texts[row])])
                out += _confirm(index, template, rows, words, places, coverage)
            out = sorted(x[:6] for x in _best(out))
            cols = [pa.array([ids[r[0]] for r in out], batch.column(0).type), *(pa.array([r[i] for r in out], t) for i, t in ((3, pa.string()), (4, pa.float64()), (5, pa.int32()), (1, pa.int32()), (2, pa.int32())))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "license", "coverage", "n_matched", "from_char", "to_char"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, license string, coverage double, n_matched int, from_char int, to_char int")


def _confirm(index: Index, template: int, rows: list[tuple[int, int]], words: dict[int, np.ndarray], places: dict[int, np.ndarray], coverage: float) -> list[tuple]:
    """(row, from_char, to_char, license, coverage, matched, edits) of the candidates that match; of overlapping ones the best, then the first."""
    known, out, band = index.words[template], [], index.band(template)
    spans: list[tuple[int, int, int, int]] = []
    for k in range(0, len(rows), 512):
        some = rows[k : k + 512]
        lo = np.array([max(0, d - band) for _, d in some])
        parts = [words[r][x : x + len(known) + 3 * band] for (r, _), x in zip(some, lo.tolist(), strict=True)]
        matched, start, end = align(known, parts, np.array([d for _, d in some]) - lo, band)
        good = np.flatnonzero(matched >= coverage * len(known)).tolist()
        spans += [(-int(matched[i]), some[i][0], int(start[i] + lo[i]), int(end[i] + lo[i])) for i in good]
    taken: dict[int, list[tuple[int, int]]] = {}
    for less, r, x, y in sorted(spans):
        mine = taken.setdefault(r, [])  # apart from each other, in order
        at = bisect_left(mine, (x, y))
        if at and mine[at - 1][1] > x or at < len(mine) and mine[at][0] < y:
            continue
        mine.insert(at, (x, y))
        here = places[r]
        out.append((r, int(here[min(x, len(here) - 1)][0]), int(here[min(y, len(here)) - 1][1]), index.names[template], -less / len(known), -less, len(known) + y - x + 2 * less))
    return out


def _best(found: list[tuple]) -> list[tuple]:
    """Without the matches that overlap one of another license with as many words and fewer edits. Those of one license are apart, so few are open at a place."""
    worse = lambda x, y: x[3] != y[3] and y[1] < x[2] and x[1] < y[2] and y[5] >= x[5] and y[6] < x[6]
    opened: list[int] = []
    lost: set[int] = set()
    order = sorted(range(len(found)), key=lambda i: found[i][:3])
    for i in order:
        x = found[i]
        opened = [j for j in opened if found[j][0] == x[0] and found[j][2] > x[1]]
        for j in opened:
            if worse(x, found[j]):
                lost.add(i)
            if worse(found[j], x):
                lost.add(j)
        opened.append(i)
    return [found[i] for i in order if i not in lost]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
