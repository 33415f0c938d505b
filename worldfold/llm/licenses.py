"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are winnowed: of the hashes of ``gram`` words, the least of every ``window`` neighbours goes into an inverted index
(of a template with fewer grams, its least). All grams of all documents are looked up, so whatever shares ``gram + window - 1`` words in a
row with a template, or holds all of a shorter one, is a candidate. Hits on neighbouring diagonals (place in the document less
place in the template) are one candidate; the stretch of the document around them is aligned with the template, word by
word, in a band around these diagonals, for the best local score (equal words +1, other words or gaps -1).

A report has the matched words, their share of the template (coverage) and the span in the document. Of reports whose
spans overlap, the one with more matched words stays, then the higher coverage, then the first template by name.

Defined cases: null and empty texts, null ids and empty templates have no report; repeated rows are scanned row by row; several
places of one template in a document are several reports; empty tables give an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .suffix_dedup import sliding
from .words import chunks, plain, window_hashes, words

TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
    this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
    "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
    HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
    ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
    compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
    required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
    BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
    language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
    General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
    option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
    without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
    MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


@dataclass(frozen=True)
class Scan:
    gram: int = 3
    window: int = 4
    band: int = 8
    #: Words that a copy may have between two of its parts, at most (and no more than the template): they are aligned as one.
    reach: int = 40
    coverage: float = 0.8


def align(doc: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment of ``template`` with ``doc`` on diagonals ``low`` to ``high``: matched words, begin, end in doc.

    Of equal scores the first in the template's, then the document's order.
    """
    width = high - low + 1
    dead = (0, 0, 0)  # score, matched, begin
    before: list[tuple[int, int, int]] = [dead] * (width + 1)
    best = (0, 0, 0, 0)
    n, words_ = len(doc), doc.tolist()
    for i, word in enumerate(template.tolist()):
        now: list[tuple[int, int, int]] = [dead] * (width + 1)
        left = dead
        for k in range(width):
            j = i + low + k
            if j < 0 or j >= n:
                left = dead
                continue
            s, m, b = before[k]
            if s == 0:
                m, b = 0, j
            cell = (s + 1, m + 1, b) if words_[j] == word else (s - 1, m, b)
            up = before[k + 1]  # a template word without partner
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, left[1], left[2])
            if cell[0] <= 0:
                cell = dead
            now[k] = left = cell
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
        before = now
    return best[1:]


class Library:
    def __init__(self, templates: Mapping[str, str], how: Scan) -> None:
        self.how, self.names = how, sorted(templates)
        h, offsets = words(pa.array([templates[n] for n in self.names], pa.string()))
        self.terms = [h[a:b] for a, b in zip(offsets, offsets[1:])]
        key, of, place = [], [], []
        for t, terms in enumerate(self.terms):
            g = window_hashes(terms, how.gram)
            least = sliding(g, min(how.window, max(len(g), 1)), np.minimum)
            at = np.flatnonzero(np.isin(g, least))
            key.append(g[at]), of.append(np.full(len(at), t)), place.append(at)
        key, of, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (key, of, place))
        order = np.argsort(key, kind="stable")
        self.key, self.of, self.place = key[order], of[order], place[order]

    def _places(self, doc: np.ndarray, t: int, low: int, high: int, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(matched, begin, end) in ``doc[begin:end]``: the best place, and then any before and after it."""
        todo = [(begin, end)]
        while todo:
            begin, end = todo.pop()
            matched, a, b = align(doc[begin:end], self.terms[t], low - begin, high - begin)
            if matched and matched >= self.how.coverage * len(self.terms[t]) - 1e-9:
                yield matched, begin + a, begin + b
                todo += [(begin, begin + a), (begin + b, end)]

    def reports(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(row, template, matched, begin, end) before overlaps are settled."""
        h, offsets = words(batch.column("text"))
        g = window_hashes(h, self.how.gram)
        if not len(g) or not len(self.key):
            return
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[: len(g)]
        hit = np.flatnonzero((np.searchsorted(self.key, g, "right") > np.searchsorted(self.key, g, "left")) & (np.arange(len(g)) + self.how.gram <= offsets[1:][doc]))
        found: dict[tuple[int, int], list[int]] = {}
        for p in hit.tolist():
            a, b = np.searchsorted(self.key, g[p], "left"), np.searchsorted(self.key, g[p], "right")
            for k in range(a, b):
                found.setdefault((int(doc[p]), int(self.of[k])), []).append(p - int(offsets[doc[p]]) - int(self.place[k]))
        for (row, t), diagonals in found.items():
            own = h[offsets[row] : offsets[row + 1]]
            group: list[int] = []
            reach = max(self.how.band, min(self.how.reach, len(self.terms[t])))
            for d in [*sorted(set(diagonals)), None]:
                if group and (d is None or d - group[-1] > reach or d - group[0] > 4 * reach):
                    low, high = group[0] - self.how.band, group[-1] + self.how.band
                    yield from ((row, t, *found_) for found_ in self._places(own, t, low, high, max(0, low), min(len(own), high + len(self.terms[t]))))
                    group = []
                if d is not None:
                    group.append(d)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, how: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, matched_words, coverage, begin_word, end_word of every report. No shuffle: the templates go to the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(templates, how)
        for batch in chunks(batches):
            by: dict[int, list[tuple]] = {}
            for row, t, matched, begin, end in library.reports(batch):
                by.setdefault(row, []).append((-matched, -matched / len(library.terms[t]), library.names[t], begin, end))
            ids, out = batch.column("doc_id").to_pylist() if by else [], []
            for row, reports in by.items():
                kept: list[tuple] = []
                for r in sorted(reports):
                    if all(r[4] <= k[3] or k[4] <= r[3] for k in kept):
                        kept.append(r)
                out += [(ids[row], name, -m, round(-c, 6), a, b) for m, c, name, a, b in sorted(kept, key=lambda r: r[3])]
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "license", "matched_words", "coverage", "begin_word", "end_word"])

    slim = plain(docs, id_col, text_col).where("doc_id is not null and text is not null")
    return slim.mapInArrow(run, "doc_id long, license string, matched_words long, coverage double, begin_word long, end_word long")
