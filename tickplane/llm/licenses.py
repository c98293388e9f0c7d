"""License scans by patience alignment.

A text's stretch and a template are aligned on the words that occur once in
either; of these anchors the longest increasing subsequence stays, and the gaps
between them are aligned the same way.  What is matched, over the template's
words, is the coverage.

Stretches of STRETCH times the template's words are tried first, so that every
copy of a notice is found.  The length of the longest common subsequence bounds
what any alignment can match, there and in the stretches that follow, so
hopeless stretches are passed over and none that could reach the coverage is.
A template that no stretch covers is then aligned with the whole text, for a
notice with other text put into it: its parts count if each matches PART words.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickplane.llm.spans import points_at
from tickplane.llm.textkernel import CHUNK_BYTES, Texts, joined, span_hashes, text_chunks, tidy, word_pieces, word_spans

COVERAGE = 0.8
#: A stretch has at most this many words for each word of the template.
STRETCH = 1.5
#: In a whole text, more than INSERTED further words part a notice, and a part has PART matched words or more.
INSERTED, PART = 8, 8

#: Fixed texts of public licences' notices.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mit-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "bsd-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not "
        "be removed or altered from any source distribution."
    ),
    "boost-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser "
        "General Public License for more details."
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero "
        "General Public License for more details."
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tops, top_at, before = [], [], []
    for place, value in enumerate(values):
        k = bisect.bisect_left(tops, value)
        tops[k : k + 1] = [value]
        top_at[k : k + 1] = [place]
        before.append(top_at[k - 1] if k else -1)
    out, place = [], top_at[-1] if top_at else -1
    while place >= 0:
        out.append(place)
        place = before[place]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of two sequences, increasing in both.

    Equal ends are matched first; then words that are unique in both anchor the
    rest, and the gaps between anchors are aligned in the same way.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = [pairs[i] for i in _longest_increasing([j for _, j in pairs])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True) if k > i + 1 and m > j + 1]
    return sorted(out)


def _tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and rows of words, punctuation at their ends left off, A-Z folded."""
    start, end, bounds = word_spans(texts)
    size = len(texts.data)
    if not len(start):
        return start, end, np.zeros(0, np.uint64), start
    place, inner = np.arange(size), _ALNUM[texts.data]
    following = np.minimum.accumulate(np.where(inner, place, size)[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(inner, place, -1))
    a, b = following[start], preceding[end - 1] + 1
    keep = (a < end) & (b > a)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))[keep]
    return a[keep], b[keep], span_hashes(texts, a[keep], b[keep]), row


class Templates:
    """Templates as numbers of words; ``holds[word, template]`` says which have the word."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        hashes = [_tokens(joined([t.encode()]))[2] for t in templates.values()]
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        self.words = [np.searchsorted(self.known, h).tolist() for h in hashes]
        self.holds = np.zeros((len(self.known), len(self.names)), bool)
        self.places: list[dict[int, int]] = []
        for i, words in enumerate(self.words):
            self.holds[words, i] = True
            places: dict[int, int] = {}
            for j, word in enumerate(words):
                places[word] = places.get(word, 0) | 1 << j
            self.places.append(places)


def longest_common(words: list[int], places: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence with a template, by its words' bit sets of places."""
    full = (1 << size) - 1
    free = full
    for word in words:
        met = free & places[word]
        free = ((free + met) | (free - met)) & full
    return size - free.bit_count()


def _known_words(texts: Texts, templates: Templates) -> tuple[np.ndarray, ...]:
    """The words that any template has: number in text order, row, byte start and end, word."""
    if len(texts) == 1 and len(texts.data) > CHUNK_BYTES:
        pieces = list(word_pieces(texts))
    else:
        pieces = [(0, texts)]
    out, before = [], 0
    for origin, piece in pieces:
        start, end, hashes, row = _tokens(piece)
        at = np.minimum(np.searchsorted(templates.known, hashes), len(templates.known) - 1)
        hit = np.flatnonzero(templates.known[at] == hashes)
        out.append((hit + before, row[hit], start[hit] + origin, end[hit] + origin, at[hit]))
        before += len(start)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _stretches(number: np.ndarray, row: np.ndarray, word: np.ndarray, words: list[int], places: dict[int, int], need: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, matched) places of the stretches that cover the template, leftmost first, without overlap."""
    reach = int(STRETCH * len(words))
    last = np.arange(need - 1, len(number))
    first = last - (need - 1)
    good = np.flatnonzero((number[last] - number[first] < reach) & (row[first] == row[last]))
    free = -1  # the least number that a stretch may begin at
    for g in good.tolist():
        low = int(number[g])
        if low < free:
            continue
        high = min(int(np.searchsorted(number, low + reach)), int(np.searchsorted(row, row[g], "right")))
        own = word[g:high].tolist()
        bound = longest_common(own, places, len(words))
        if bound < need:
            free = low + need - bound  # a stretch that begins n words later matches at most n more
            continue
        matched = patience(own, words)
        if len(matched) < need:
            continue
        first_, last_ = g + matched[0][0], g + matched[-1][0]
        free = int(number[last_]) + 1
        yield first_, last_, len(matched)


def _interrupted(number: np.ndarray, word: np.ndarray, words: list[int], places: dict[int, int], need: int) -> tuple[int, int, int] | None:
    """(first, last, matched) of a notice in one text that other text interrupts."""
    if longest_common(word.tolist(), places, len(words)) < need:
        return None
    matched = patience(word.tolist(), words)
    parts: list[list[tuple[int, int]]] = []
    for i, j in matched:
        if parts and number[i] - number[parts[-1][-1][0]] - (j - parts[-1][-1][1]) <= INSERTED:
            parts[-1].append((i, j))
        else:
            parts.append([(i, j)])
    kept = [p for part in parts if len(part) >= PART for p in part]
    return (kept[0][0], kept[-1][0], len(kept)) if len(kept) >= need else None


def scan(texts: Texts, templates: Templates, least: float = COVERAGE) -> Iterator[tuple[int, str, float, int, int]]:
    """(row, template, coverage, byte start, byte end) of the stretches that cover a template.

    Stretches of one template are taken leftmost first; where stretches of
    several overlap, as licences quote each other, the one with most matched
    words stays, of equal ones that of the highest coverage.
    """
    if not len(templates.known):
        return
    every: list[tuple[int, int, int, int, str, float]] = []
    number, row, start, end, word = _known_words(texts, templates)
    for t, name in enumerate(templates.names):
        words, places = templates.words[t], templates.places[t]
        need = max(1, math.ceil(least * len(words) - 1e-9))
        own = np.flatnonzero(templates.holds[word, t])
        if len(own) < need or not words:
            continue
        found = list(_stretches(number[own], row[own], word[own], words, places, need))
        if need >= 2 * PART:
            have = {int(row[own[first]]) for first, _, _ in found}
            rows, begin, count = np.unique(row[own], return_index=True, return_counts=True)
            for r, a, n in zip(rows.tolist(), begin.tolist(), count.tolist(), strict=True):
                if n >= need and r not in have and (met := _interrupted(number[own[a : a + n]], word[own[a : a + n]], words, places, need)):
                    found.append((a + met[0], a + met[1], met[2]))
        for first, last, matched in found:
            r = int(row[own[first]])
            every.append((matched, r, int(own[first]), int(own[last]), name, matched / len(words)))
    taken: list[tuple[int, int]] = []
    for _, r, first, last, name, coverage in sorted(every, key=lambda x: (-x[0], -x[5], *x[1:5])):
        place = bisect.bisect(taken, (first, last))
        if (place == 0 or taken[place - 1][1] < first) and (place == len(taken) or last < taken[place][0]):
            taken.insert(place, (first, last))
            origin = int(texts.offsets[r])
            yield r, name, coverage, int(start[first]) - origin, int(end[last]) - origin


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """(id_col, license, coverage, start, end): stretches that cover a licence template.

    ``start`` and ``end`` are code points of the text as it is, from the first
    matched word to the last.  Words are compared without punctuation at their
    ends, A-Z as a-z.  Whole texts are read; null and empty texts have no rows;
    repeated rows repeat theirs; a null id stays null; an empty table gives no
    rows, as do no templates.
    """
    chosen = TEMPLATES if templates is None else templates
    schema = T.StructType([docs.schema[id_col], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(chosen)
        for batch in batches:
            at, made = [], []
            for part in text_chunks(batch.column(1)):
                by_row: dict[int, list] = {}
                for row, *found in scan(part, known, least):
                    by_row.setdefault(row, []).append(found)
                for row, found in by_row.items():
                    place = points_at(part.bytes_of(row), [x for f in found for x in f[2:]])
                    at += [part.first + row] * len(found)
                    made += [(name, coverage, place[a], place[b]) for name, coverage, a, b in found]
            columns = [pa.array([x[i] for x in made], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], schema.names)

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
