"""License scans by patience alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared
from .tokens import token_runs

#: Notices of public licenses.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-GPL-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General "
        "Public License for more details."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General "
        "Public License for more details."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        'and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "BSD-3-Clause": (
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
#: Words that tell a template from another much like it; a place must have them all.
TELLING = {
    "Apache-2.0-line": "apache 2 0",
    "MIT-line": "mit",
    "GPL-line": "general 3",
    "CC-BY-NC-line": "nc",
    "CC-BY-line": "attribution",
    "CC-BY-SA-line": "sharealike",
    "SPDX-MIT": "spdx mit",
    "SPDX-Apache-2.0": "spdx apache 2 0",
    "SPDX-BSD-3-Clause": "spdx bsd 3",
    "SPDX-GPL-3.0-or-later": "spdx gpl 3 later",
    "GPL-3.0-or-later": "3",
    "LGPL-2.1-or-later": "lesser",
    "AGPL-3.0-or-later": "affero",
}
LEAST = 0.8  # of a template's words in order
GAP = 12  # words between two words of a template that still belong to one place


def align(text: list[int], template: list[int]) -> int:
    """How many words of the template a patience alignment pairs with words of the text.

    Ends that agree are paired; then words that occur once on both sides, in the longest run of them that keeps order; then
    the gaps between these, in the same way. A gap without such words pairs its ends alone.
    """
    paired, gaps = 0, [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            a, c, paired = a + 1, c + 1, paired + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d, paired = b - 1, d - 1, paired + 1
        if a == b or c == d:
            continue
        once = Counter(text[a:b])
        place = {w: i for i, w in enumerate(text[a:b], a) if once[w] == 1}
        twice = Counter(template[c:d])
        anchors = [(place[w], j) for j, w in enumerate(template[c:d], c) if twice[w] == 1 and w in place]
        run = _longest_run([i for i, _ in anchors])
        if not run:
            continue
        last_i, last_j = a, c
        for k in run:
            i, j = anchors[k]
            gaps.append((last_i, i, last_j, j))
            paired, last_i, last_j = paired + 1, i + 1, j + 1
        gaps.append((last_i, b, last_j, d))
    return paired


def _longest_run(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence: piles with back pointers."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


class Templates:
    def __init__(self, texts: dict[str, str], least: float, telling: dict[str, str] | None = None) -> None:
        self.names, self.least = list(texts), least
        self.words = [next(token_runs(pa.array([t])))[1] for t in texts.values()]
        self.telling = [next(token_runs(pa.array([(telling or {}).get(n, "")])))[1] for n in self.names]
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.times = np.stack([np.bincount(np.searchsorted(self.vocabulary, w), minlength=len(self.vocabulary)) for w in self.words], axis=1)

    def places(self, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, template, start, end, paired words) of every place that covers a template well enough."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == words)
        row, word = rows[hit], at[hit]
        first = np.searchsorted(rows, np.arange(int(rows[-1]) + 1), "left")
        # A place ends where GAP words follow that are in no template. Its words bound what an alignment can pair.
        new = np.ones(len(hit), bool)
        new[1:] = (row[1:] != row[:-1]) | (np.diff(hit) > GAP)
        place = np.cumsum(new) - 1
        pairs = np.unique(place * len(self.vocabulary) + word)
        bound = np.zeros((int(place[-1]) + 1 if len(place) else 0, len(self.names)), np.int64)
        np.add.at(bound, pairs // len(self.vocabulary), self.times[pairs % len(self.vocabulary)])
        ends = np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)
        for k, t in np.argwhere(bound >= self.least * np.array([len(w) for w in self.words])).tolist():
            lo, hi = int(hit[np.flatnonzero(new)[k]]), int(hit[ends[k]]) + 1
            for a, b, n in self._split(words[lo:hi], t):
                yield int(rows[lo]), t, lo + a - int(first[rows[lo]]), lo + b - int(first[rows[lo]]), n

    def _split(self, text: np.ndarray, t: int) -> Iterator[tuple[int, int, int]]:
        """Alignments in a place. In a long one they are tried where a notice can stand.

        A notice lacks a fifth of its words at most, so of any positions of the template that are one more than that, it has
        one. The positions whose words are rarest in the place are looked up, words that don't occur first; each occurrence
        says where a notice around it would start. Starts that lie close together are one try.
        """
        own, telling = self.words[t], self.telling[t]
        need, m = self.least * len(own), len(own)
        room = m // 4 + 2
        spans = [(0, len(text))]
        if len(text) > m + 2 * room or len(text) > m and self._twice(text, own):
            spans = self._tries(text, own, m - int(np.ceil(need - 1e-9)) + 1, room)
        done = 0
        for a, b in spans:
            a = max(a, done)
            if b - a < need or not np.isin(telling, text[a:b]).all():
                continue
            if (n := align(text[a:b].tolist(), own.tolist())) >= need:
                mine = np.flatnonzero(np.isin(text[a:b], own))
                a, b = a + int(mine[0]), a + int(mine[-1]) + 1
                yield a, min(b, a + m + room), n
                done = min(b, a + m)

    @staticmethod
    def _twice(text: np.ndarray, own: np.ndarray) -> bool:
        once = np.unique(own)
        return bool((np.bincount(np.searchsorted(once, text[np.isin(text, once)]), minlength=len(once)) > 1).all())

    def _tries(self, text: np.ndarray, own: np.ndarray, k: int, room: int) -> list[tuple[int, int]]:
        words, at = np.unique(own, return_inverse=True)
        hit = np.flatnonzero(np.isin(text, words))
        of = np.searchsorted(words, text[hit])
        times = np.bincount(of, minlength=len(words))
        starts = [np.empty(0, np.int64)]
        for j in np.argsort(times[at], kind="stable")[:k].tolist():
            starts.append(hit[of == at[j]] - j)
        starts = np.unique(np.concatenate(starts))
        mine = np.zeros(len(text) + 1, np.int64)
        mine[hit + 1] = 1
        mine, out, i = np.cumsum(mine), [], 0
        while i < len(starts):
            last = int(np.searchsorted(starts, starts[i] + room // 2, "right"))
            a, b = max(0, int(starts[i]) - room), min(len(text), int(starts[last - 1]) + len(own) + room)
            if mine[b] - mine[a] >= self.least * len(own):
                out.append((a, b))
            i = last
        return out


OUT = "doc_id long, license string, coverage double, matched long, start long, end long, copies long"


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = sent.value
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for first, words, rows in token_runs(b.column(1)):
                best: dict[tuple[int, int], list] = {}
                for r, t, start, end, n in templates.places(words, rows) if len(words) else ():
                    old = best.setdefault((r, t), [0, 0, 0, 0])
                    old[:] = [n, start, end, old[3] + 1] if n > old[0] else [*old[:3], old[3] + 1]
                for (r, t), (n, start, end, copies) in best.items():
                    out.append((ids[first + r], templates.names[t], n / len(templates.words[t]), n, start, end, copies))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4), strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, telling: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, coverage, matched, start, end, copies): the best place of each template a document has, and how many.

    Words are runs of letters and digits, A-Z as a-z; places are in words. Every whole text is read where it lies and nothing
    is shuffled. Words in templates mark places; a place whose words could cover ``least`` of a template is aligned with it
    (a long one wherever a notice can stand in it), and counts if it has the words of ``telling``. Null and empty texts have no license, a null doc_id stays null, repeated rows are reported each.
    """
    sent = shared(docs.sparkSession, Templates(templates or TEMPLATES, least, telling if templates else TELLING))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scan(sent), OUT)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
