"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

A template belongs to the window width (in shingles, a power of two) that is
less than twice its own length up to the stride. Windows of each width
overlap by three quarters, so a text that holds the template has a window that
holds all of it, with a Jaccard similarity of at least ``LEAST``, even with the
share of words changed that verification allows. ``BANDS`` bands of ``ROWS``
MinHash values make such a window share a band with the template with a
probability of over 0.99 (``collision``). A template of ``_SHORT`` shingles or
fewer is too small a share of any window for that: it is looked up by each of its
shingles instead, which misses none. Candidates are then counted exactly:
the share of the template's distinct shingles that the window, widened to its
neighbours, holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from recollect.llm.arrow_text import mix64, shingles, slices, words
from recollect.llm.common import need, table

#: Openings, names and notices of common licences, as their publishers give them.
TEMPLATES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-name": "released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-name": "Licensed under the Apache License, Version 2.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-name": "licensed under the GNU General Public License, version 3.",
    "lgpl-name": "licensed under the GNU Lesser General Public License, version 3.",
    "agpl-name": "licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-4.0-name": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-name": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-name": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced or transmitted in any form without permission.",
    "all-rights-reserved-name": "All rights reserved.",
}

_MIT_GRANT = TEMPLATES["mit-grant"] + ", subject to the following conditions:"
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_BLAME = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_SOURCE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_BLAME = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_DOMAIN = (
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
)

#: Whole licence texts (their windows are up to 512 shingles wide).
TEMPLATES |= {
    "mit-full": " ".join([_MIT_GRANT, _MIT_KEEP, TEMPLATES["mit-warranty"], _MIT_BLAME]),
    "bsd-2-clause-full": " ".join([_BSD_SOURCE, _BSD_BINARY, _BSD_BLAME]),
    "bsd-3-clause-full": " ".join([_BSD_SOURCE, _BSD_BINARY, _BSD_NAMES, _BSD_BLAME]),
    "isc-full": TEMPLATES["isc-grant"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-full": " ".join([TEMPLATES["unlicense"], _DOMAIN, TEMPLATES["mit-warranty"], _MIT_BLAME]),
    "gpl-notice-full": TEMPLATES["gpl-notice"] + " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "apache-2.0-notice-full": TEMPLATES["apache-2.0-notice"] + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "boost-1.0-full": "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
}

SHINGLE = 2
CONTAINMENT = 0.8
BANDS, ROWS = 16, 1
LEAST = 0.3
#: Widths of windows, in shingles; the stride is a quarter of the width.
_SMALLEST = 8
#: Templates of so few shingles have windows of half the smallest width, and are found without bands.
_SHORT = 3

_A = (mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_B = mix64(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64)).astype(np.uint32)
_TOP, _LOW = np.uint32(0xFFFFFFFF), np.uint32(0xFFFF)


def collision(jaccard: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - jaccard**rows) ** bands


def normalise(col: pa.Array) -> pa.Array:
    """Lower case; signs that only decorate a word (quotes, brackets, stops, asterisks) become white space."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(col, "")), r"[\"'`()\[\]{}<>,;:.!?*#|]+", " ")


def _minhash(x: np.ndarray, heads: np.ndarray, f: int) -> np.ndarray:
    """Smallest value of hash function ``f`` in each stretch."""
    return np.minimum.reduceat(x * _A[f] + _B[f], heads)


@dataclass
class Index:
    """Templates by window width: band keys, and their shingles for the exact count."""

    names: list[str]
    shingle: list[np.ndarray]
    length: list[int]
    width: list[int]
    keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    short: list[int]


def _band_keys(mins: np.ndarray) -> np.ndarray:
    """(bands, n) uint64 keys of (functions, n) minima."""
    m = mins.reshape(BANDS, ROWS, -1).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix64(key ^ m[:, r])
    return key


def index(templates: dict[str, str]) -> Index:
    names, sets, length, width = [], [], [], []
    keys: dict[int, list] = {}
    short = []
    for name in sorted(templates):
        h, _ = shingles(words(normalise(pa.array([templates[name]]))), SHINGLE)
        if len(h) == 0:
            raise ValueError(f"template {name} has under {SHINGLE} words")
        w = _SMALLEST // 2 if len(h) <= _SHORT else _SMALLEST
        # a text that starts anywhere, on a grid of w / 4, must fit into one window
        while w - w // 4 < len(h):
            w *= 2
        if w < _SMALLEST:
            short.append(len(names))
        else:
            mins = np.stack([(h.astype(np.uint32) * _A[f] + _B[f]).min(keepdims=True) for f in range(BANDS * ROWS)])
            keys.setdefault(w, []).append((_band_keys(mins)[:, 0], len(names), mins[::ROWS, 0] & _LOW))
        names.append(name)
        sets.append(np.unique(h))
        length.append(len(h))
        width.append(w)
    flat = {}
    for w, entries in keys.items():
        k = np.concatenate([e[0] for e in entries])
        t = np.repeat([e[1] for e in entries], BANDS)
        order = np.argsort(k, kind="stable")
        maybe = np.zeros((BANDS, 1 << 16), dtype=bool)
        for e in entries:
            maybe[np.arange(BANDS), e[2]] = True
        flat[w] = (k[order], t[order], maybe)
    return Index(names, sets, length, width, flat, short)


def candidates(h: np.ndarray, first: np.ndarray, ix: Index) -> np.ndarray:
    """Rows (document, start, end, template) of windows that share a band with a template of their width, or a shingle with a short one; start, end: shingles of the slice."""
    count = np.diff(first)
    stride = _SMALLEST // 4
    blocks = -(-count // stride)
    total = int(blocks.sum())
    if total == 0:
        return np.zeros((0, 4), np.int64)
    doc = np.repeat(np.arange(len(count)), blocks)
    upto = np.append(0, np.cumsum(blocks))
    heads = first[doc] + (np.arange(total) - upto[doc]) * stride
    x = h.astype(np.uint32)
    mins = np.stack([_minhash(x, heads, f) for f in range(BANDS * ROWS)])
    out = []
    for t in ix.short:
        spot = np.flatnonzero(np.isin(h, ix.shingle[t]))
        own = np.searchsorted(first, spot, side="right") - 1
        out.append(np.stack([own, np.maximum(spot - ix.width[t], first[own]), np.minimum(spot + ix.width[t], first[own + 1]), np.full(len(spot), t)], axis=1))
    w = _SMALLEST
    while ix.keys:
        # minima of windows of four blocks, from block to block; past the document's end there is nothing
        n = mins.shape[1]
        window = mins.copy()
        for k in range(1, min(4, n)):
            within = doc[: n - k] == doc[k:]
            np.minimum(window[:, : n - k], np.where(within, mins[:, k:], _TOP), out=window[:, : n - k])
        if w in ix.keys:
            keys, owner, maybe = ix.keys[w]
            # few windows pass the table of the minima's low bits; only theirs are looked up
            near = np.unique(np.flatnonzero(maybe[np.arange(BANDS)[:, None], window[::ROWS] & _LOW].ravel()) % n)
            seen = _band_keys(window[:, near]).ravel()
            lo, hi = np.searchsorted(keys, seen, side="left"), np.searchsorted(keys, seen, side="right")
            reps = hi - lo
            block = np.repeat(near[np.arange(len(seen)) % max(len(near), 1)], reps)
            template = owner[np.repeat(lo, reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)]
            start = first[doc[block]] + (block - upto[doc[block]]) * stride
            out.append(np.stack([doc[block], start, np.minimum(start + w, first[doc[block] + 1]), template], axis=1))
        if w >= max(ix.keys):
            break
        # blocks of twice the stride
        local = np.arange(n) - upto[doc]
        heads2 = np.flatnonzero(local % 2 == 0)
        mins = np.minimum.reduceat(mins, heads2, axis=1)
        doc = doc[heads2]
        upto = np.append(0, np.cumsum(np.bincount(doc, minlength=len(count))))
        w, stride = 2 * w, 2 * stride
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 4), np.int64)


def matches(h: np.ndarray, at: np.ndarray, first: np.ndarray, ix: Index, containment: float = CONTAINMENT) -> list[tuple[int, int, int, int, float]]:
    """Verified (document, template, first word, end word, containment), the best place of every stretch of windows of a document and template."""
    found: list[tuple[int, int, int, int, float]] = []
    rows = candidates(h, first, ix)
    for d, t in np.unique(rows[:, [0, 3]], axis=0).tolist():
        own = rows[(rows[:, 0] == d) & (rows[:, 3] == t)]
        stretch = np.cumsum(np.append(0, own[1:, 1] > own[:-1, 2]))
        goal, need_ = ix.shingle[t], containment * len(ix.shingle[t]) - 1e-9
        for s in range(int(stretch[-1]) + 1):
            part = own[stretch == s]
            # neighbours are taken in, as a window with changed words may be the only one found
            lo, hi = max(int(part[0, 1]) - ix.width[t] // 4, first[d]), min(int(part[-1, 2]) + ix.width[t] // 4, first[d + 1])
            where = np.flatnonzero(np.isin(h[lo:hi], goal))
            if len(where) == 0:
                continue
            # the template's copies: cut where two of its shingles are further apart than its width
            for run in np.split(where, np.flatnonzero(np.diff(where) > ix.width[t]) + 1):
                have = len(np.unique(h[lo + run]))
                if have >= need_:
                    found.append((d, t, int(at[lo + run[0]]), int(at[lo + run[-1]]) + SHINGLE, have / len(goal)))
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, first_word, end_word, containment), a row for each verified copy of a template.

    Words are counted in the normalised text (see ``normalise``). A place that
    holds two templates, one inside the other, gives a row for each. Null and
    empty texts and those shorter than a shingle have no rows; a null ``doc_id`` is
    carried along; repeated rows give repeated rows; long texts are scanned whole;
    other columns are ignored.
    """
    ix = index(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                w = words(normalise(b.column("text")), lower=False)
                h, at = shingles(w, SHINGLE)
                per = np.maximum(w.count - SHINGLE + 1, 0)
                first = np.append(0, np.cumsum(per))
                rows = matches(h, at, first, ix, containment)
                if not rows:
                    continue
                d, t, s, e, c = (np.array(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()).take(pa.array(d)), pa.array([ix.names[i] for i in t]), pa.array(s - w.first[d]), pa.array(e - w.first[d]), pa.array(c)], ["doc_id", "license", "first_word", "end_word", "containment"])

    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, license string, first_word long, end_word long, containment double")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
