"""License scan by patience alignment.

A text and a template are aligned on the words that are unique to both: of these anchors the longest increasing
subsequence is kept, and the gaps between neighbouring anchors are aligned in the same way, where other words are unique.
A gap without anchors is matched from both ends, and what is left of it, whatever its size, by an exact longest common
subsequence. The coverage is the share of the template's words that are aligned. Licenses whose wordings differ in a word or
two are told apart by these words: all of them must be aligned, and those of its relatives must not stand between.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, document_words, text_bytes, word_hashes, tidy

#: Share of the template's words, in percent, that must be aligned.
PERCENT = 80

# License notices and the wording of well-known licenses.
TEMPLATES = (
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-notice", "Released under the MIT License."),
    ("AGPL-3.0-notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-notice", "Released under the BSD License."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-SA-4.0-notice", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0-notice", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0-notice", "Released under the CC0 1.0 Universal Public Domain Dedication."),
    ("EPL-2.0-notice", "Licensed under the Eclipse Public License, Version 2.0."),
    ("GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("ISC-notice", "Released under the ISC License."),
    ("LGPL-2.1-notice", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0-notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0-notice", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
)

# The words that tell a license from its relatives (each must be aligned wherever it stands in the template), and
# words of relatives that must not stand between the first and the last aligned word.
TELLING = {
    "Apache-2.0-notice": ("apache 2 0", ""),
    "CC-BY-NC-4.0-notice": ("by nc 4 0", "sa nd"),
    "GPL-3.0-notice": ("gnu general 3", "lesser affero library"),
    "MIT-notice": ("mit", ""),
    "AGPL-3.0-notice": ("affero 3", ""),
    "BSD-notice": ("bsd", ""),
    "CC-BY-4.0-notice": ("by 4 0", "nc sa nd"),
    "CC-BY-NC-SA-4.0-notice": ("by nc sa 4 0", ""),
    "CC-BY-ND-4.0-notice": ("by nd 4 0", "nc"),
    "CC-BY-SA-4.0-notice": ("by sa 4 0", "nc"),
    "CC0-1.0-notice": ("cc0", ""),
    "EPL-2.0-notice": ("eclipse 2 0", ""),
    "GPL-2.0-notice": ("gnu general 2", "lesser affero library"),
    "ISC-notice": ("isc", ""),
    "LGPL-2.1-notice": ("lesser 2 1", ""),
    "LGPL-3.0-notice": ("lesser 3", ""),
    "MPL-2.0-notice": ("mozilla 2 0", ""),
    "Apache-2.0": ("apache 2 0", ""),
    "AGPL-3.0": ("affero 3", ""),
    "GPL-2.0": ("2", "lesser affero"),
    "GPL-3.0": ("3", "lesser affero"),
    "LGPL-3.0": ("lesser 3", "affero"),
    "MPL-2.0": ("mozilla", ""),
}

#: ASCII letters lower-cased, all other ASCII but digits turned into spaces; words are what stands between.
_WORDS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b.get(w) == 1}
        anchors = increasing([(at[w], j) for j, w in enumerate(b[b0:b1], b0) if w in at])
        if anchors:
            out += anchors
            ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            work += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(ends, ends[1:])]
        else:
            out += [(a0 + i, b0 + j) for i, j in common(a[a0:a1], b[b0:b1])]
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, ordered by the second number, in which the first rises: patience piles."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (x, _) in enumerate(pairs):
        p = bisect_left(tops, x)
        back.append(last[p - 1] if p else -1)
        tops[p : p + 1] = [x]
        last[p : p + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence, bit-parallel: one integer of len(b) bits for each position of ``a``.

    Counted from the end, bit q of row i is 0 where one more word of ``b`` makes the subsequence of the rest longer, so
    its zeros below bit len(b) - j are the length for a[i:], b[j:].
    """
    n, full = len(b), (1 << len(b)) - 1
    places: dict = {}
    for q, w in enumerate(reversed(b)):
        places[w] = places.get(w, 0) | 1 << q
    rows = [full]
    for w in reversed(a):
        v = rows[-1]
        u = v & places.get(w, 0)
        rows.append(((v + u) | (v - u)) & full)
    rows.reverse()

    def length(i: int, j: int) -> int:
        return n - j - (rows[i] & ((1 << (n - j)) - 1)).bit_count()

    out, i, j = [], 0, 0
    while i < len(a) and j < n:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif length(i + 1, j) >= length(i, j + 1):
            i += 1
        else:
            j += 1
    return out


def hashes(text: str) -> np.ndarray:
    body = np.frombuffer(text.encode().translate(_WORDS), np.uint8)
    return word_hashes(body, np.array([0, len(body)]))[0]


class Template:
    """A template's words, the positions among them that must be aligned, and words that must not stand between."""

    def __init__(self, name: str, text: str, must: str, never: str):
        self.name, self.words = name, hashes(text)
        self.must = np.flatnonzero(np.isin(self.words, hashes(must)))
        self.never = hashes(never)


class Scanner:
    """Finds templates in the word hashes of texts."""

    def __init__(self, templates: Iterable[tuple[str, str]], percent: int, telling: dict[str, tuple[str, str]]):
        self.templates = [t for t in (Template(*x, *telling.get(x[0], ("", ""))) for x in templates) if len(t.words)]
        self.vocabulary = np.unique(np.concatenate([x for t in self.templates for x in (t.words, t.never)])) if self.templates else np.zeros(0, np.uint64)
        self.plans = []
        for t in self.templates:
            ids = np.searchsorted(self.vocabulary, t.words)
            need = (percent * len(ids) + 99) // 100
            self.plans.append((t.name, ids.tolist(), np.bincount(ids, minlength=len(self.vocabulary)), need, max(16, len(ids)), set(t.must.tolist()), np.searchsorted(self.vocabulary, t.never)))

    def find(self, words: np.ndarray) -> list[tuple[str, int, int, int, int]]:
        """(license, aligned words, words of the template, first and one past the last aligned word of the text)."""
        v = len(self.vocabulary)
        if not v or not len(words):
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, words), v - 1)
        known = self.vocabulary[at] == words
        total = np.bincount(at[known], minlength=v)
        out = []
        for name, ids, count, need, s, must, never in self.plans:
            if np.minimum(total, count).sum() < need:  # aligned words are a part of the shared ones
                continue
            ours = np.where(known, at, -1)
            best = None
            for i in range(0, len(words), s):  # any stretch as long as the template lies whole in one window
                part = ours[i : i + 2 * s]
                if np.minimum(np.bincount(part[part >= 0], minlength=v), count).sum() < need:
                    continue
                pairs = align(part.tolist(), ids)
                if len(pairs) < need or best is not None and len(pairs) <= best[0]:
                    continue
                if must <= {q for _, q in pairs} and not np.isin(part[pairs[0][0] : pairs[-1][0] + 1], never).any():
                    best = (len(pairs), i + pairs[0][0], i + pairs[-1][0] + 1)
            if best:
                out.append((name, best[0], len(ids), best[1], best[2]))
        return out


_OUT = "doc_id long, license string, aligned long, words long, start long, stop long"


def scan_licenses(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, percent: int = PERCENT, telling: dict[str, tuple[str, str]] = TELLING) -> DataFrame:
    """(doc_id, license, aligned, words, start, stop): every document with every template that it covers.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. With s the words of the template
    (16 at least), the windows of a text are its words [i s, (i + 2) s). A template is covered if in some window ``percent`` %
    of its words are aligned, all its telling words among them, and no word of a relative (``telling``: license -> both, as
    texts; a license without an entry has none) stands between the first and the last; the row is that of the window with
    most aligned words, then the first. ``start`` and ``stop``
    number the text's words. Null and empty texts have none; a null id is kept; repeated rows give repeated results; an
    empty table gives no row; other columns are ignored. The templates go to every task; there are few of them.
    """
    scanner = Scanner(templates, percent, telling)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _OUT.split(", ")]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
        for b in batches:
            body, at = text_bytes(b.column("text"))
            flat = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes().translate(_WORDS))])
            ids = b.column("doc_id").to_pylist()
            rows = [(ids[r], *x) for r, w in document_words(flat, lower=False) for x in scanner.find(w)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(tidy(run), _OUT)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
