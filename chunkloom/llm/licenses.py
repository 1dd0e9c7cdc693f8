"""License scans by patience alignment.

A text region and a license template are aligned on the words that occur exactly once in
each: the longest increasing subsequence of those pairs are anchors, and the gaps between
anchors are aligned the same way, after equal words at a gap's ends are matched off. The
share of the template's words that align is its coverage. A notice may be repeated close
by, which leaves no word that occurs once: a region is also looked for between the
neighbouring copies of one of its words, where that word is an anchor at least.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batcher, text_batches

WORD = re.compile(r"\w+")

# Public license notices (SPDX name, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Words that say little: a region is never looked for by them alone if others suffice.
COMMON = frozenset("the of and to in for is by with under this or a an as be on any that are it you can at version".split())


@dataclass(frozen=True)
class Params:
    least_coverage: float = 0.8


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, which come by their first number, whose second ones increase."""
    piles: list[int] = []
    tops: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(piles, y)
        piles[k : k + 1], tops[k : k + 1] = [y], [i]
        back[i] = tops[k - 1] if k else -1
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = _increasing([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in where])
        if not anchors:
            continue
        x, y = a0, b0
        for i, j in anchors:
            out.append((i, j))
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
        todo.append((x, a1, y, b1))
    return sorted(out)


class Scanner:
    def __init__(self, p: Params = Params(), templates=TEMPLATES):
        self.p = p
        self.templates = []
        signs: dict[str, set[int]] = {}
        for name, text in templates:
            words = WORD.findall(text.lower())
            n, spare = Counter(words), (1 - p.least_coverage) * len(words) + 1e-9
            for w in sorted(n, key=lambda w: (w in COMMON, n[w], -len(w), w)):
                signs.setdefault(w, set()).add(len(self.templates))
                spare -= n[w]
                if spare < 0:  # a region with the coverage has one of these words
                    break
            self.templates.append((name, words, n))
        self.signs = signs
        self.any_sign = re.compile("|".join(rf"\b{re.escape(w)}\b" for w in sorted(signs, key=lambda w: (-len(w), w))))

    def _best(self, words: list[str], t: int, lo: int, hi: int) -> tuple | None:
        template = self.templates[t][1]
        pairs = align(words[lo:hi], template)
        # The region is where the aligned words lie densest: drop stragglers at its ends.
        while pairs and pairs[-1][0] - pairs[0][0] + 1 > 1.5 * len(template):
            head, tail = (pairs[1][0] - pairs[0][0] if len(pairs) > 1 else 0), (pairs[-1][0] - pairs[-2][0] if len(pairs) > 1 else 0)
            pairs = pairs[1:] if head >= tail else pairs[:-1]
        if not pairs or len(pairs) < self.p.least_coverage * len(template):
            return None
        s, e = lo + pairs[0][0], lo + pairs[-1][0] + 1
        return (len(pairs) / max(len(template), e - s), len(pairs), -t, s, e, len(pairs) / len(template))

    def _around(self, words: list[str], t: int, i: int, end: int, same: list[int]) -> list[tuple]:
        """Regions near the sign word at i, which is also at `same`, past `end`: in all words
        around it, and in those that hold it no more often than the template does."""
        size, n = len(self.templates[t][1]), self.templates[t][2][words[i]]
        lo, hi, k = max(0, end, i - size - size // 2), min(len(words), i + size + size // 2 + 1), bisect_left(same, i)
        left, right = max(lo, same[k - n] + 1 if k >= n else 0), min(hi, same[k + n] if k + n < len(same) else hi)
        hits = [self._best(words, t, lo, hi)]
        if (left, right) != (lo, hi):
            hits.append(self._best(words, t, left, right))
        return [hit for hit in hits if hit]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last), regions not overlapping.

        Of templates whose regions overlap, the one that fits its region best stands.
        """
        if not text:
            return []
        low = text.lower()
        if not self.any_sign.search(low):
            return []
        words = WORD.findall(low)
        found = []
        where: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.signs:
                where.setdefault(w, []).append(i)
        for t in range(len(self.templates)):
            end = -1
            for i in sorted(i for w, own in where.items() if t in self.signs[w] for i in own):
                if i < end:
                    continue
                hits = self._around(words, t, i, end, where[words[i]])
                found += hits
                if own := [hit for hit in hits if hit[3] <= i < hit[4]]:
                    end = max(own)[4]
        taken: list[tuple] = []
        starts: list[int] = []
        for hit in sorted(found, reverse=True):
            k = bisect_right(starts, hit[3])
            if (k == 0 or taken[k - 1][4] <= hit[3]) and (k == len(starts) or hit[4] <= starts[k]):
                taken.insert(k, hit)
                starts.insert(k, hit[3])
        return [(self.templates[-t][0], cover, s, e) for _, _, t, s, e, cover in taken]


def scan(docs: DataFrame, p: Params = Params(), templates=TEMPLATES) -> DataFrame:
    """doc_id, license, coverage, start and end (word numbers, end exclusive) of each notice.

    Null and empty texts have none; a text may have several; repeated rows repeat them.
    Other columns of `docs` are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        scanner, out = Scanner(p, templates), Batcher(schema)
        for b in text_batches(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for hit in scanner.scan(text):
                    if out.add((doc_id, *hit)):
                        yield out.flush()
        yield out.flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, license string, coverage double, start long, end long")
