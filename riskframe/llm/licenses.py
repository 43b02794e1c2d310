"""License scans by patience alignment.

Texts and license templates are compared as word sequences. A region of the
text that is dense in a template's words is aligned to it: words unique to both sides
are anchors, the longest increasing subsequence of anchor pairs is kept, and
the gaps between anchors are aligned again by the same rule (a gap without
common unique words falls back to its longest common run). Coverage is the
share of template words matched in order; regions from ``COVERAGE`` up whose
matches are not scattered (``DENSITY``) are reported, the best template for
each place.

Words in brackets name a license or tell it from its siblings: they must be matched, one
behind the other. Short notices ("released under the ...") are aligned around their first
bracket; whole texts and headers in regions. A license that no template
names is not reported under another one's name.

Templates that share too few words with the text to reach the coverage are
skipped beforehand (an exact bound). The work is a per-row function inside
``mapInArrow``: one pass, no shuffle.

Defined results: null or empty text has no licenses; repeated rows give
repeated results; an empty table gives no rows; texts are read whole; of templates that match
as many words, the one more completely matched counts, then the earlier place, then the
name; only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

COVERAGE = 0.8
DENSITY = 0.5
REACH = 12        # words between two template words of one region
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

# Public license texts and headers.
_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
          "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
          "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
          "Software, and to permit persons to whom the Software is furnished to do so")
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
          "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
          "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
          "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
          "IN THE SOFTWARE.")
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. ")
_ADVERTISING = ("All [advertising] materials mentioning features or use of this software must display the following "
                "acknowledgement: This product includes software developed by the organization. ")
_ENDORSEMENT = ("Neither the name of the copyright holder nor the names of its contributors may be used to [endorse] or promote "
                "products derived from this software without specific prior written permission. ")
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GNU = ("This {what} is free software: you can redistribute it and/or modify it under the terms of the [GNU {name}] as "
        "published by the Free Software Foundation, either [version {version}] of the License, or (at your option) any later "
        "version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")
GNU_LICENSES = [("GPL", "General Public License", "program", ("2", "3")),
                ("LGPL", "Lesser General Public License", "library", ("2.1", "3")),
                ("AGPL", "Affero General Public License", "program", ("3",))]
TEMPLATES = {
    "MIT": f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be "
           f"[included] in all copies or substantial portions of the Software. {_AS_IS}",
    "MIT-0": f"{_GRANT}. {_AS_IS}",
    "BSD-2-Clause": _REDISTRIBUTION + _DISCLAIMER,
    "BSD-3-Clause": _REDISTRIBUTION + _ENDORSEMENT + _DISCLAIMER,
    "BSD-4-Clause": _REDISTRIBUTION + _ADVERTISING + _ENDORSEMENT + _DISCLAIMER,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
           "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
           "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
           "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
           "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
           "PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
            "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
            "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
            "following restrictions: The origin of this software must not be [misrepresented]; you must not claim that you wrote "
            "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
            "be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be "
            "misrepresented as being the original software. This notice may not be removed or altered from any source "
            "distribution.",
    "Apache-2.0": "Licensed under the [Apache License], [Version 2.0] (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                  "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                  "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                  "permissions and limitations under the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the [Mozilla Public License], v. [2.0]. If a copy of the MPL was "
               "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC0-1.0": "To the extent possible under law, the author has [waived] all copyright and related or neighboring rights to "
               "this work.",
    "Unlicense": "This is free and unencumbered software released into the [public domain]. Anyone is free to copy, modify, "
                 "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
                 "for any purpose, commercial or non-commercial, and by any means.",
} | {f"{short}-{v if '.' in v else v + '.0'}": _GNU.format(what=what, name=name, version=v)
     for short, name, what, versions in GNU_LICENSES for v in versions}
LEADS = ("Licensed under", "Released under", "Distributed under", "Available under")
CC_KINDS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]


def _names() -> list[tuple[str, str]]:
    """(license, words that name it) of short notices."""
    out = [("MIT", "the [MIT License]"), ("BSD", "the [BSD License]"), ("ISC", "the [ISC License]"), ("Zlib", "the [zlib License]"),
           ("Unlicense", "the [Unlicense]"), ("CC0-1.0", "[CC0 1.0]")]
    out += [(f"BSD-{n}-Clause", form.format(n)) for n in "234" for form in ("the [BSD {}-Clause License]", "the [{}-Clause BSD License]")]
    out += [(f"Apache-{v}", f"the [Apache License], [{form}{v}]") for v in ("1.1", "2.0") for form in ("Version ", "")]
    out += [(f"MPL-{v}", f"the [Mozilla Public License], [{form}{v}]") for v in ("1.1", "2.0") for form in ("Version ", "v. ", "")]
    for short, name, _, versions in GNU_LICENSES:
        for v in versions:
            for w in {v, v if "." in v else v + ".0"}:
                out += [(f"{short}-{v if '.' in v else v + '.0'}", form) for form in (
                    f"the [GNU {name}], [version {w}]", f"the [GNU {name} v{w}]", f"the [{short}v{w}]", f"the [{short} {w}]", f"the [{short} v{w}]")]
    for kind, name in CC_KINDS:
        for v in ("2.0", "2.5", "3.0", "4.0"):
            region = "International" if v == "4.0" else "Unported"
            out += [(f"CC-{kind}-{v}", f"[CC {kind} {v}]"), (f"CC-{kind}-{v}", f"a [Creative Commons {name} {v}] {region} License")]
    return out


#: (name, text); notices follow from the leads and the names, and keep the
#: suffix ``-notice`` where the license has a text of its own
NOTICES = [(name if name.startswith("CC") else f"{name}-notice", f"{lead} {words}.") for name, words in _names() for lead in LEADS]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of ``pairs`` (ordered by the first number) whose
    second numbers increase: patience piles with back pointers."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile], at[pile] = b, i
        back[i] = at[pile - 1] if pile else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _unique(words: list, lo: int, hi: int) -> dict:
    where: dict = {}
    for i in range(lo, hi):
        where[words[i]] = -1 if words[i] in where else i
    return {w: i for w, i in where.items() if i >= 0}


def _longest_run(a: list, alo: int, ahi: int, b: list, blo: int, bhi: int) -> tuple[int, int, int]:
    best, ends = (0, 0, 0), {}
    for i in range(alo, ahi):
        new = {}
        for j in range(blo, bhi):
            if a[i] == b[j]:
                k = new[j] = ends.get(j - 1, 0) + 1
                if k > best[2]:
                    best = (i - k + 1, j - k + 1, k)
        ends = new
    return best


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched (index in a, index in b) in increasing order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        in_b = _unique(b, blo, bhi)
        anchors = increasing(sorted((i, in_b[w]) for w, i in _unique(a, alo, ahi).items() if w in in_b))
        if not anchors:
            i, j, k = _longest_run(a, alo, ahi, b, blo, bhi)
            anchors = [(i + x, j + x) for x in range(k)]
            if not anchors:
                continue
        out += anchors
        edges = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


def _regions(words: list, rare: frozenset, reach: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i, w in enumerate(words):
        if w in rare:
            if out and i - out[-1][1] <= reach:
                out[-1][1] = i
            else:
                out.append([i, i])
    return [(a, b + 1) for a, b in out]


class Template:
    """A template's words, their number and the places of its bracketed groups."""

    COMMON = {"the", "a", "of", "and", "or", "to", "in", "this", "is", "on", "by", "with", "that", "under", "are", "all"}

    def __init__(self, name: str, text: str, notice: bool = False):
        self.name, self.notice, self.words, self.groups = name, notice, [], []
        for k, part in enumerate(re.split(r"[\[\]]", text.lower())):
            new = WORD.findall(part)
            if k % 2:
                self.groups.append((len(self.words), len(self.words) + len(new)))
            self.words += new
        self.vocabulary = frozenset(self.words)
        self.needed = frozenset(w for a, b in self.groups for w in self.words[a:b])
        self.rare = self.vocabulary - self.COMMON

    def possible(self, have: set, coverage: float) -> bool:
        """Whether a text of these words can reach the coverage."""
        return self.needed <= have and sum(w in have for w in self.words) >= coverage * len(self.words)

    def named(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether all groups are matched by words one behind the other."""
        at = {j: i for i, j in pairs}
        return all(a in at and all(at.get(j) == at[a] + j - a for j in range(a, b)) for a, b in self.groups)

    def around(self, doc: list, at: int) -> list[tuple[int, int]]:
        """Alignment with the first group at word ``at`` of the text."""
        a, b = self.groups[0]
        lo, after = max(0, at - 2 * a - 2), at + b - a
        left = align(doc[lo:at], self.words[:a])
        right = align(doc[after:after + 2 * (len(self.words) - b) + 2], self.words[b:])
        return ([(lo + i, j) for i, j in left] + [(at + k, a + k) for k in range(b - a)]
                + [(after + i, b + j) for i, j in right])


def prepared(templates: dict[str, str], notices: list[tuple[str, str]] = ()) -> list[Template]:
    return [Template(n, t) for n, t in templates.items()] + [Template(n, t, True) for n, t in notices]


def _in_regions(doc: list, t: Template, coverage: float, density: float, reach: int):
    """Matches of a text or header in the regions dense in its words."""
    words = t.words
    todo = [(max(0, a - len(words)), min(len(doc), b + len(words))) for a, b in _regions(doc, t.rare, reach)
            if sum(w in t.rare for w in doc[a:b]) >= coverage * len(t.rare) * 0.5]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < coverage * len(words):
            continue
        # windows of two template lengths, half overlapping, so that a second copy has its own
        size = 2 * len(words)
        if hi - lo > 2 * size:
            todo += [(p, min(hi, p + 2 * size)) for p in range(lo, hi - size, size)]
            continue
        pairs = _densest(align(doc[lo:hi], words), len(words), coverage, density)
        if not pairs:
            continue
        yield [(lo + i, j) for i, j in pairs]
        todo += [(lo, lo + pairs[0][0]), (lo + pairs[-1][0] + 1, hi)]


def _notices(doc: list, where: dict, t: Template, coverage: float, density: float):
    """Matches of a notice around each place of its first group."""
    a, b = t.groups[0]
    group = t.words[a:b]
    for at in where[group[0]]:
        if doc[at:at + b - a] == group:
            pairs = _densest(t.around(doc, at), len(t.words), coverage, density)
            if pairs:
                yield pairs


def find(text: str, templates: list[Template], coverage: float = COVERAGE, density: float = DENSITY,
         reach: int = REACH) -> list[tuple[str, int, int, float]]:
    """(license, start, end, coverage) in code points, by place."""
    low = text.lower()
    if len(low) != len(text):   # a letter whose lower case has another length: keep the offsets
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    have = set(WORD.findall(low))
    likely = [t for t in templates if t.possible(have, coverage)]
    if not likely:
        return []
    marks = [(m.group(0), m.start(), m.end()) for m in WORD.finditer(low)]
    doc, found = [m[0] for m in marks], []
    where: dict[str, list[int]] = {t.words[t.groups[0][0]]: [] for t in likely if t.notice}
    for i, w in enumerate(doc):
        if w in where:
            where[w].append(i)
    for t in likely:
        for pairs in _notices(doc, where, t, coverage, density) if t.notice else _in_regions(doc, t, coverage, density, reach):
            if t.named(pairs):
                found.append((len(pairs), t.name, pairs[0][0], pairs[-1][0] + 1, len(pairs) / len(t.words)))
    found.sort(key=lambda f: (-f[0], -f[4], f[2], f[1]))
    taken, out = [], []
    for _, name, first, last, share in found:
        if all(last <= a or b <= first for a, b in taken):
            taken.append((first, last))
            out.append((name, marks[first][1], marks[last - 1][2], share))
    return sorted(out, key=lambda f: (f[1], f[0]))


def _densest(pairs: list[tuple[int, int]], n: int, coverage: float, density: float) -> list[tuple[int, int]]:
    """Drop scattered matches from the ends until the rest is dense."""
    while len(pairs) >= coverage * n:
        if len(pairs) >= density * (pairs[-1][0] - pairs[0][0] + 1):
            return pairs
        left, right = pairs[1][0] - pairs[0][0], pairs[-1][0] - pairs[-2][0]
        pairs = pairs[1:] if left >= right else pairs[:-1]
        if len(pairs) < 2:
            return []
    return []


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id and licenses: array of (license, start, end, coverage)."""
    ready = prepared(TEMPLATES, NOTICES) if templates is None else prepared(templates)
    element = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"license": n, "start": s, "end": e, "coverage": c} for n, s, e, c in find(t, ready, coverage)] if t else []
                    for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(element))], ["doc_id", "licenses"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, licenses array<struct<license:string,start:bigint,end:bigint,coverage:double>>")
