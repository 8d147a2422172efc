"""Licence scans by Dice coefficient over word bigrams (operator 4).

A text is looked at as a whole, paragraph by paragraph and line by line. Each such segment is normalised to its words and compared
with the licence templates by the Dice coefficient of their multisets of word bigrams. Sizes bound the coefficient, so only
templates whose size is near enough are compared: 2 min(a, b) / (a + b) must reach the threshold.

Windows of each template's sizes over the whole word sequence find what is part of a longer segment or spans several; they are tried where
enough of the template's bigrams lie close together, and come only where no segment already has the licence.

Scale: a narrow map, linear in the text (times the size of a template where one is near), without any shuffle. Templates are a fixed list. A task holds one text and its words
at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_DICE = 0.8

# The public texts of short licences and the usual notices, as text.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see <https://www.gnu.org/licenses/>."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
        "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",),
}

_WORDS = re.compile(rb"[a-z0-9]+")
FOUND = "doc_id long, license string, template int, segment string, first_line long, last_line long, dice double"


def words_of(text: str) -> list[bytes]:
    """The runs of a-z and 0-9 after lower-casing A-Z (and nothing else)."""
    return _WORDS.findall(text.encode().lower())


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


class Templates:
    """The templates by their number of bigrams."""

    def __init__(self, texts: dict[str, tuple[str, ...]], least: float):
        self.least = least
        self.known = sorted(((len(w) - 1, name, k, bigrams(w)) for name, versions in texts.items()
                             for k, v in enumerate(versions) if len(w := words_of(v)) > 1), key=lambda t: t[:3])
        self.near: dict[int, list] = {}
        sizes = [t[0] for t in self.known]
        ratio = least / (2 - least)  # of the smaller size to the larger, at least
        self.low, self.high = (ratio * sizes[0], sizes[-1] / ratio) if sizes else (1, 0)
        self.pairs = frozenset().union(*[t[3] for t in self.known])

    def candidates(self, size: int) -> list:
        """The templates that a segment of so many bigrams can reach."""
        if size < self.low or size > self.high:
            return []
        if size not in self.near:
            self.near[size] = [t for t in self.known if 2 * min(size, t[0]) >= self.least * (size + t[0])]
        return self.near[size]

    def matches(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(licence, template, coefficient) of all templates that reach the threshold."""
        near = self.candidates(len(words) - 1)
        if not near or self.pairs.isdisjoint(zip(words, words[1:])):
            return []
        mine, out = bigrams(words), []
        for size, name, k, theirs in near:
            shared = sum(min(n, mine[g]) for g, n in theirs.items() if g in mine)
            dice = 2 * shared / (size + len(words) - 1)
            if dice >= self.least:
                out.append((name, k, dice))
        return out


    def windows(self, words: list[bytes]) -> list[tuple[str, int, float, int, int]]:
        """(licence, template, coefficient, first word, last word) of the best windows; those of a licence don't overlap.

        The best window starts and ends with a bigram of the template, as any other only adds to its size.
        """
        pairs = list(zip(words, words[1:]))
        anchors = [p for p, g in enumerate(pairs) if g in self.pairs]
        found: dict[str, list] = {}
        for size, name, k, theirs in self.known if anchors else ():
            mine = [p for p in anchors if pairs[p] in theirs]
            most = int(size * (2 - self.least) / self.least + 1e-9)  # bigrams of a window
            shared_least = max(1, -int(-(size * self.least / (2 - self.least) - 1e-9) // 1))
            for i in range(len(mine) - shared_least + 1):
                if mine[i + shared_least - 1] - mine[i] >= most:
                    continue
                counts, shared, best = Counter(), 0, None
                for p in mine[i:i + most]:
                    length = p - mine[i] + 1
                    if length > most:
                        break
                    g = pairs[p]
                    counts[g] += 1
                    shared += counts[g] <= theirs[g]
                    dice = 2 * shared / (size + length)
                    if dice >= self.least and (best is None or dice > best[0]):
                        best = (dice, p)
                if best:
                    found.setdefault(name, []).append((-best[0], -size, mine[i], best[1] + 1, k))
        out = []
        for name, some in found.items():
            taken = bytearray(len(words))
            for dice, _, a, b, k in sorted(some):
                if not any(taken[a:b + 1]):
                    taken[a:b + 1] = b"\x01" * (b + 1 - a)
                    out.append((name, k, -dice, a, b))
        return sorted(out, key=lambda w: (w[3], w[0]))


def segments(text: str) -> Iterator[tuple[str, int, int, list[bytes]]]:
    """(kind, first line, last line, words) of each line, paragraph and the whole; segments alike in extent come once, as the larger."""
    lines = [words_of(x) for x in text.split("\n")]
    blank = [not x.strip(" \t\x0b\x0c\r") for x in text.split("\n")]
    start = 0
    seen = {(0, len(lines) - 1)}
    yield "text", 0, len(lines) - 1, [w for x in lines for w in x]
    for k in range(len(lines) + 1):
        if k == len(lines) or blank[k]:
            if k > start and (start, k - 1) not in seen:
                seen.add((start, k - 1))
                yield "paragraph", start, k - 1, [w for x in lines[start:k] for w in x]
            start = k + 1
    for k, words in enumerate(lines):
        if not blank[k] and (k, k) not in seen:
            yield "line", k, k, words


def in_windows(text: str, templates: Templates, known: list[tuple]) -> list[tuple[str, int, str, int, int, float]]:
    """(licence, template, "window", first line, last line, coefficient) where no known segment of that licence is."""
    lines = [words_of(x) for x in text.split("\n")]
    found = templates.windows([w for x in lines for w in x])
    if not found:
        return []
    line = [k for k, x in enumerate(lines) for _ in x]
    rows = [(name, k, "window", line[a], line[b], d) for name, k, d, a, b in found]
    return [r for r in rows if not any(m[0] == r[0] and m[3] <= r[4] and r[3] <= m[4] for m in known)]


def _scan(texts: dict[str, tuple[str, ...]], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts, least)
        names = [f.split()[0] for f in FOUND.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                text = text.as_py()
                if text:
                    known = [(name, k, kind, a, b, d) for kind, a, b, words in segments(text) for name, k, d in templates.matches(words)]
                    rows += [(doc.as_py(), *m[:5], round(m[5], 6)) for m in known + in_windows(text, templates, known)]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
    return run


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """A row for each segment of a document and template whose coefficient is at least ``least``, and for windows besides them.

    doc_id, license, template (its number), segment (text, paragraph, line or window), first_line, last_line (from 0), dice. NULL and
    empty texts, and segments of fewer than two words, match nothing. Repeated rows give repeated results.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_scan(templates or TEMPLATES, least), FOUND)
