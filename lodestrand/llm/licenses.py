"""Licence scans: Dice coefficient of word bigrams against licence templates."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import ALNUM, alnum_words_of, as_bytes

# Public licence notices and texts, without copyright lines.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
    "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_ENDORSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission."
)
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free "
    "Software Foundation, either version {version} of the License, or (at your option) any later version."
)
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        "language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (_BSD_TERMS, "Licensed under the BSD 2-Clause License."),
    "BSD-3-Clause": (f"{_BSD_TERMS} {_BSD_ENDORSE}", "Licensed under the BSD 3-Clause License."),
    "CC-BY-4.0": ("This work is licensed under the Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software "
        "to the public domain worldwide. This software is distributed without any warranty.",
    ),
    "GPL-2.0-only": ("Licensed under the GNU General Public License, version 2.",),
    "GPL-2.0-or-later": (_GPL_NOTICE.format(name="GNU General Public License", version="2"),),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL-3.0-or-later": (_GPL_NOTICE.format(name="GNU General Public License", version="3"),),
    "LGPL-3.0-or-later": (_GPL_NOTICE.format(name="GNU Lesser General Public License", version="3"),),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MIT": (_MIT_GRANT, _MIT_WARRANTY, f"{_MIT_GRANT} {_MIT_WARRANTY}", "Released under the MIT License.", "Licensed under the MIT License."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

# the whole texts beside the notices; a text of the GNU licences does not say "or later"
for _file in sorted((files("lodestrand.llm") / "license_texts").iterdir(), key=lambda x: x.name):
    _name = _file.name.removesuffix(".txt")
    TEMPLATES[_name] = (*TEMPLATES.get(_name, ()), _file.read_text("utf-8"))

_BLANK_LINE = re.compile(rb"\n[ \t\r\x0b\x0c]*\n")
MATCH = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def bigrams(text: bytes | None) -> set[tuple[bytes, bytes]]:
    words = alnum_words_of(text)
    return set(zip(words, words[1:]))


def segments(text: bytes) -> Iterator[tuple[str, int, int]]:
    """Lines, paragraphs and the whole text as byte spans, each span once."""
    seen = set()
    start = 0
    for line in text.split(b"\n"):
        yield "line", start, start + len(line)
        seen.add((start, start + len(line)))
        start += len(line) + 1
    start = 0
    for cut in [*_BLANK_LINE.finditer(text), None]:
        end = cut.start() if cut else len(text)
        if (start, end) not in seen:
            seen.add((start, end))
            yield "paragraph", start, end
        start = cut.end() if cut else end
    if (0, len(text)) not in seen:
        yield "text", 0, len(text)


class Matcher:
    """Templates by their bigrams; sizes bound which templates a segment can match at all."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], threshold: float):
        self.threshold = threshold
        self.names, self.sizes, self.grams, self.holders = [], [], [], {}
        for name, texts in sorted(templates.items()):
            for text in texts:
                grams = bigrams(text.encode())
                for g in grams:
                    self.holders.setdefault(g, []).append(len(self.names))
                self.names.append(name), self.sizes.append(len(grams)), self.grams.append(grams)
        # 2 * min(a, b) / (a + b) >= t bounds the sizes' ratio
        self.ratio = threshold / (2 - threshold)
        # with room for rounding: Dice itself decides
        self.least, self.most = min(self.sizes) * self.ratio - 1e-9, max(self.sizes) / self.ratio + 1e-9

    def match(self, segment: bytes) -> Iterator[tuple[str, float]]:
        """Templates that reach the threshold, each licence by its best."""
        words = alnum_words_of(segment)
        if len(words) - 1 < self.least:
            return
        hits = {g for g in zip(words, words[1:]) if g in self.holders}
        if len(hits) < self.least:  # two sets share no more than the smaller has
            return
        n = len(set(zip(words, words[1:])))
        if n > self.most:
            return
        common = Counter(t for g in hits for t in self.holders[g] if self.ratio * n - 1e-9 <= self.sizes[t] <= n / self.ratio + 1e-9)
        best: dict[str, float] = {}
        for t, c in common.items():
            dice = 2 * c / (n + self.sizes[t])
            if dice >= self.threshold:
                best[self.names[t]] = max(dice, best.get(self.names[t], 0.0))
        yield from best.items()

    def windows(self, text: bytes) -> Iterator[tuple[str, int, int]]:
        """Runs of words anywhere in ``text`` that reach the threshold: the best that do not overlap, for each licence.

        The best window begins and ends with bigrams of the template. One whose first bigram comes again
        has no more in it than the next one, and one is too long when its bigrams bound Dice below the threshold.
        """
        words = alnum_words_of(text)
        grams = list(zip(words, words[1:]))
        hits = [i for i, g in enumerate(grams) if g in self.holders]
        if len(hits) < self.least:
            return
        own = Counter(t for g in {grams[i] for i in hits} for t in self.holders[g])
        found: dict[str, list[tuple[float, int, int]]] = {}
        before, after = _neighbours(grams)
        for t, c in own.items():
            size, template = self.sizes[t], self.grams[t]
            if c < self.ratio * size - 1e-9:
                continue
            held = np.zeros(len(grams), bool)
            held[[i for i in hits if grams[i] in template]] = True
            for dice, i, j in best_windows(held, before, after, size, self.threshold, self.ratio):
                found.setdefault(self.names[t], []).append((dice, i, j))
        if not found:
            return
        spans = [m.span() for m in re.finditer(rb"\S+", text.translate(ALNUM))]
        for name, all_of in found.items():
            taken: list[tuple[int, int]] = []  # in order, apart from each other
            for _, i, j in sorted(all_of, key=lambda x: (-x[0], x[1] - x[2], x[1])):
                at = bisect_left(taken, (i, j + 1))
                if (at == 0 or taken[at - 1][1] < i) and (at == len(taken) or j + 1 < taken[at][0]):
                    taken.insert(at, (i, j + 1))
                    yield name, spans[i][0], spans[j + 1][1]


def _neighbours(grams: list) -> tuple[np.ndarray, np.ndarray]:
    """Where each bigram stood before (-1: nowhere) and stands next (the end: nowhere)."""
    before, last = np.full(len(grams), -1), {}
    after = np.full(len(grams), len(grams))
    for i, g in enumerate(grams):
        if g in last:
            before[i] = last[g]
            after[last[g]] = i
        last[g] = i
    return before, after


def best_windows(held: np.ndarray, before: np.ndarray, after: np.ndarray, size: int, threshold: float, ratio: float) -> Iterator[tuple[float, int, int]]:
    """``(dice, i, j)`` of the best window from each bigram of the template that reaches the threshold, the longer of equal ones.

    A window's distinct bigrams are those that did not stand before within it: two running counts for each start. A start is
    passed over if what stands of the template within its reach, repeats and all, is too little.
    """
    most, need = size / ratio + 1e-9, math.ceil(ratio * size - 1e-9)  # sizes at the very bound may match
    sums = np.concatenate(([0], np.cumsum(held)))
    for i in np.flatnonzero(held).tolist():
        end, width, best = int(after[i]), int(most) + 1, (0.0, i)
        if sums[end] - sums[i] < need:
            continue
        n = common = 0
        at = i
        while at < end:  # one step, unless bigrams come again within the window
            stop = min(end, at + width)
            new = before[at:stop] < i
            counts, shared = n + np.cumsum(new), common + np.cumsum(new & held[at:stop])
            over = int(np.searchsorted(counts, most, side="right"))
            dice = np.where(held[at : at + over] & new[:over], 2 * shared[:over] / (counts[:over] + size), 0)
            if over and dice.max() >= best[0]:
                top = over - 1 - int(dice[::-1].argmax())
                best = max(best, (float(dice[top]), at + top))
            if over < stop - at or not len(counts):
                break
            n, common, at = int(counts[-1]), int(shared[-1]), stop
        if best[0] >= threshold:
            yield best[0], i, best[1]


def matches_of(matcher: Matcher, text: bytes) -> list[dict]:
    """Segments that match, and windows that overlap none of their licence or are better than those they overlap."""
    found = [
        {"license": name, "dice": dice, "kind": kind, "start": start, "end": end}
        for kind, start, end in segments(text)
        for name, dice in matcher.match(text[start:end])
    ]
    more = []
    for name, start, end in matcher.windows(text):
        dice = dict(matcher.match(text[start:end]))[name]
        if all(m["dice"] < dice for m in found if m["license"] == name and m["start"] < end and start < m["end"]):
            more.append({"license": name, "dice": dice, "kind": "window", "start": start, "end": end})
    return found + more


def license_matches(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Licence texts in documents: ``(doc_id, matches)``, matches of (license, dice, kind, start, end) with UTF-8 byte spans.

    A segment (line, paragraph, whole text, or a window of words anywhere, see :meth:`Matcher.windows`) and a template are compared as sets of word bigrams
    (ASCII letters and digits and characters beyond ASCII, A-Z in lower case): Dice is
    ``2 * |A & B| / (|A| + |B|)``. Since the overlap is at most the smaller set, sizes whose ratio is
    below ``t / (2 - t)`` cannot match and are never compared. The templates are a fixed, small table
    that every task gets; the scan has no shuffle.

    Defined cases: null and empty texts match nothing; a segment of one word has no bigrams; repeated
    rows give a row each; an empty table gives no rows; other columns are ignored.
    """
    matcher = Matcher(templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matches_of(matcher, text.as_py() or b"") for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(MATCH))], ["doc_id", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", as_bytes().alias("text")).mapInArrow(
        run, f"doc_id {kind}, matches array<struct<license:string,dice:double,kind:string,start:int,end:int>>"
    )


def license_scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per document its best licence: ``(doc_id, license, dice, n_licenses, licenses)``.

    ``license`` is null without a match; equal scores take the first name. See :func:`license_matches`.
    """
    m = F.col("matches")
    best = F.get(F.sort_array(F.transform(m, lambda x: F.struct((-x["dice"]).alias("d"), x["license"].alias("l")))), F.lit(0))
    names = F.array_sort(F.array_distinct(F.transform(m, lambda x: x["license"])))
    return license_matches(docs, templates, threshold).select(
        "doc_id", best["l"].alias("license"), (-best["d"]).alias("dice"), F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses")
    )
