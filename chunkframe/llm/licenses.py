"""License scans: winnowed template fingerprints pick candidates, a banded alignment reports spans.

Templates are few and known, so their index travels with the code. A text is read as words; the
hashes of its ``GRAM`` words in a row are winnowed (the least of every ``WINDOW``) and looked up
in the inverted index. Hits vote for a template and a diagonal, and around each the template is
aligned with the text word by word in a band of up to ``BAND`` words (``WIDE`` for whole licences, which need
more hits to become candidates). A match is reported with the
share of the template it covers and its span in the text, in characters. The words that tell a
licence from its siblings (name, version) must stand in it.

Defined cases: null and empty texts, and texts shorter than a gram, have no match; overlapping
matches of one template count once, where it covers most, and of templates that share more than half of
a span the one with most words matched less words missed; ties go to the earlier span, then the
template that sorts first; a very long text is scanned whole, in time linear in its words and hits; repeated rows repeat
their matches; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map

GRAM, WINDOW, BAND, COVERAGE, REMEMBERED = 3, 2, 8, 0.7, 150_000
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)
# Notices as projects write them, by licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": _BSD[0] + _BSD[2],
    "BSD-3-Clause": _BSD[0] + _BSD[1] + _BSD[2],
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "MPL-1.1": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-only-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
}
for _code, _name in {"SA": "ShareAlike", "ND": "NoDerivatives", "NC": "NonCommercial", "NC-SA": "NonCommercial-ShareAlike", "NC-ND": "NonCommercial-NoDerivatives"}.items():
    TEMPLATES[f"CC-BY-{_code}-4.0-notice"] = f"This work is licensed under a Creative Commons Attribution-{_name} 4.0 International License."
    TEMPLATES.setdefault(f"CC-BY-{_code}-4.0", f"Licensed under CC BY-{_code} 4.0.")
# What must stand word by word in a match, since sibling licences differ in nothing else.
TELLING = {
    "Apache-2.0": ["apache license version 2 0"], "Apache-2.0-notice": ["apache license version 2 0"], "Apache-1.1": ["apache license version 1 1"],
    "MPL-2.0": ["mozilla public license v 2 0"], "MPL-1.1": ["mozilla", "version 1 1"], "MIT": ["mit license"], "BSD-3-Clause": ["endorse or promote products"],
    "GPL-2.0": ["gnu general public license version 2"], "GPL-2.0-notice": ["gnu general public license", "version 2 of"], "GPL-2.0-only-notice": ["gnu general public license version 2 as"],
    "GPL-3.0": ["gnu general public license version 3"], "GPL-3.0-notice": ["gnu general public license", "version 3 of"],
    "LGPL-2.1-notice": ["gnu lesser general public license", "version 2 1 of"], "LGPL-3.0-notice": ["gnu lesser general public license", "version 3 of"], "AGPL-3.0-notice": ["gnu affero general public license", "version 3 of"],
} | {n: [re.search(r"(creative commons|cc) .* 4 0", " ".join(re.findall(r"[^\W_]+", t.lower())))[0]] for n, t in TEMPLATES.items() if n.startswith("CC-")}
#: Whole texts, as their licensors publish them: one file for each, in ``license_texts``.
WHOLE = {f"{f.stem}-whole": f.read_text(encoding="utf-8") for f in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}
ALL = TEMPLATES | WHOLE
#: From so many words on a template is long: it needs a hit for every ``VOTE`` of its words near a diagonal, and its band is ``WIDE``.
LONG, VOTE, WIDE = 256, 64, 40
_WORD = re.compile(r"[^\W_]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_hashes: dict[str, int] = {}


def _numbers(words: list[str]) -> np.ndarray:
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        raw = w.encode()
        _hashes[w] = zlib.crc32(raw) << 32 | zlib.adler32(raw)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)) if words else np.zeros(0, np.uint64)


def winnowed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes that are the least of a window (the rightmost of equal ones), and their places."""
    n = len(numbers) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = (h ^ numbers[i : n + i]) * _MIX[i % len(_MIX)]
        h ^= h >> np.uint64(31)
    if n <= WINDOW:
        return h[[n - 1 - int(np.argmin(h[::-1]))]], np.array([n - 1 - int(np.argmin(h[::-1]))])
    least = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    at = np.unique(np.arange(len(least)) + WINDOW - 1 - np.argmin(least[:, ::-1], axis=1))
    return h[at], at


class Index:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str] = ALL):
        self.names = sorted(templates)
        self.words = [_numbers(_WORD.findall(templates[n].lower())) for n in self.names]
        self.telling = [[_numbers(p.split()) for p in (TELLING.get(n, []) if TEMPLATES.get(n) == templates[n] else [])] for n in self.names]
        where = defaultdict(list)
        for t, w in enumerate(self.words):
            grams, at = winnowed(w)
            if len(w) and not len(grams):
                raise ValueError(f"template {self.names[t]} is shorter than {GRAM} words")
            for g, a in zip(grams.tolist(), at.tolist(), strict=True):
                where[g].append((t, a))
        self.where = dict(where)
        self.keys = np.array(sorted(where), np.uint64)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end) of every match in a text."""
        text = text or ""
        low = text.lower()
        if len(low) != len(text):  # a character whose lower case is longer: keep places by folding one by one
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        numbers = _numbers(_WORD.findall(low))
        grams, at = winnowed(numbers)
        hit = self.keys[np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)] == grams if len(self.keys) else np.zeros(len(grams), bool)
        if not hit.any():
            return []
        fits = [len(numbers) >= COVERAGE * len(w) for w in self.words]  # a shorter text cannot hold enough of a template
        votes: dict[int, list[int]] = defaultdict(list)
        for g, a in zip(grams[hit].tolist(), at[hit].tolist(), strict=True):
            for t, b in self.where[g]:
                if fits[t]:
                    votes[t].append(a - b)
        diagonals = {t: candidates(ds, len(self.words[t])) for t, ds in votes.items()}
        spans = [m.span() for m in _WORD.finditer(low)]
        found = []
        for t, ds in diagonals.items():
            own, last, band = [], None, band_of(len(self.words[t]))
            for d in sorted(ds):
                if last is not None and d - last <= band // 2:
                    continue  # the band of the last one holds this diagonal
                last = d
                matched, first, stop = (align if len(self.words[t]) < LONG else align_long)(self.words[t], numbers, d, band)
                if matched >= COVERAGE * len(self.words[t]) and all(stands_in(p, numbers[first:stop]) for p in self.telling[t]):
                    own.append((-matched, first, stop))
            taken: list[tuple[int, int]] = []
            for matched, first, stop in sorted(own):
                if all(stop <= a or first >= b for a, b in taken):
                    taken.append((first, stop))
                    found.append((len(self.words[t]) + 2 * matched, first, self.names[t], stop, (self.names[t], round(-matched / len(self.words[t]), 6), -matched, spans[first][0], spans[stop - 1][1])))
        best: list[tuple] = []  # the most words matched less words missed first
        for f in sorted(found):
            if all(2 * (min(f[3], b[3]) - max(f[1], b[1])) <= min(f[3] - f[1], b[3] - b[1]) for b in best):
                best.append(f)
        return sorted((f[4] for f in best), key=lambda f: (f[3], f[0], f[4]))


def band_of(words: int) -> int:
    return WIDE if words >= LONG else min(BAND, words // 4)


def candidates(diagonals: list[int], words: int) -> list[int]:
    """The diagonals that are aligned, rising: all of a short template's; of a long one those with enough hits within the band, the densest of those that would overlap."""
    if words < LONG:
        return sorted(set(diagonals))
    d, band = np.sort(np.array(diagonals, np.int64)), band_of(words)
    near = np.searchsorted(d, d + band, side="right") - np.searchsorted(d, d - band, side="left")
    out: list[int] = []
    for i in np.lexsort((d, -near)).tolist():  # the densest first; matches less than half a template apart would overlap, and count once
        if near[i] * VOTE < words:
            break
        if all(abs(int(d[i]) - o) > words // 2 for o in out):
            out.append(int(d[i]))
    return sorted(out)


def stands_in(phrase: np.ndarray, text: np.ndarray) -> bool:
    """Whether the words of a phrase stand in a row in a text."""
    n = len(text) - len(phrase) + 1
    return n > 0 and bool(np.logical_and.reduce([text[i : n + i] == p for i, p in enumerate(phrase)]).any())


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence near a diagonal: matched words, first and last place in the text.

    One row per template word, ``2 * band + 1`` cells around the diagonal; each cell holds the best
    count and, against it, the place where that match began (the latest) and ended (the earliest).
    """
    width = 2 * band + 1
    empty = (0, -1, -1)  # count, start, end
    best = [empty] * width
    for i, word in enumerate(template.tolist()):
        row, left = [], empty
        for k in range(width):
            j = i + diagonal - band + k
            above = best[k + 1] if k + 1 < width else empty
            cell = max(left, above, key=lambda c: (c[0], c[1], -c[2]))
            if 0 <= j < len(text) and text[j] == word:
                n, s, _ = best[k]
                grown = (n + 1, s if n else j, j + 1)
                cell = max(cell, grown, key=lambda c: (c[0], c[1], -c[2]))
            row.append(cell)
            left = cell
        best = row
    n, s, e = max(best, key=lambda c: (c[0], c[1], -c[2]))
    return (n, s, e) if n else (0, 0, 0)


def align_long(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = WIDE) -> tuple[int, int, int]:
    """``align`` a row at a time: a cell is one number, the count above the place of the start above (the complement of) that of the end."""
    width, base = 2 * band + 1, diagonal - band
    bits, top = 21, (1 << 21) - 1
    if len(template) + width >= top:
        raise ValueError("a template of more than two million words")
    places = np.arange(width, dtype=np.int64)
    best = np.zeros(width + 1, np.int64)  # the last cell lies outside of the band
    for i, word in enumerate(template.tolist()):
        j = i + base + places
        inside = (j >= 0) & (j < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[j[inside]] == word
        row = best[1:].copy()
        if same.any():
            k = np.nonzero(same)[0]
            held = best[k]
            at = i + k + 1  # places from the band's first one on, counted from 1
            start = np.where(held > 0, held >> bits & top, at)
            row[k] = np.maximum(row[k], ((held >> 2 * bits) + 1) << 2 * bits | start << bits | top - at)
        best[:width] = np.maximum.accumulate(row)
        best[width] = 0
    cell = int(best.max())
    if not cell:
        return 0, 0, 0
    return cell >> 2 * bits, (cell >> bits & top) - 1 + base, top - (cell & top) + base


_built: dict[int, Index] = {}


def scan_licenses(docs: DataFrame, templates: dict[str, str] = ALL) -> DataFrame:
    """(doc_id, template, coverage, matched_words, span_start, span_end), one row per match."""
    key = hash(tuple(sorted(templates.items())))

    def run(x):
        if key not in _built:
            _built[key] = Index(templates)
        out = {k: [] for k in ("doc_id", "template", "coverage", "matched_words", "span_start", "span_end")}
        for doc_id, text in zip(x["doc_id"], x["text"], strict=True):
            for row in _built[key].scan(text):
                for name, v in zip(out, (doc_id, *row), strict=True):
                    out[name].append(v)
        return out

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, template string, coverage double, matched_words int, span_start int, span_end int")
