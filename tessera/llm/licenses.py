"""License scans by conditional compression.

Candidate blocks stand around anchors: words that few texts have and every template has.  A block reaches as far to both sides as any
template could from its anchors; anchors further apart than ``PIECE`` words get blocks of their own.  Each block is compressed by
zstandard alone and with each template as raw-content dictionary; templates are ranked by the bytes that they save.  Those that save
``MIN_REDUCTION`` of what they'd take themselves are confirmed by exact wording, from the best down: laid on each anchor of the block
that they share, a word-by-word difference may touch a tenth of the template's words (one word in templates of 5 to 19, none in
shorter ones), and none with a digit and none of a license's name; nor may more than ``GAP`` words in a row be missing or
inserted, as that is a clause.  What a
negation stands before, in the same sentence and up to three words away, isn't reported.  After ``SPDX-License-Identifier`` any id or expression of ids counts, as it is written.  Where several are confirmed in one place, the one with most words
in common, less its differences, is reported, the better ranked one first; a place is reported once.

Words are compared in lower case without punctuation around them, and what has nothing else (comment marks, rules, bullets) is no
word, so a notice is found on a line of its own, inside a paragraph, in a comment, or wrapped over lines.  A sentence that two
licenses share is reported as `LicenseRef-BSD`, not as either.  Null and empty texts, and texts without an anchor, give no
row.  Every notice of a text is reported, repeated ones too; repeated rows give repeated results.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT_0 = _MIT.split(", subject to")[0] + "."
_GNU = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."

#: Wordings of common license notices and texts.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", _GNU.format("This program", "Affero ", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", _BSD + _BSD_2 + _BSD_AS_IS),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", _BSD + _BSD_2 + _BSD_3 + _BSD_AS_IS),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", 'Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("This program", "", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("This program", "", "3")),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_AS_IS),
    ("LGPL-2.1", _GNU.format("This library", "Lesser ", "2.1")),
    ("LGPL-3.0", _GNU.format("This library", "Lesser ", "3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LicenseRef-BSD", _BSD),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _MIT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("0BSD", _ISC + "." + _ISC_AS_IS),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GPL-1.0", "under the terms of the GNU General Public License version 1 as published by the Free Software Foundation"),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License version 3 as published by the Free Software Foundation"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT-0", _MIT_0),
    ("MIT-0", _MIT_0 + " " + _AS_IS),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *((f"CC-{kind}-3.0", f"Licensed under CC {kind} 3.0.") for kind in "BY BY-NC BY-NC-ND BY-NC-SA BY-ND BY-SA".split()),
    *((f"CC-{kind}-3.0", f"This work is licensed under a Creative Commons {name} 3.0 Unported License.") for kind, name in (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"))),
]
#: What ids are compressed with; any id counts.
_SPDX = "spdx-license-identifier"
_SPDX_IDS = "0BSD AGPL-3.0-only Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-3.0-only MIT MIT-0 MPL-2.0 Unlicense Zlib"
_SPDX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*\Z")
#: Words that take back what follows them.
NEGATIONS = frozenset("not never no nor cannot isn't aren't wasn't weren't isn’t aren’t wasn’t longer".split())
#: Words by which licenses differ, besides those with a digit.
NAMES = frozenset("affero apache boost bsd by by-nc by-nc-nd by-nc-sa by-nd by-sa cc cc0 eclipse gnu isc lesser library general mit mozilla neither unlicense zlib attribution attribution-noncommercial attribution-noncommercial-sharealike attribution-sharealike".split())
#: What anchors start with.
_ANCHOR = re.compile(r"licen[sc]|released|redistribut|permission|reserved|cc0?\b|spdx|eclipse|boost|unencumbered", re.IGNORECASE)
_EDGES = " \t\r\n.,;:!?\"'()[]{}<>*#|/\\-_=+~`“”‘’«»•%;"
#: Words in a row that can be missing or inserted.
GAP = 3
MIN_REDUCTION = 0.25
DIFFERENT = 0.1
#: Words between the first and the last anchor of a block at most.
PIECE = 256
LEVEL = 6


def words_of(text: str) -> list[str]:
    return [x for w in text.split() if (x := w.lower().strip(_EDGES))]


def allowed(length: int) -> int:
    """How many words of a template may differ."""
    return int(DIFFERENT * length) if length >= 20 else int(length >= 5)


def difference(window: list[str], template: list[str]) -> tuple[int, int, list[str], int] | None:
    """(first word, words, changes, longest gap) of the template's best place in the window; changes are ``-word`` missing, ``+word`` more."""
    blocks = difflib.SequenceMatcher(None, template, window, autojunk=False).get_matching_blocks()[:-1]
    if not blocks:
        return None
    first, end = blocks[0].b, blocks[-1].b + blocks[-1].size
    kept_a = {i for m in blocks for i in range(m.a, m.a + m.size)}
    kept_b = {i for m in blocks for i in range(m.b, m.b + m.size)}
    missing = [(b.a - a.a - a.size, b.b - a.b - a.size) for a, b in zip(blocks, blocks[1:])]
    # A gap is what is missing in a row, at the ends too, or what is put between words that stand side by side.
    gap = max([blocks[0].a, len(template) - blocks[-1].a - blocks[-1].size, *(m or more for m, more in missing)])
    return first, end - first, [f"-{w}" for i, w in enumerate(template) if i not in kept_a] + [f"+{window[i]}" for i in range(first, end) if i not in kept_b], gap


def same_license(changes: list[str], length: int, gap: int) -> bool:
    """Whether the changes touch few words of a template of that length, no clause, and neither a digit nor a name."""
    count = max(sum(c[0] == "-" for c in changes), sum(c[0] == "+" for c in changes))
    return gap <= GAP and count <= allowed(length) and not any(c[1:] in NAMES or any(x.isdigit() for x in c) for c in changes)


@dataclass(frozen=True)
class Finding:
    license: str
    first_word: int
    n_words: int
    block: str
    alone_bytes: int
    given_bytes: int
    reduction: float
    differences: tuple[str, ...]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, level: int = LEVEL):
        options = {"write_checksum": False, "write_content_size": False}
        self.plain = zstandard.ZstdCompressor(level=level, **options)
        self.templates = []
        self.lead = self.tail = 0
        for name, text in templates:
            words = words_of(text)
            raw = " ".join(words).encode()
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            anchors = [i for i, w in enumerate(words) if _ANCHOR.match(w)]
            if not anchors:
                raise ValueError(f"no anchor in the template of {name}")
            self.lead, self.tail = max(self.lead, anchors[-1]), max(self.tail, len(words) - anchors[0])
            self.templates.append((name, words, frozenset(words), {w: [i for i in anchors if words[i] == w] for w in {words[i] for i in anchors}}, len(self.plain.compress(raw)) - len(self.plain.compress(b"")), zstandard.ZstdCompressor(dict_data=content, **options)))
        ids = zstandard.ZstdCompressionDict(f"{_SPDX_IDS.lower()} {_SPDX} ".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.spdx = zstandard.ZstdCompressor(dict_data=ids, level=level, **options)
        slack = max(len(t[1]) for t in self.templates) // 10 + 2
        self.lead, self.tail = self.lead + slack, self.tail + slack

    def ranked(self, words: list[str]) -> list[int]:
        """Templates that the block's compression profits from, those first that save most bytes."""
        raw = " ".join(words).encode("utf-8", "ignore")
        alone = len(self.plain.compress(raw))
        saved = [(alone - len(t[5].compress(raw)), k) for k, t in enumerate(self.templates)]
        return [k for n, k in sorted(saved, key=lambda x: (-x[0], x[1])) if n >= MIN_REDUCTION * self.templates[k][4]]

    def _confirm(self, words: list[str], at: int, k: int, lo: int, hi: int) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, changes) of template k laid on the anchor at ``at``, where its wording holds."""
        _, template, own, anchors, _, _ = self.templates[k]
        n = len(template)
        for offset in anchors.get(words[at], ()):
            first = at - offset
            if first >= lo and words[first : first + n] == template:
                yield first, n, []
                continue
            slack = n // 10 + 2
            begin = max(lo, first - slack)
            window = words[begin : min(hi, first + n + slack)]
            if len(own) - len(own.intersection(window)) <= allowed(n) and (found := difference(window, template)) and same_license(found[2], n, found[3]):
                yield begin + found[0], found[1], found[2]

    def _identified(self, words: list[str], raw: list[str], at: int) -> tuple[int, str] | None:
        """How many words the SPDX line at a place has, and its id or expression as it is written."""
        glued = words[at][len(_SPDX) :].lstrip(":")
        rest = [raw[at][-len(glued) :]] if glued else []
        i = at + 1
        while i < len(words) and (not rest or rest[-1].upper() in ("OR", "AND", "WITH") or words[i] in ("or", "and", "with") and raw[i].isupper()):
            rest.append(raw[i])
            i += 1
        while rest and rest[-1].upper() in ("OR", "AND", "WITH"):
            rest.pop()
            i -= 1
        ids = [x for x in rest if x.upper() not in ("OR", "AND", "WITH")]
        known = f" {_SPDX_IDS.lower()} "
        if not ids or not all(_SPDX_ID.match(x) and (x != x.lower() or any(c.isdigit() for c in x) or f" {x} " in known) for x in ids):
            return None
        return i - at, " ".join(rest)

    def scan(self, text: str | None) -> list[Finding]:
        if not text or not _ANCHOR.search(text):
            return []
        words = words_of(text)
        raw = [w for w in text.split() if w.lower().strip(_EDGES)]
        anchors = [i for i, w in enumerate(words) if _ANCHOR.match(w)]
        found: dict[tuple[int, int, int], list[str]] = {}
        k = 0
        while k < len(anchors):
            to = bisect.bisect_right(anchors, anchors[k] + PIECE)
            lo, hi = max(0, anchors[k] - self.lead), min(len(words), anchors[to - 1] + self.tail)
            for rank, t in enumerate(self.ranked(words[lo:hi])):
                for at in anchors[k:to]:
                    for first, n, changes in self._confirm(words, at, t, lo, hi):
                        found.setdefault((first, n, t), [rank, changes])
            k = to
        # The place goes to the template with most words in common, less its changes; then by rank.
        order = sorted(found.items(), key=lambda x: (3 * len(x[1][1]) - x[0][1], x[1][0], x[0]))
        starts: list[int] = []
        chosen: list[tuple[int, int, int | str, list[str]]] = []
        bare = [w.strip(_EDGES) for w in raw] if _SPDX in text.lower() else []
        for at in anchors:
            if words[at].startswith(_SPDX) and (line := self._identified(words, bare, at)):
                starts.append(at)
                chosen.append((at, line[0], line[1], []))
        for (first, n, t), (_, changes) in order:
            # A negation before the block, unless a sentence ends between them.
            if any(words[j] in NEGATIONS and not any(raw[x][-1] in ".;!?" for x in range(j, first)) for j in range(max(0, first - 3), first)):
                continue
            i = bisect.bisect_left(starts, first)
            if (i == 0 or chosen[i - 1][0] + chosen[i - 1][1] <= first) and (i == len(starts) or first + n <= starts[i]):
                starts.insert(i, first)
                chosen.insert(i, (first, n, t, changes))
        out = []
        for first, n, t, changes in chosen:
            block = " ".join(words[first : first + n])
            raw = block.encode("utf-8", "ignore")
            name, with_template = (t, self.spdx) if isinstance(t, str) else (self.templates[t][0], self.templates[t][5])
            alone, given = len(self.plain.compress(raw)), len(with_template.compress(raw))
            out.append(Finding(name, first, n, block, alone, given, 1 - given / alone, tuple(changes)))
        return out


SCHEMA = "license string, first_word long, n_words long, block string, alone_bytes long, given_bytes long, reduction double, differences array<string>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per license notice: (doc_id, license, first_word, n_words, block, alone_bytes, given_bytes, reduction, differences)."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            found = [(i, f) for i, body in enumerate(batch.column(1).to_pylist()) for f in scanner.scan(body)]
            ids = batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([getattr(f, n) for _, f in found], t) for n, t in zip(names, types))], ["doc_id", *names])

    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, {SCHEMA}")
