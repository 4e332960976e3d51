"""License scans by conditional compression.

A block of text is a candidate if it holds a trigger word; it reaches from the trigger as far as the longest template
can, in both directions. Each candidate is compressed with zstandard alone and once with each template as raw
dictionary; a template that explains the block lowers its size. Every template above `MIN_REDUCTION` is confirmed by
the exact differences in wording: the share of the template's words found in order in the block, and which are missing
or foreign. Words that tell a template from templates of other licenses (versions, "lesser", "nc", a clause) must agree: a match
that lacks one of them or holds a sibling's is reported as a variant, never as that license. The best confirmed match is reported and what lies before and behind it is scanned again.

Defined results: null and empty texts give no rows; every row of a repeated document is scanned; a null doc_id is
returned as null; ties go to the template named first in the alphabet; of overlapping matches the better
one stays; ``line`` is that of a match's first word; blocks are cut at `BLOCK_WORDS`
words, each overlapping the one before by the longest template, so long lines are scanned whole; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from difflib import SequenceMatcher
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_bytes, values

#: Wordings of public licenses.
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_TERMS = ", provided that the above copyright notice and this permission notice appear in all copies"
ISC_REST = (
    ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
    "THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_FIRST = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
BSD_REST = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU_NOTICE = "This work is licensed under the {name}, version {version}."
GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
GNU = {
    "GPL-2.0": ("GNU General Public License", "2"),
    "GPL-3.0": ("GNU General Public License", "3"),
    "LGPL-2.1": ("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3"),
    "AGPL-3.0": ("GNU Affero General Public License", "3"),
}
CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = {"3.0": "Unported", "4.0": "International"}
#: Templates by SPDX identifier; what follows in `FORMS` names the wording. The first sentence of the BSD licenses alone does not say which one it is.
TEMPLATES = (
    {
        "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "Apache-2.0-header": APACHE,
        "MIT": "Released under the MIT License.",
        "MIT-text": MIT_GRANT,
        "MIT-full": f"{MIT_GRANT} {MIT_REST}",
        "ISC": "Released under the ISC License.",
        "ISC-text": ISC_GRANT + ISC_TERMS + ISC_REST,
        "0BSD-text": ISC_GRANT + ISC_REST,
        "LicenseRef-BSD": BSD_FIRST,
        "BSD-2-Clause": "Released under the BSD 2-Clause License.",
        "BSD-2-Clause-text": BSD_FIRST + BSD_TWO + BSD_REST,
        "BSD-3-Clause": "Released under the BSD 3-Clause License.",
        "BSD-3-Clause-text": BSD_FIRST + BSD_TWO + BSD_THIRD + BSD_REST,
        "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    }
    | {k: GNU_NOTICE.format(name=n, version=v) for k, (n, v) in GNU.items()}
    | {f"{k}-header": GNU_HEADER.format(name=n, version=v) for k, (n, v) in GNU.items()}
    | {f"CC-{k}-{v}": f"Licensed under CC {k} {v}." for k in CC for v in CC_VERSIONS}
    | {f"CC-{k}-{v}-notice": f"This work is licensed under a Creative Commons {n} {v} {w} License." for k, n in CC.items() for v, w in CC_VERSIONS.items()}
)
FORMS = ("-header", "-text", "-full", "-notice")
#: Words that licenses exchange without becoming others.
NEUTRAL = frozenset("a an and by code file in is of or or program software the this to under work library".split())
VARIANT = "LicenseRef-variant-of-"
#: Every template holds one of these.
TRIGGER = r"(?i)licen[sc]e|copyright|hereby[\W_]+granted|redistribution[\W_]+and[\W_]+use|free[\W_]+software"
BLOCK_WORDS = 640
#: Templates up to so many words are looked for in windows of four times as many; longer ones in windows of four times the longest.
REACHES = (16, 64)
#: From this similarity of their words on two templates of different licenses are siblings; runs of words up to `SHORT` must agree whole.
SIBLING, SHORT = 0.5, 4
MIN_COVERAGE = 0.8
#: Share of the block's own compressed size that the dictionary must save, for a block no longer than the template.
MIN_REDUCTION = 0.15


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:\.[^\W_]+)*", text.lower())


def license_of(name: str) -> str:
    """The license of a template: its name without the form of the wording."""
    return next((name.removesuffix(f) for f in FORMS if name.endswith(f)), name)


def distinctions(words: dict[str, list[str]]) -> dict[str, list[tuple[int, tuple[int, ...], tuple[str, ...]]]]:
    """What tells each template from its siblings: where the two differ, its own words there (by place), and the sibling's."""
    out: dict[str, set] = {k: set() for k in words}
    for name, own in words.items():
        for other, theirs in words.items():
            if license_of(other) == license_of(name):
                continue
            same = SequenceMatcher(None, own, theirs, autojunk=False)
            if same.ratio() >= SIBLING:
                for kind, a, b, c, d in same.get_opcodes():
                    mine, foreign = tuple(i for i in range(a, b) if own[i] not in NEUTRAL), tuple(w for w in theirs[c:d] if w not in NEUTRAL)
                    if kind != "equal" and (mine or foreign):
                        out[name].add((a, mine, foreign))
    return {k: sorted(v) for k, v in out.items()}


class Scanner:
    """Templates as prepared raw dictionaries, and what tells each from its siblings."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, level: int = 3):
        self.names = sorted(templates)
        self.words = {k: words_of(templates[k]) for k in self.names}
        self.plain = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.given = {
            k: zstandard.ZstdCompressor(level=level, write_checksum=False, dict_data=zstandard.ZstdCompressionDict(templates[k].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for k in self.names
        }
        self.trigger = re.compile(TRIGGER)
        self.longest = max(map(len, self.words.values()))
        self.apart = distinctions(self.words)
        self.by_size: dict[int, list[str]] = {}
        for k in self.names:
            self.by_size.setdefault(next((r for r in REACHES if len(self.words[k]) <= r), self.longest), []).append(k)

    def blocks(self, text: str):
        """``[(word, line)]``: each run of lines within a template's reach of a trigger, overlaps merged."""
        lines = text.split("\n")
        begins = list(accumulate((len(line) + 1 for line in lines), initial=0))
        spans = {(bisect_right(begins, m.start()) - 1, bisect_right(begins, m.end() - 1) - 1) for m in self.trigger.finditer(text)}
        if not spans:
            return
        before = list(accumulate((len(line.split()) for line in lines), initial=0))  # words before each line
        reach, hot, last_hot = 2 * self.longest, [], -1
        for first, last in sorted(spans):
            low = max(last_hot + 1, bisect_right(before, before[first] - reach) - 1, 0)
            high = min(len(lines), bisect_right(before, before[last + 1] + reach))
            hot.extend(range(low, high))
            last_hot = max(last_hot, high - 1)
        run, at = [], None
        for k in hot:
            if run and k != at + 1:
                yield run
                run = []
            run += [(w, k) for w in lines[k].split()]
            at = k
        if run:
            yield run

    def ranked(self, block: str, names: list[str] | None = None) -> list[tuple[float, str]]:
        """``(share of the template's size saved, name)`` from the best down."""
        raw = block.encode()
        alone = len(self.plain.compress(raw))
        saved = [((alone - len(self.given[k].compress(raw))) / max(1, min(alone, len(" ".join(self.words[k])))), k) for k in names or self.names]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def windows(self, part: list[str]):
        """``(begin, end, templates)``: what a template saves shows in a window not much longer than it; windows overlap by more than a match."""
        for reach, names in self.by_size.items():
            for at in range(0, max(1, len(part) - 2 * reach), 2 * reach):
                if self.trigger.search(" ".join(part[at : at + 4 * reach])):
                    yield at, min(len(part), at + 4 * reach), names

    def differs(self, name: str, kept: set[int], foreign: list[str], gaps: set[int]) -> bool:
        """Whether a match lacks what tells the template from a sibling, holds what tells the sibling from it, or anything in a gap where a sibling has more."""
        other = set(foreign)
        for at, mine, theirs in self.apart[name]:
            if not mine and at in gaps:
                return True
            lost, found = sum(i not in kept for i in mine), sum(w in other for w in theirs)
            if lost > (0 if len(mine) <= SHORT else len(mine) // 5) or theirs and found >= (len(theirs) if len(theirs) <= SHORT else len(theirs) / 2):
                return True
        return False

    def align(self, have: list[str], name: str) -> tuple[float, list[str], list[str], int, int, bool]:
        """`compare` for a block's words, the span of the match (the matching blocks that lie closest together), and whether it is a variant."""
        want = self.words[name]
        same = [m for m in SequenceMatcher(None, have, want, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return 0.0, want, [], 0, 0, True
        # The run of matching blocks with most matched words less the foreign ones between them.
        best, total, first = (0, 0, 0), 0, 0
        for k, m in enumerate(same):
            gap = m.a - same[k - 1].a - same[k - 1].size if k else 0
            if total - gap <= 0:
                total, first, gap = 0, k, 0
            total += m.size - gap
            if total > best[0]:
                best = total, first, k
        same = same[best[1] : best[2] + 1]
        kept = {i for m in same for i in range(m.b, m.b + m.size)}
        inside = {i for m in same for i in range(m.a, m.a + m.size)}
        a, b = min(inside), max(inside)
        foreign = [have[i] for i in range(a, b + 1) if i not in inside]
        # A sibling's words may stand just outside of what matches, where the first or last words differ.
        edge = have[max(0, a - same[0].b) : a] if same[0].b else []
        edge += have[b + 1 : b + 1 + len(want) - same[-1].b - same[-1].size]
        gaps = {n.b for m, n in zip(same, same[1:]) if m.b + m.size == n.b and not NEUTRAL.issuperset(have[m.a + m.size : n.a])}
        return len(kept) / len(want), [w for i, w in enumerate(want) if i not in kept], foreign, a, b + 1, self.differs(name, kept, foreign + edge, gaps)

    def compare(self, block: str, name: str) -> tuple[float, list[str], list[str]]:
        """Share of the template's words that the block has in order; missing words; foreign words between them."""
        return self.align(words_of(block), name)[:3]

    def matches(self, block: list[str], offset: int = 0):
        """``(rank, first word, end, license, reduction, coverage, missing, foreign)``: confirmed matches that do not overlap."""
        todo = [(block, offset)]
        while todo:
            part, at = todo.pop()
            best = None
            for low, high, names in self.windows(part):
                have = [(w, i) for i in range(low, high) for w in words_of(part[i])]
                plain = [w for w, _ in have]
                for reduction, name in self.ranked(" ".join(part[low:high]), names):
                    if reduction < MIN_REDUCTION:
                        break
                    coverage, missing, foreign, a, b, variant = self.align(plain, name)
                    if coverage >= MIN_COVERAGE and len(foreign) <= max(2, len(self.words[name]) // 5):
                        rank = (len(self.words[name]) - len(missing) - len(foreign), not variant, coverage, reduction)
                        if best is None or rank > best[0]:
                            best = rank, have[a][1], have[b - 1][1] + 1, VARIANT * variant + name, round(reduction, 6), round(coverage, 6), missing, foreign
            if best:
                yield best[0], at + best[1], at + best[2], *best[3:]
                todo += [(part[: best[1]], at), (part[best[2] :], at + best[2])]

    def scan(self, text: str):
        """``(line, license, reduction, coverage, missing, foreign)`` of every confirmed match."""
        step = BLOCK_WORDS - min(self.longest, BLOCK_WORDS // 2)
        for block in self.blocks(text):
            words, found, kept = [w for w, _ in block], [], []
            for k in range(0, max(1, len(words) - (BLOCK_WORDS - step)), step):
                found += self.matches(words[k : k + BLOCK_WORDS], k)
            for m in sorted(found, key=lambda m: (m[0], -m[1]), reverse=True):  # pieces overlap: the better of two matches stays
                if all(m[2] <= o[1] or o[2] <= m[1] for o in kept):
                    kept.append(m)
            for m in sorted(kept, key=lambda m: m[1]):
                yield block[m[1]][1], *m[3:]


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """A row for every confirmed match. Texts without a trigger word are dropped before Python sees them."""
    templates = templates or TEMPLATES

    def run(batches):
        s = Scanner(templates)
        for batch in batches:
            keys = values(batch, "id")
            rows = [(keys[i], *found) for i, t in text_bytes(batch) for found in s.scan(t.decode("utf-8", "replace"))]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "line", "license_id", "size_reduction", "coverage", "missing_words", "foreign_words"])

    source = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike(TRIGGER))
    return source.mapInArrow(run, "doc_id long, line long, license_id string, size_reduction double, coverage double, missing_words array<string>, foreign_words array<string>")
