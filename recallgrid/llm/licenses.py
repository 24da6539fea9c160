"""License scans with a generalised suffix automaton.

All templates (``TEMPLATES``: notices, file headers and, in ``licence_texts``, whole texts of common public licences) are sequences of words. One
suffix automaton recognises every run of words of every template. A text is streamed through it: at
each word the automaton holds the longest run ending there that some template has (the matching
statistics). Runs of at least MIN_RUN words that cannot be extended are matches; matches of one
template in ascending order on both sides, at most MAX_GAP words apart, are chained to a span that covers as
many template words as possible, and a span is reported if it covers COVERAGE of its template and every
run of words that the template has in braces: licence name and version, which tell it from its siblings. Such a run
must stand whole within one match, and its version must not go on ('version 2.1' is not 'version 2', nor 'MIT-0' 'MIT').

Every match consists of runs of MIN_RUN words that some template has, so only stretches of such runs are streamed, and
a template is looked for only in texts whose stretches have as many words as it takes.

Defined results: null, empty and wordless texts have no spans, an empty table no rows. Repeated rows are scanned each, texts whole, at any
length; a null doc_id stays null.
If spans of several templates overlap, the one with more covered words stays, then the higher coverage, then the
earlier place, then the name that comes first. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches, textvec

MIN_RUN = 3
MAX_GAP = 12
COVERAGE = 0.75
#: What carries a version or an id on: '.1' but not '.0', and after an id a hyphen and more.
MORE = re.compile(rb"[.](?!0+(?![0-9]))[0-9]")
TITLE = re.compile(r"((?:GNU (?:LESSER |LIBRARY |FREE )?(?:GENERAL PUBLIC|DOCUMENTATION) LICENSE|Apache License|Mozilla Public License|Eclipse Public License|Boost Software License)\W+v?(?:ersion)?\W*\d(?:\.\d)?)", re.IGNORECASE)
MORE_ID = re.compile(MORE.pattern + rb"|-[a-z0-9]")
SCHEMA = "doc_id long, license string, begin int, end int, covered int, coverage double"

_MIT = " ".join(
    [
        'Permission is hereby granted, free of charge, to',
        'any person obtaining a copy of this software',
        'and associated documentation files (the "Software"), to deal',
        'in the Software without restriction, including without limitation',
        'the rights to use, copy, modify, merge, publish,',
        'distribute, sublicense, and/or sell copies of the Software,',
        'and to permit persons to whom the Software',
        'is furnished to do so, subject to the',
        'following conditions: The above copyright notice and this',
        'permission notice shall be included in all copies',
        'or substantial portions of the Software.',
    ]
)
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""

#: (words before the name, names) of short notices
_LEADS = ["Released under the", "Licensed under the", "This work is licensed under the", "This project is licensed under the terms of the"]
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_NAMES = {"MIT": ["MIT License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"]} | {
    f"{short}-{version}.0" if "." not in version else f"{short}-{version}": [
        *(f"{name}{x}" for name in (long, f"{long} ({short})", f"GNU {short}") for x in (f", version {version}", f" v{version}", f" {version}")),
        f"GNU {short}v{version}", f"{short}v{version} license", f"{short}-{version} license",
    ]
    for short, long in _GNU.items() for version in {"GPL": ["2", "3"], "LGPL": ["2", "2.1", "3"], "AGPL": ["3"]}[short]
}
_SPDX = "MIT MIT-0 Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC Zlib BSL-1.0 Unlicense WTFPL MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0".split()
_SPDX += "EUPL-1.2 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 Artistic-2.0 OFL-1.1 PSF-2.0 NCSA Python-2.0".split()
_SPDX += [x + only for x in "GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 GFDL-1.2 GFDL-1.3".split() for only in ("", "-only", "-or-later")]

_HEADERS = [("GPL", "1"), ("GPL", "2"), ("GPL", "3"), ("LGPL", "2"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")]
_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the {NAME}
as published by the Free Software Foundation, either {version NUMBER of the License}, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the NAME for more details."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _whole() -> list[tuple[str, str]]:
    """The licence texts in licence_texts; title and version at the top must be there where the text has them."""
    found = []
    for file in sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        text = file.read_text().replace("{", " ").replace("}", " ")
        found.append((file.name.removesuffix(".txt"), TITLE.sub(r"{\1}", text, count=1)))
    return found


#: (licence, text); words in braces must be there
TEMPLATES = [
    *((licence, f"{lead} {{{name}}}") for licence, names in _NAMES.items() for name in names for lead in _LEADS),
    *((re.sub("-only|-or-later", "", licence), f"SPDX-License-Identifier: {{{licence}}}") for licence in _SPDX),
    ("MIT", _MIT),
    ("Apache-2.0", """Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    *((f"{short}-{version}" if "." in version else f"{short}-{version}.0", _HEADER.replace("NAME", _GNU[short]).replace("NUMBER", version)) for short, version in _HEADERS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + """ Neither the name of the copyright holder nor the names of its contributors may be used to {endorse or promote
products derived} from this software without specific prior written permission."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
""" + _ISC_END),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    ("CC-BY-NC-4.0", "Licensed under {CC BY-NC 4.0}"),
    ("CC-BY-4.0", "Licensed under {CC BY 4.0}"),
    ("CC-BY-SA-4.0", "Licensed under {CC BY-SA 4.0}"),
    ("CC-BY-4.0", "This work is licensed under a {Creative Commons Attribution 4.0} International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a {Creative Commons Attribution-ShareAlike 4.0} International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a {Creative Commons Attribution-NonCommercial 4.0} International License"),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    *_whole(),
]


class SuffixAutomaton:
    """Of several token sequences; every state knows where its runs end in which sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._add(last, token)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]
        self.places = [sorted(e) for e in self.ends]

    def _state(self, length: int, next_: dict, link: int) -> int:
        self.next.append(next_), self.link.append(link), self.length.append(length), self.ends.append(set())
        return len(self.next) - 1

    def _add(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """For every place the longest run ending there that a sequence has: its state and length."""
        state, size, out = 0, 0, []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state = self.next[state].get(token, 0)
            size = size + 1 if state else 0
            out.append((state, size))
        return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        w = textvec.words(pa.array([t for _, t in templates], pa.string()))
        self.names = [n for n, _ in templates]
        self.keys = np.unique(w.hash)
        tokens = np.searchsorted(self.keys, w.hash).tolist()
        sequences = [tokens[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.sizes = [len(s) for s in sequences]
        opened = np.cumsum(w.buf == ord("{"))
        group = np.where(opened > np.cumsum(w.buf == ord("}")), opened, 0)[w.start]
        new = np.flatnonzero(np.diff(np.concatenate([[0], group])))
        ends = np.append(new[1:], len(group))
        #: by template the runs of words that must be there: first, after, whether it is an id, which a hyphen carries on
        self.required: list[list[tuple[int, int, bool]]] = [[] for _ in sequences]
        for a, b in zip(new.tolist(), ends.tolist()):
            if group[a]:
                row = int(w.row[a])
                self.required[row].append((a - int(w.first[row]), b - int(w.first[row]), templates[row][1].startswith("SPDX")))
        self.automaton = SuffixAutomaton(sequences)
        self.runs = np.unique(np.array([self._code(s[k : k + MIN_RUN]) for s in sequences for k in range(len(s) - MIN_RUN + 1)], np.int64))
        self.needs = [math.ceil(COVERAGE * n - 1e-9) for n in self.sizes]

    def _code(self, tokens):
        """One number for MIN_RUN words, or for as many arrays of words."""
        code = tokens[0] * 0
        for t in tokens:
            code = code * len(self.keys) + t
        return code

    def matches(self, tokens: list[int]) -> list[tuple[int, int, int, int]]:
        """(template, place in it, place in tokens, words) of all runs of MIN_RUN words or more that cannot be extended to the right."""
        found, automaton = [], self.automaton
        stats = automaton.statistics(tokens)
        for i, (state, size) in enumerate(stats):
            if size < MIN_RUN or i + 1 < len(stats) and stats[i + 1][1] == size + 1 and len(automaton.places[state]) == len(automaton.places[stats[i + 1][0]]):
                continue
            following = tokens[i + 1] if i + 1 < len(tokens) else -1
            longer = {(t, p - 1) for t, p in automaton.places[stats[i + 1][0]]} if i + 1 < len(stats) and stats[i + 1][1] == size + 1 else ()
            found += [(t, p - size + 1, i - size + 1, size) for t, p in automaton.places[state] if (t, p) not in longer or following < 0]
        return found

    def spans(self, w: textvec.Words) -> list[tuple[int, int, int, int, int]]:
        """(row, template, first word, word after, covered) of the reported spans."""
        if not len(w.hash):
            return []
        at = np.minimum(np.searchsorted(self.keys, w.hash), len(self.keys) - 1)
        known = self.keys[at] == w.hash
        count = len(known) - MIN_RUN + 1
        if count < 1:
            return []
        parts = [at[k : k + count] for k in range(MIN_RUN)]
        code = self._code(parts)
        run = (w.row[:count] == w.row[MIN_RUN - 1 :]) & np.all([known[k : k + count] for k in range(MIN_RUN)], axis=0)
        run &= self.runs[np.minimum(np.searchsorted(self.runs, code), len(self.runs) - 1)] == code
        change = np.diff(np.concatenate([[0], run.astype(np.int8), [0]]))
        first, size = np.flatnonzero(change == 1), np.flatnonzero(change == -1) - np.flatnonzero(change == 1) + MIN_RUN - 1
        words = np.bincount(w.row[first], size, len(w))
        by: dict[tuple[int, int], list] = defaultdict(list)
        for a, n in zip(first.tolist(), size.tolist()):
            row = int(w.row[a])
            if words[row] >= min(self.needs):
                for template, there, here, length in self.matches(at[a : a + n].tolist()):
                    if self.needs[template] <= words[row]:
                        by[row, template].append((a + here, there, length))
        best: dict[int, list] = defaultdict(list)
        for (row, template), found in by.items():
            if sum(length for _, _, length in found) < self.needs[template]:
                continue
            for begin, end, covered, path in self.chains(sorted(set(found))):
                if covered >= COVERAGE * self.sizes[template] - 1e-9 and all(any(self.holds(w, match, group) for match in path) for group in self.required[template]):
                    best[row].append((-covered, -covered / self.sizes[template], begin, self.names[template], template, end))
        out = []
        for row, spans in sorted(best.items()):
            taken: list[tuple[int, int]] = []
            for minus, _, begin, _, template, end in sorted(spans):
                if all(end <= a or begin >= b for a, b in taken):
                    taken.append((begin, end))
                    out.append((row, template, begin, end, -minus))
        return sorted(out, key=lambda s: (s[0], s[2]))

    @staticmethod
    def holds(w: textvec.Words, match: tuple[int, int, int], group: tuple[int, int, bool]) -> bool:
        """Whether a match has all words of a required run, and the name or version in the text does not go on after them."""
        (here, there, words), (first, after, exact) = match, group
        if first < there or after > there + words:
            return False
        last = here + after - 1 - there
        follows = w.buf[w.end[last] : min(w.end[last] + 16, w.row_at[w.row[last] + 1])].tobytes()
        return not (MORE_ID if exact else MORE).match(follows)

    @staticmethod
    def chains(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, list]]:
        """(first word, word after, covered, matches) of the best chain that ends at each match, best ones first, each match used once."""
        value, back = [], []
        reach = MAX_GAP + max((words for _, _, words in found), default=0)
        for k, (here, there, words) in enumerate(found):
            top, link = words, -1
            for j in range(k - 1, -1, -1):
                h, t, n = found[j]
                if here - h > reach:
                    break
                # what the two share on either side counts once
                gain = min(words, here + words - (h + n), there + words - (t + n))
                if gain > 0 and h < here and t < there and here - (h + n) <= MAX_GAP and value[j] + gain >= top:
                    top, link = value[j] + gain, j
            value.append(top), back.append(link)
        used, out = set(), []
        for k in sorted(range(len(found)), key=lambda k: (-value[k], k)):
            path, j = [], k
            while j >= 0 and j not in used:
                path.append(j)
                j = back[j]
            if path and j < 0:
                out.append((found[path[-1]][0], found[k][0] + found[k][2], value[k], [found[j] for j in path]))
            used.update(path)
        return out


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row for every span, by character offsets."""
    shared = documents.sparkSession.sparkContext.broadcast(Scanner(templates))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = shared.value
        w = textvec.words(batch.column("text"))
        found = scanner.spans(w)
        row, template, begin, end, covered = (np.array([f[k] for f in found], np.int64) for k in range(5))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(row)),
                pa.array([scanner.names[t] for t in template], pa.string()),
                pa.array((w.char_at(w.start[begin]) if len(found) else begin).astype(np.int32)),
                pa.array((w.char_at(w.start[end - 1]) + [w.buf[w.start[e - 1] : w.end[e - 1]].tobytes().decode().__len__() for e in end] if len(found) else end).astype(np.int32)),
                pa.array(covered.astype(np.int32)),
                pa.array(np.round(covered / np.array(scanner.sizes)[template], 6) if len(found) else np.zeros(0)),
            ],
            ["doc_id", "license", "begin", "end", "covered", "coverage"],
        )

    return batches.map_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


def op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(batches.read(spark, sf_dir, "documents"))
