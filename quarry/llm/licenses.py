"""License scan: template markup compiled to token automata.

A template is a text with two kinds of regions: `[[ ... ]]` may be left out, `<<n>>` stands
for up to n words of any kind. Everything else is mandatory wording and must match word
for word. All templates go into one automaton over word tokens; its subset states are
built when first met and kept, so a text costs one dictionary step per word near a
possible start and none elsewhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import map_arrow, pick, small_batches, table, utf8

# The base phrases and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
# Our templates for licence texts, their notices, and short mentions.
TEMPLATES = (
    ("apache-2.0", "Apache License [[version]] 2.0"),
    (
        "apache-2.0-notice",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at [[http]] [[https]] www.apache.org/licenses/LICENSE-2.0 [[.html]] Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.
        [[[[3.]] Neither the name of <<12>> nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.]]
        THIS SOFTWARE IS PROVIDED BY <<12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
        PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    ("cc-by-nc-4.0", "CC BY NC 4.0 [[International]]"),
    ("cc-by-sa", "CC BY SA <<1>> 0"),
    ("copyright-notice", "Copyright [[(c)]] <<10>> All rights reserved"),
    ("gpl-3", "GNU General Public License [[as published by the Free Software Foundation, either]] [[v3]] version 3"),
    (
        "gpl-notice",
        """This program is free software[[;]] you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation; either version <<1>> of the License, or (at your option) any later version. This program is distributed in the
        hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details.""",
    ),
    (
        "isc-text",
        """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<12>> DISCLAIMS ALL WARRANTIES WITH
        REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<12>> BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("mit", "[[the]] MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy <<20>> to deal in the Software without restriction"),
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions
        of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    ("mpl-2.0", "Mozilla Public License [[v]] [[version]] 2.0"),
    ("public-domain", "[[released]] [[dedicated]] [[in]] [[into]] [[to]] the public domain"),
    (
        "unlicense-grant",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    (
        "zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions: [[1.]] The origin of this software must not be misrepresented; you must
        not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. [[2.]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. [[3.]] This notice may not be removed or altered from any source distribution.""",
    ),
)

#: Bytes to word bytes: A-Z in lower case, all that isn't 0-9, a-z or above 0x7F a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of 0-9, a-z and what is beyond ASCII, A-Z in lower case."""
    return text.translate(_WORDS).split()


def units(markup: str) -> list[str]:
    """A template's parts in order: "[[", "]]", "<<n>>" and words."""
    parts = re.split(r"(\[\[|\]\]|<<\d+>>)", markup)
    return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else [w.decode() for w in words(part.encode())])]


@dataclass
class Automaton:
    """Words, "any" edges and ends of all templates; subset states are numbered as met."""

    templates: tuple[tuple[str, str], ...]
    edges: list[dict] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    ends: dict[int, int] = field(default_factory=dict)
    mandatory: list[int] = field(default_factory=list)

    ANY = b""

    def __post_init__(self) -> None:
        starts = [self._compile(k, markup) for k, (_, markup) in enumerate(self.templates)]
        known = {w for e in self.edges for w in e if w}
        self.number = {w: i + 1 for i, w in enumerate(sorted(known))}
        self.sets: list[frozenset[int]] = []
        self.ids: dict[frozenset[int], int] = {}
        self.steps: dict[tuple[int, int], int] = {}
        self.accepts: list[tuple[int, ...]] = []
        self.by_number = [self.ANY, *sorted(known)]
        self.dead = self._id(frozenset())
        self.start = self._id(self._closed(starts))
        self.firsts = {w for s in self.sets[self.start] for w in self.edges[s] if w}

    def _new(self) -> int:
        self.edges.append({})
        self.skips.append([])
        return len(self.edges) - 1

    def _compile(self, k: int, markup: str) -> int:
        at = start = self._new()
        opened, count = [], 0
        for part in units(markup):
            if part == "[[":
                opened.append(at)
            elif part == "]]":
                self.skips[opened.pop()].append(at)
            elif part.startswith("<<"):
                first, stops = at, []
                for _ in range(int(part[2:-2])):
                    new = self._new()
                    self.edges[at].setdefault(self.ANY, []).append(new)
                    stops.append(at)
                    at = new
                for s in {first, *stops}:
                    self.skips[s].append(at)
            else:
                new = self._new()
                self.edges[at].setdefault(part.encode(), []).append(new)
                at = new
                count += not opened
        self.ends[at] = k
        self.mandatory.append(count)
        return start

    def _closed(self, states: list[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for n in self.skips[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def _id(self, states: frozenset[int]) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.accepts.append(tuple(sorted(self.ends[s] for s in states if s in self.ends)))
        return self.ids[states]

    def step(self, state: int, number: int) -> int:
        if (to := self.steps.get((state, number))) is None:
            word = self.by_number[number]
            reached = [n for s in self.sets[state] for w in ({word, self.ANY} if word else {self.ANY}) for n in self.edges[s].get(w, ())]
            to = self.steps[state, number] = self._id(self._closed(reached))
        return to

    def places(self, tokens: list[bytes]) -> list[tuple[int, int]]:
        """(template, start word) of every place that a template accepts, starts ascending."""
        if self.firsts.isdisjoint(tokens):
            return []
        firsts, number, dead, found = self.firsts, self.number, self.dead, []
        for i in [i for i, w in enumerate(tokens) if w in firsts]:
            state, hit, at = self.start, set(), i
            while state != dead and at < len(tokens):
                state = self.step(state, number.get(tokens[at], 0))
                hit.update(self.accepts[state])
                at += 1
            found += [(k, i) for k in sorted(hit)]
        return found


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per input row: word count, base places, and the labels of base and templates.

    Reads doc_id and text only. A null text is empty: no words, no labels, score 0. Texts
    are scanned whole; equal rows give equal rows; a null doc_id stays null; an empty table
    gives no rows. score is m / (m + 1) for the most mandatory words m that a matched
    template has.
    """
    every = (*BASE, *templates)

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = find.__dict__.setdefault("automaton", Automaton(every))
        rows = []
        for text in utf8(batch.column(1)):
            tokens = words(text)
            places = automaton.places(tokens)
            base = [i for k, i in places if k < len(BASE)]
            base_labels = {BASE[k][0] for k, _ in places if k < len(BASE)}
            labels = {every[k][0] for k, _ in places}
            most = max((automaton.mandatory[k] for k, _ in places), default=0)
            rows.append((len(tokens), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), most / (most + 1)))
        names = [x.split()[0] for x in COLUMNS.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        columns = [batch.column(0), *map(list, zip(*rows, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(columns, kinds, strict=True)], names=names)

    small_batches(docs.sparkSession)
    return map_arrow(pick(docs, doc_id="long", text="string"), find, COLUMNS)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _pattern(markup: str) -> str:
    """The markup as an RE2 pattern over ' word word ... ' with a blank after each word."""
    out = ""
    for part in units(markup):
        out += "(" if part == "[[" else ")?" if part == "]]" else f"([^ ]+ ){{0,{part[2:-2]}}}" if part.startswith("<<") else f"{part} "
    return f" {out}"


def _sql() -> str:
    phrases = ", ".join(f"{{'label': '{label}', 'w': {phrase.split()!r}}}" for label, phrase in BASE)
    every = [*BASE, *TEMPLATES]
    most = Automaton(tuple(every)).mandatory
    hits = ", ".join(f"CASE WHEN regexp_matches(line, '{_pattern(markup)}') THEN {{'label': '{label}', 'm': {m}}} END" for (label, markup), m in zip(every, most, strict=True))
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (
  SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS line,
    flatten(list_transform([{phrases}], lambda b: list_transform(list_filter(range(len(ws)), lambda i: list_slice(ws, i + 1, i + len(b.w)) = b.w), lambda i: {{'i': i, 'label': b.label}}))) AS places FROM w),
h AS (SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM p)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(places, lambda x: x.i)) AS BIGINT) AS first_word, CAST(list_max(list_transform(places, lambda x: x.i)) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.label))), ','), '') AS labels,
  CAST(coalesce(list_max(list_transform(hits, lambda x: x.m)), 0) AS DOUBLE) / (coalesce(list_max(list_transform(hits, lambda x: x.m)), 0) + 1) AS score
FROM h
"""


ORACLE_SQL = _sql()
