"""Licence scans with a generalised suffix automaton of licence texts.

The automaton recognises every run of words that occurs in any template.  Each document's words
are streamed through it; at every word the state and length of the longest run that ends there
(the matching statistics) are known.  Fixed phrases are counted from the states; long maximal
matches, at every place that they have in a template, are chained along it so that the most words
are covered, and each chain that covers its template well gives its label and a span, a template
that stands twice in a text two of them.  Words outside all templates end every match, so only runs
of template words are walked, all runs of a batch at the same time.

Spark deals out the documents; nothing is shuffled, and only the automaton is broadcast, whose
size is that of the templates (at most ``MOST_WORDS`` words).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterlake.llm.common import Words, chunks, string_words, without

#: Words that all templates together may have.
MOST_WORDS = 1_000_000
#: Words of a match that takes part in a chain.
LEAST = 4
#: Document words between two matches of a chain.
GAP = 12
#: Share of a template's words that a chain must cover.
COVERED = 0.75

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Whole public licence texts without their titles and holders, by label; each is one template.
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: Public licence notices, by label; lines are templates of their own.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
Released under the MIT License.
Licensed under the MIT License.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
Licensed under the Apache License, Version 2.0""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This work is licensed under the GNU General Public License, version 3.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License.
Licensed under the Creative Commons Attribution License.""",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


class Automaton:
    """Generalised suffix automaton over the word numbers of ``templates`` (label, words)."""

    def __init__(self, templates: list[tuple[str, list[str]]], phrases: list[tuple[str, list[str]]]):
        self.labels = [label for label, _ in templates]
        self.lengths = [len(words) for _, words in templates]
        self.phrase_labels = [label for label, _ in phrases]
        self.phrase_sizes = np.array([len(words) for _, words in phrases], np.int64)
        every = [words for _, words in templates] + [words for _, words in phrases]
        if sum(map(len, every)) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words")
        self.vocabulary = pa.array(sorted({w for words in every for w in words}), pa.large_string())
        number = {w: k for k, w in enumerate(self.vocabulary.to_pylist())}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        places: list[tuple[int, int, int]] = []
        phrase_states = []
        for t, words in enumerate(every):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, number[word])
                if t < len(templates):
                    places.append((last, t, at + 1))
            phrase_states.append(last)
        # what ends in a state ends in its suffixes too: in the order of the link tree the places of a state are one range
        below: list[list[int]] = [[] for _ in self.link]
        for s in range(1, len(self.link)):
            below[self.link[s]].append(s)
        enter, leave = np.zeros(len(self.link), np.int64), np.zeros(len(self.link), np.int64)
        stack, clock = [(0, False)], 0
        while stack:
            s, done = stack.pop()
            if done:
                leave[s] = clock
                continue
            enter[s] = clock
            clock += 1
            stack += [(s, True), *((c, False) for c in below[s])]
        own = np.array(places, np.int64).reshape(-1, 3)
        own = own[np.argsort(enter[own[:, 0]], kind="stable")]
        order = enter[own[:, 0]]
        self.place_template, self.place_end = own[:, 1], own[:, 2]
        self.place_from, self.place_to = np.searchsorted(order, enter), np.searchsorted(order, leave)
        self.symbols = max(len(self.vocabulary), 1)
        edges = sorted((s * self.symbols + c, v) for s, out in enumerate(self.step) for c, v in out.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.targets = np.array([v for _, v in edges], np.int64)
        self.links, self.sizes = np.array(self.link, np.int64), np.array(self.size, np.int64)
        # the length that a match in a state needs for the phrase to end there
        self.need = np.full((len(self.link), len(phrases)), 1 << 40, np.int64)
        for k, (_, words) in enumerate(phrases):
            own = phrase_states[len(templates) + k]
            for s in range(1, len(self.link)):
                up = s
                while up > 0 and self.size[up] > self.size[own]:
                    up = self.link[up]
                if up == own:
                    self.need[s, k] = len(words) if s == own else 0
        self.shortest = min([len(w) for _, w in phrases] + [LEAST])
        # tasks only walk the arrays
        del self.step, self.link, self.size

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            q = self.step[last][c]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        new = self._state(self.size[last] + 1, {})
        p = last
        while p != -1 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.step[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the shorter runs of ``q``, those that extend ``p``."""
        copy = self._state(self.size[p] + 1, dict(self.step[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, size: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(0)
        return len(self.size) - 1

    def walk(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and length of the longest match that ends at each word."""
        state, length = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        known = ids >= 0
        edge = np.zeros(len(ids) + 1, bool)
        edge[bounds] = True
        before = np.zeros_like(known)
        before[1:] = known[:-1]
        starts = np.flatnonzero(known & (~before | edge[:-1]))
        after = np.zeros_like(known)
        after[:-1] = known[1:]
        sizes = np.flatnonzero(known & (~after | edge[1:])) + 1 - starts
        keep = sizes >= self.shortest
        starts, sizes = starts[keep], sizes[keep]
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        s, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -k, "left"))
            at = starts[:live] + k
            s, n = s[:live].copy(), n[:live].copy()
            c = ids[at]
            open_ = np.arange(live)
            while len(open_):
                key = s[open_] * self.symbols + c[open_]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[place] == key
                done = open_[hit]
                s[done] = self.targets[place[hit]]
                n[done] += 1
                open_ = open_[~hit]
                root = s[open_] == 0
                n[open_[root]] = 0
                open_ = open_[~root]
                s[open_] = self.links[s[open_]]
                n[open_] = self.sizes[s[open_]]
            state[at], length[at] = s, n
        return state, length

    def spans(self, state: np.ndarray, length: np.ndarray, bounds: np.ndarray, covered: float) -> list[tuple[int, str, int, int, float]]:
        """(row, label, first word, end word, share covered) of each chain that covers enough of its template, and of
        the best chain of each other template with matches."""
        goes_on = np.zeros(len(state), bool)
        goes_on[:-1] = length[1:] == length[:-1] + 1
        ends = np.flatnonzero((length >= LEAST) & ~goes_on)
        rows = np.searchsorted(bounds, ends, "right") - 1
        low, many = self.place_from[state[ends]], (self.place_to - self.place_from)[state[ends]]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        at, row, size = (np.repeat(x, many) for x in (ends, rows, length[ends]))
        template, end = self.place_template[place], self.place_end[place]
        stop = at + 1 - bounds[row]
        # first and end word in the document, first and end word in the template
        matches = np.stack([stop - size, stop, end - size, end], axis=1)
        order = np.lexsort((end, stop, template, row))
        matches, row, template = matches[order], row[order], template[order]
        cuts = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(template, prepend=-1)) if len(row) else np.zeros(0, np.int64)
        out = []
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)]):
            whole = self.lengths[template[lo]]
            for k, (words, first, last) in enumerate(chains(matches[lo:hi].tolist())):
                share = min(1.0, words / whole)
                if k == 0 or share >= covered:
                    out.append((int(row[lo]), self.labels[template[lo]], first, last, share))
        return out


def chains(matches: list[list[int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """Covered template words, first and end word of the chains of one template in one text, best first.

    ``matches`` (first and end word in the text, first and end word in the template) are sorted by
    their ends.  A chain goes on in text and template alike, with at most ``gap`` text words between
    matches; its words are those of the template that it adds at each step.  The best chain is taken,
    then the best of the matches that are left and do not overlap it in the text, and so on.
    """
    score = [m[3] - m[2] for m in matches]
    before = [-1] * len(matches)
    for i, (a, b, c, d) in enumerate(matches):
        for j in range(i - 1, -1, -1):
            p, q, r, s = matches[j]
            if q < a - gap:
                break
            if p < a and q < b and r < c and s < d:
                words = score[j] + min(d - max(c, s), b - max(a, q))
                if words > score[i]:
                    score[i], before[i] = words, j
    out, taken = [], []
    for i in sorted(range(len(matches)), key=lambda k: (-score[k], matches[k][0], k)):
        first = i
        while before[first] >= 0:
            first = before[first]
        a, b = matches[first][0], matches[i][1]
        at = bisect.bisect_left(taken, (a, 0))
        if (at < len(taken) and taken[at][0] < b) or (at and taken[at - 1][1] > a):
            continue
        taken.insert(at, (a, b))
        out.append((score[i], a, b))
    return out


def automaton(templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> Automaton:
    """The automaton of notices (label -> notices, one a line), whole texts (label -> text) and phrases (phrase -> label)."""
    if texts is None:
        texts = TEXTS if templates is None else {}
    notices = [(label, string_words(line)) for label, text in (TEMPLATES if templates is None else templates).items() for line in text.split("\n")]
    whole = [(label, string_words(text)) for label, text in texts.items()]
    fixed = [(label, string_words(phrase)) for phrase, label in (PHRASES if phrases is None else phrases).items()]
    return Automaton([x for x in [*notices, *whole] if x[1]], fixed)


def library(spark: SparkSession, folder: str) -> dict[str, str]:
    """label -> text of a folder of licence texts, a file each, for ``automaton(texts=...)``; bounded by ``MOST_WORDS`` there."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return {r["name"].rsplit(".", 1)[0].lower(): r["value"] for r in files.toLocalIterator()}


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("covered", T.DoubleType())])
RESULT = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.ArrayType(T.StringType())), ("labels", T.ArrayType(T.StringType())), ("spans", T.ArrayType(SPAN)), ("score", T.DoubleType())]


def scanned(docs: DataFrame, text: str = "text", found: Automaton | None = None, covered: float = COVERED) -> DataFrame:
    """``docs``, without the text, with the licences that each text mentions.

    Adds ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the fixed
    phrases (all places; null places if none); ``spans``, every chain that covers at least
    ``covered`` of its template, and the best one of other templates, with that share; ``labels``, sorted: those of phrases and of templates
    covered by at least ``covered``; ``score``: the highest share, 1 with a phrase.

    Null and empty texts have no words and no labels and score 0; an empty table gives an empty
    result.  Of chains that cover the same the first in the text counts.  Every row, repeated ones
    too, gets its own result; input columns named like results are replaced, others stay.  Whole
    texts of any length are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(found or automaton())
    kept = [c for c in without(docs, [n for n, _ in RESULT]) if c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, t) for n, t in RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(0)):
                yield _scanned(batch.slice(lo, hi - lo), shared.value, covered, [*kept, *(n for n, _ in RESULT)])

    return docs.select(text, *kept).mapInArrow(run, schema)


def _scanned(batch: pa.RecordBatch, found: Automaton, covered: float, names: list[str]) -> pa.RecordBatch:
    n = batch.num_rows
    words = Words(batch.column(0))
    bounds = words.bounds
    ids = pc.index_in(words.array, value_set=found.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    state, length = found.walk(ids, bounds)
    at, phrase = np.nonzero((length[:, None] >= found.need[state]) & (length[:, None] > 0))
    row = np.searchsorted(bounds, at, "right") - 1
    start = at + 1 - found.phrase_sizes[phrase] - bounds[row]
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(first, row, start)
    np.maximum.at(last, row, start)
    base: list[set[str]] = [set() for _ in range(n)]
    for r, k in set(zip(row.tolist(), phrase.tolist())):
        base[r].add(found.phrase_labels[k])
    spans: list[list[dict]] = [[] for _ in range(n)]
    for r, label, lo, hi, share in found.spans(state, length, bounds, covered):
        spans[r].append({"label": label, "start": lo, "end": hi, "covered": share})
    for own in spans:
        own.sort(key=lambda x: (x["start"], x["end"], x["label"]))
    none = pa.array(last < 0)
    columns = [
        *batch.columns[1:],
        pa.array(np.diff(bounds)),
        pa.array(np.bincount(row, minlength=n)),
        pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(first)),
        pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(last)),
        pa.array([sorted(b) for b in base], pa.list_(pa.string())),
        pa.array([sorted(b | {x["label"] for x in s if x["covered"] >= covered}) for b, s in zip(base, spans)], pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))),
        pa.array([1.0 if b else max((x["covered"] for x in s), default=0.0) for b, s in zip(base, spans)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)
