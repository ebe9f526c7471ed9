"""License scans by a generalised suffix automaton of license tokens.

The automaton accepts every run of words of the templates. A text is streamed through it once: at each word the state and
the length of the longest run ending there that stands in a template (matching statistics) are known. From them come

* base places: a phrase ends at a word if the state's suffix chain holds the phrase and the matched run is as long;
* matches: runs that can't be made longer, of ``least`` words or more, which are placed in each template that has them;
* spans: matches of one template that lie in order, with gaps of at most ``gap`` words in both, are chained; a chain that
  covers ``share`` of the template's words is a span with the template's label.

``Scanner`` has fixed size (its templates), so it is broadcast. Null text is empty: no words, no spans. Every row gives
one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import word_bytes

#: Fixed values of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public license texts and notices: whole short licenses, and the notices that files carry.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR
A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd", "licensed under the BSD License"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a
copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


class Automaton:
    """Generalised suffix automaton over sequences of tokens (numbers)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, end) of the runs of each state
        for k, seq in enumerate(sequences):
            last = 0
            for end, token in enumerate(seq, 1):
                last = self._extend(last, token)
                self.ends[last].add((k, end))
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """State of the runs of q that p's longest run with the token reaches."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token, self.next[last][token])
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token, self.next[p][token])
        return new


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], *, least: int = 4, gap: int = 8, share: float = 0.8):
        self.least, self.gap, self.share = least, gap, share
        self.numbers: dict[bytes, int] = {}
        texts = [*phrases, *(t for _, t in templates)]
        self.seqs = [[self.numbers.setdefault(w, len(self.numbers)) for w in word_bytes(t)] for t in texts]
        self.labels = [*phrases.values(), *(name for name, _ in templates)]
        self.n_phrases = len(phrases)
        self.sam = Automaton(self.seqs)
        # phrases on each state's suffix chain: they are the ends of its runs, if these are as long
        self.phrases_at: list[list[tuple[int, int]]] = [[] for _ in self.sam.length]
        for k in range(self.n_phrases):
            state = 0
            for token in self.seqs[k]:
                state = self.sam.next[state][token]
            self.phrases_at[state].append((len(self.seqs[k]), k))
        for v in sorted(range(1, len(self.sam.length)), key=self.sam.length.__getitem__):
            self.phrases_at[v] = self.phrases_at[v] + self.phrases_at[self.sam.link[v]]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """Number of words; base places (first word, last word, label); spans (first, last, label, covered share)."""
        words = word_bytes(text)
        arcs, link, length, phrases_at = self.sam.next, self.sam.link, self.sam.length, self.phrases_at
        get, least = self.numbers.get, self.least
        base: list[tuple[int, int, str]] = []
        runs: list[tuple[int, int, int]] = []  # end, length, state of runs that can't be made longer
        state = size = 0
        for i, token in enumerate(map(get, words)):
            if token is None:
                if size >= least:
                    runs.append((i, size, state))
                state = size = 0
                continue
            if token not in arcs[state]:
                if size >= least:
                    runs.append((i, size, state))
                while state and token not in arcs[state]:
                    state = link[state]
                    size = length[state]
            if token in arcs[state]:
                state = arcs[state][token]
                size += 1
                for n, k in phrases_at[state]:
                    if n <= size:
                        base.append((i - n + 1, i, self.labels[k]))
        if size >= least:
            runs.append((len(words), size, state))
        return len(words), base, self.chains(runs)

    def chains(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Chain long matches into covered template spans."""
        open_: dict[int, list[list[int]]] = {}  # template -> chains [text from, text to, template to, covered]
        spans: list[tuple[int, int, str, float]] = []

        def close(k: int, chain: list[int]) -> None:
            covered = chain[3] / len(self.seqs[k])
            if covered >= self.share:
                spans.append((chain[0], chain[1] - 1, self.labels[k], covered))

        for end, size, state in runs:
            for k, at in sorted(self.sam.ends[state]):
                if k < self.n_phrases:
                    continue
                keep = []
                chains = open_.get(k, [])
                best = None
                for chain in chains:
                    if end - size - chain[1] > self.gap:
                        close(k, chain)
                        continue
                    keep.append(chain)
                    fresh = min(end - chain[1], at - chain[2], size)
                    if fresh > 0 and at - fresh - chain[2] <= self.gap and (best is None or chain[3] > best[0][3]):
                        best = chain, fresh
                if best:
                    chain, fresh = best
                    chain[1], chain[2], chain[3] = end, at, chain[3] + fresh
                else:
                    keep.append([end - size, end, at, size])
                open_[k] = keep
        for k, chains in open_.items():
            for chain in chains:
                close(k, chain)
        return sorted(spans)


SCAN = "n_words long, base array<struct<first:long,last:long,label:string>>, spans array<struct<first:long,last:long,label:string,share:double>>"


def scan_licenses(docs: DataFrame, text: Column, scanner: Scanner | None = None) -> Column:
    """struct of n_words, base places and template spans (word positions from 0) of a text."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner or Scanner(PHRASES, TEMPLATES))

    @F.pandas_udf(SCAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = sent.value
        for texts in batches:
            rows = [one.scan(t) for t in texts]
            yield pd.DataFrame({
                "n_words": pd.Series([n for n, _, _ in rows], dtype="int64"),
                "base": [[dict(zip(("first", "last", "label"), x)) for x in b] for _, b, _ in rows],
                "spans": [[dict(zip(("first", "last", "label", "share"), x)) for x in s] for _, _, s in rows],
            })

    return scan(text)
