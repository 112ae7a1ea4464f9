"""Licence scans: matching statistics over a generalised suffix automaton of licence words, chained into covered spans."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import carry

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Characters of a text that are cut into words at once.
PIECE = 1 << 20

# Phrases that name a licence, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices and grants of public licences, by their usual short names.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "gpl-2.0": (
        "either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "lgpl": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def words(text: str) -> Iterator[list[str]]:
    """The words of a lower-cased text, piece by piece: a piece ends where no word does not."""
    at = 0
    while len(text) - at > PIECE:
        end = _BREAK.search(text, at + PIECE)
        if end is None:
            break
        yield WORD.findall(text, at, end.start())
        at = end.start()
    yield WORD.findall(text, at) if at else WORD.findall(text)


class Automaton:
    """A generalised suffix automaton of word sequences.

    ends[s]: (sequence, place after its last word) of every occurrence of the state's strings; whole[s]: sequences
    flagged as phrases that, whole, end a string of the state, longest first.
    """

    def __init__(self, sequences: Sequence[Sequence[str]], phrases: Sequence[bool]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.sequences = sequences
        for sequence in sequences:
            last = 0
            for w in sequence:
                last = self._extended(last, w)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        own: list[list[int]] = [[] for _ in self.next]
        for i, sequence in enumerate(sequences):
            s = 0
            for at, w in enumerate(sequence, 1):
                s = t = self.next[s][w]
                while t > 0:
                    self.ends[t].append((i, at))
                    t = self.link[t]
            if phrases[i] and sequence:
                own[s].append(i)
        self.whole: list[list[int]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.whole[s] = own[s] + self.whole[self.link[s]]

    def _state(self, edges: dict[str, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: str) -> int:
        """The state after p and w that holds no string longer than p's longest and w."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extended(self, last: int, w: str) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        state = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w)
        return state


class Chains:
    """Matches of one text chained by sequence: later in text and sequence, at most gap words apart in both."""

    def __init__(self, sequences: Sequence[Sequence[str]], gap: int):
        self.sequences, self.gap = sequences, gap
        self.open: dict[int, list[list[int]]] = {}
        self.best: dict[int, float] = {}
        self.spans: list[tuple[int, int, int, int]] = []

    def match(self, end: int, size: int, ends: Sequence[tuple[int, int]]) -> None:
        """Words end - size to end of the text are those before each of the ends."""
        for i, at in ends:
            kept, grown = [], [end - size, end, at, size]
            for chain in self.open.get(i, ()):
                if end - size - chain[1] > self.gap:
                    self._closed(i, chain)
                    continue
                kept.append(chain)
                new = min(size, end - chain[1], at - chain[2])  # words beyond both of the chain's ends
                if new > 0 and at - new - chain[2] <= self.gap and chain[3] + new > grown[3]:
                    grown = [chain[0], end, at, chain[3] + new]
            # one chain an end in the sequence: the one that covers most, then the later one
            kept = [c for c in kept if c[2] != at or c[3] > grown[3]]
            if all(c[2] != at for c in kept):
                kept.append(grown)
            self.open[i] = kept

    def _closed(self, i: int, chain: list[int]) -> None:
        self.spans.append((i, chain[0], chain[1], chain[3]))

    def done(self) -> list[tuple[int, int, int, int]]:
        """(sequence, first word, word after the last, words covered) of all chains."""
        for i, chains in self.open.items():
            for chain in chains:
                self._closed(i, chain)
        self.open.clear()
        return self.spans


def scanner(templates: Mapping[str, Sequence[str]], phrases: Mapping[str, str], least_match: int, gap: int, share: float):
    """A function from a lower-cased text to its digest; the automaton is built once and bounded by the templates."""
    labels, sequences, flags = [], [], []
    for phrase, label in phrases.items():
        labels.append(label)
        sequences.append(WORD.findall(phrase.lower()))
        flags.append(True)
    for label, texts in templates.items():
        for t in texts:
            labels.append(label)
            sequences.append(WORD.findall(t.lower()))
            flags.append(False)
    machine = Automaton(sequences, flags)
    step, link, length, ends, whole = machine.next, machine.link, machine.length, machine.ends, machine.whole
    root = step[0]
    sizes = [len(s) for s in sequences]

    def scan(text: str) -> dict:
        n = at = state = size = n_base = 0
        first = last = None
        named: set[str] = set()
        chains = Chains(sequences, gap)
        for piece in words(text):
            n += len(piece)
            for w in piece:
                at += 1
                if not state:
                    if w not in root:
                        continue
                    state, size = root[w], 1
                else:
                    went = step[state].get(w)
                    if went is None:
                        if size >= least_match:
                            chains.match(at - 1, size, ends[state])
                        while state and went is None:
                            state = link[state]
                            went = step[state].get(w)
                        if went is None:
                            state = size = 0
                            continue
                        size = length[state]
                    state, size = went, size + 1
                for i in whole[state]:
                    k = sizes[i]
                    if k <= size:
                        n_base += 1
                        start = at - k
                        first = start if first is None else min(first, start)
                        last = start if last is None else max(last, start)
                        named.add(labels[i])
        if size >= least_match:
            chains.match(at, size, ends[state])
        score, kept = (1.0 if n_base else 0.0), {}
        for i, start, end, covered in chains.done():
            part = covered / sizes[i]
            score = max(score, part)
            if part >= share and not flags[i]:
                key = (labels[i], start)
                kept[key] = max(kept.get(key, (0.0, 0, 0)), (part, end, covered))
        spans = [{"label": k[0], "first_word": k[1], "last_word": v[1] - 1, "covered": v[2], "share": v[0]} for k, v in sorted(kept.items(), key=lambda x: (x[0][1], x[0][0]))]
        own = sorted(named)
        return {
            "n_words": n, "n_base": n_base, "first_word": first, "last_word": last, "base_labels": ",".join(own),
            "labels": ",".join(sorted(named | {s["label"] for s in spans})), "score": score, "spans": spans,
        }

    return scan


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
_DIGEST = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN)),
])
_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, covered: long, share: double>>"
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def scanned(text: Column, templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, least_match: int = 3, gap: int = 8, share: float = 0.8) -> Column:
    """struct of a text's digest, see scan."""

    @F.arrow_udf(_SCHEMA)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = scanner(templates, phrases, least_match, gap, share)
        for batch in batches:
            yield pa.array([scan(x.as_py() or "") for x in batch], _DIGEST)

    return digest(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def scan(docs: DataFrame, **parameters) -> DataFrame:
    """Add to docs (text, ...) n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Each whole text is read word by word, a million characters at a time. The automaton holds, at every word, the longest
    end of what was read that stands in some template. Where such a match of least_match words or more ends, it is chained
    with those before it that come earlier in the same template, at most gap words away in text and template. A chain
    that covers share of a template is a span, with its label. Phrases are found at the same states: all places count
    (n_base), their least and greatest first words, their labels. labels are those of phrases and spans. score is the largest
    share of a template or phrase that one chain covers. Words are numbered from 0.

    Null and empty texts have no words, no labels ('') and score 0. Repeated rows are scanned each. No shuffle; memory is
    bounded by a batch of texts, a text's open chains and the templates. An added column takes the place of an input
    column of its name; other columns are carried whatever their names.
    """
    rows = carry.packed(docs, ["text"]).withColumn("_d", scanned(F.col("text"), **parameters))
    rows = rows.select("*", *[F.col(f"_d.{c}").alias(c) for c in ADDED])
    return carry.unpacked(rows, docs, ["text"], ADDED)
