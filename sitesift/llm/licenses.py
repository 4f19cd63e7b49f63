"""Licence scans by a generalised suffix automaton of licence tokens.

One automaton holds every template. A text is streamed through it word by word, which gives at each
word the longest run ending there that occurs in some template (matching statistics).
Maximal runs are chained per template, in text and template order with small
gaps, and a chain that covers enough of its template is a labelled span.

Defined cases: a null or empty text has no words, no labels and score 0; texts are streamed
whole; overlapping templates may label the same words; rows are independent.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public licence notices, label and text.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all "
     "copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
     "in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
     "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
     "PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: Redistributions of source code must retain the above "
     "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
     "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
     "copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to "
     "copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
     "a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Shortest run that enters a chain, most words between two runs, share of a template for its label.
LEAST_RUN, MOST_GAP, LEAST_COVER = 4, 30, 0.6

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


@dataclass
class Automaton:
    """Suffix automaton of several token sequences; state 0 is the root."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(dict(step))
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, state: int, token: int) -> int:
        """The target of ``token`` from ``state`` whose longest string is one token longer."""
        target = self.step[state][token]
        if self.length[target] == self.length[state] + 1:
            return target
        twin = self._state(self.length[state] + 1, self.link[target], self.step[target])
        self.link[target] = twin
        while state >= 0 and self.step[state].get(token) == target:
            self.step[state][token] = twin
            state = self.link[state]
        return twin

    def add(self, number: int, sequence: list[int]) -> None:
        last = 0
        for place, token in enumerate(sequence):
            if token in self.step[last]:
                last = self._split(last, token)
            else:
                fresh = self._state(self.length[last] + 1, 0, {})
                state = last
                while state >= 0 and token not in self.step[state]:
                    self.step[state][token] = fresh
                    state = self.link[state]
                if state >= 0:
                    self.link[fresh] = self._split(state, token)
                last = fresh
            self.ends[last].add((number, place + 1))

    def finish(self) -> None:
        """Every state gets all the places where its strings end."""
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def runs(self, sequence: list[int], offset: int, least: int) -> list[tuple[int, int, int, int]]:
        """Maximal runs of ``least`` tokens or more as (start, length, template, template start)."""
        out, state, size, before = [], 0, 0, (0, 0)
        for place, token in enumerate([*sequence, -1]):
            before = (state, size)
            while state > 0 and token not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.step[state]:
                state, size = self.step[state][token], size + 1
            if before[1] >= least and size <= before[1]:
                out.extend((offset + place - before[1], before[1], number, end - before[1])
                           for number, end in self.ends[before[0]])
        return out


@functools.cache
def library(templates: tuple[tuple[str, str], ...]) -> tuple[Automaton, dict[bytes, int], list[int]]:
    machine, words, sizes = Automaton(), {}, []
    for number, (_, text) in enumerate(templates):
        sequence = [words.setdefault(w, len(words)) for w in tokens(text)]
        machine.add(number, sequence)
        sizes.append(len(sequence))
    machine.finish()
    return machine, words, sizes


def chains(runs: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first word, end word, covered template words) of the chains of one template, best first runs joined.

    A run joins the best chain that ends before it in text and template within ``gap`` words.
    """
    runs = sorted(runs)
    best: list[tuple[int, int]] = []  # covered words, run before
    low = 0
    for i, (at, size, _, place) in enumerate(runs):
        while runs[low][0] + runs[low][1] + gap < at and low < i:
            low += 1
        gain = [(best[j][0], j) for j in range(low, i)
                if runs[j][0] + runs[j][1] <= at <= runs[j][0] + runs[j][1] + gap and runs[j][3] + runs[j][1] <= place]
        covered, j = max(gain, default=(0, -1))
        best.append((covered + size, j))
    out, used = [], set()
    for i in sorted(range(len(runs)), key=lambda i: (-best[i][0], i)):
        if i in used:
            continue
        first, taken = i, True
        while True:
            used.add(first)
            if best[first][1] < 0:
                break
            if best[first][1] in used:
                taken = False
                break
            first = best[first][1]
        if taken:
            out.append((runs[first][0], runs[i][0] + runs[i][1], best[i][0]))
    return out


def scan_text(text: str | None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> dict:
    """Words, base places and template spans of one text."""
    words = tokens(text)
    machine, known, sizes = library(templates)
    places, base = [], set()
    lowered = text.encode("utf-8", "surrogatepass").lower() if text else b""
    if b"license" in lowered:
        for at, word in enumerate(words):
            if word == b"license":
                for phrase, label in PHRASES.items():
                    want = phrase.encode().split()
                    if at >= len(want) - 1 and words[at - len(want) + 1: at + 1] == want:
                        places.append(at - len(want) + 1)
                        base.add(label)
    ids = [known.get(w, -1) for w in words]
    at = np.array([-1, *ids, -1])
    inside = at >= 0
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    runs: list[tuple[int, int, int, int]] = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        if end - start >= LEAST_RUN:
            runs.extend(machine.runs(ids[start:end], start, LEAST_RUN))
    spans, score = [], 0.0
    for number in sorted({r[2] for r in runs}):
        for first, end, covered in chains([r for r in runs if r[2] == number], MOST_GAP):
            share = min(1.0, covered / sizes[number])
            score = max(score, share)
            if share >= LEAST_COVER:
                spans.append({"label": templates[number][0], "first_word": first, "end_word": end, "cover": share})
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None),
            "last_word": max(places, default=None), "base_labels": sorted(base), "spans": spans, "score": score}


SCAN_TYPE = ("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:array<string>,"
             "spans:array<struct<label:string,first_word:bigint,end_word:bigint,cover:double>>,score:double>")
SCAN_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([
        ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))),
    ("score", pa.float64())])


def scan(text: Column | str, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """Struct of SCAN_TYPE for a text column."""

    @F.arrow_udf(SCAN_TYPE)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([scan_text(t.as_py(), templates) for t in texts], type=SCAN_ARROW)

    return found(text)


def licence_digest(documents: DataFrame) -> DataFrame:
    found = documents.select("doc_id", scan("text").alias("s")).select("doc_id", "s.*")
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", "spans.label")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join(labels, ",").alias("labels"), "score")
