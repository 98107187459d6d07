"""License scans: matching statistics of a text against a generalised suffix automaton of licence templates.

The automaton accepts every run of words of every template, with a separator that no text has between templates.
A text is streamed through it word by word; after each word the state gives the longest run that ends there and
occurs in a template (the matching statistic); the state and its suffix links give the longest run for every place of
every template.  Matches of at least ``MIN_MATCH`` words that are maximal at their place of their template, whatever
other templates hold, are chained in template order, with gaps of at most ``MAX_GAP`` words in text and template; the
best chain's covered share of the template is the score.  A template is labelled from ``MIN_COVER`` of its words on.

The automaton is fixed in size by the templates, so it goes to every executor with the task.  Texts are one narrow
pass without a shuffle.  Runs of words that the templates don't have at all are stepped over in vector code.

Defined results: a null or empty text has no words, no labels and score 0; ties between templates go to all;
repeated documents are each scanned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .common import narrow

MIN_MATCH = 4
MAX_GAP = 8
MIN_COVER = 0.5
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"

#: The phrases of the base and their labels.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Short notices of public licences, by label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mit": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
}


def words_of(text: str) -> list[bytes]:
    w = tk.Words([text.encode()], tk.ALNUM)
    return [w.word(i) for i in range(len(w))]


class Automaton:
    """Generalised suffix automaton over word numbers; ends[state]: where in the joined templates its runs end."""

    def __init__(self, templates: dict[str, str]):
        self.labels = list(templates)
        self.bodies = [words_of(t) for t in templates.values()]
        self.vocabulary = {x: i for i, x in enumerate(sorted({x for body in self.bodies for x in body}))}
        flat = tk.Words([b" ".join(self.vocabulary)], tk.ALNUM, lower=False)
        self.codes = flat.hash
        self.code_order = np.argsort(self.codes)
        self.sorted_codes = self.codes[self.code_order]
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for t, body in enumerate(self.bodies):
            last = 0
            for i, x in enumerate(body):
                last = self._add(last, self.vocabulary[x], (t, i + 1))
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]
        self.ends = [sorted(x) for x in self.ends]
        self.numbers = [[self.vocabulary[x] for x in body] for body in self.bodies]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(x) == q:
            self.step[p][x] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, x: int, end: tuple[int, int]) -> int:
        q = self.step[last].get(x)
        if q is not None:
            state = q if self.length[q] == self.length[last] + 1 else self._split(last, q, x)
        else:
            state, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and x not in self.step[p]:
                self.step[p][x] = state
                p = self.link[p]
            if p >= 0:
                q = self.step[p][x]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, x)
        self.ends[state].add(end)
        return state

    def number(self, w: tk.Words) -> np.ndarray:
        """The number of each word in the vocabulary, or -1."""
        at = np.searchsorted(self.sorted_codes, w.hash)
        at[at == len(self.sorted_codes)] = 0
        return np.where(self.sorted_codes[at] == w.hash, self.code_order[at], -1)

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """After each word, the longest run ending there that a template holds, and its state."""
        out, state, size = [], 0, 0
        for x in words:
            while state and x not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.step[state]:
                state, size = self.step[state][x], size + 1
            out.append((size, state))
        return out

    def matches(self, words: list[int], shift: int) -> list[tuple[int, int, int, int]]:
        """(template, its first word, first word in the text, words) of the matches of MIN_MATCH words or more that
        can't be made longer at their place of their template."""
        found = []
        for i, (size, state) in enumerate(self.statistics(words)):
            after = words[i + 1] if i + 1 < len(words) else -1
            seen: set[tuple[int, int]] = set()
            while size >= MIN_MATCH:  # the linked states hold shorter runs, which end at more places
                for t, end in self.ends[state]:
                    if (t, end) not in seen:
                        seen.add((t, end))
                        body = self.numbers[t]
                        if end == len(body) or body[end] != after:
                            found.append((t, end - size, shift + i + 1 - size, size))
                state = self.link[state]
                size = self.length[state]
        return found


def chains(found: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, float]]:
    """(template, first word, end, covered share) of the best chain of each template and region of the text."""
    out = []
    for t in sorted({x[0] for x in found}):
        own = sorted((x[1:] for x in found if x[0] == t), key=lambda x: (x[1], x[0]))
        best: list[tuple[int, int]] = []  # of the chain that ends with each match: words covered, where in the text it starts
        for k, (a, b, n) in enumerate(own):
            covered, start = 0, b
            for j in range(k - 1, -1, -1):
                a2, b2, n2 = own[j]
                if b - b2 > MAX_GAP + sizes[t]:
                    break
                if 0 <= a - a2 - n2 <= MAX_GAP and 0 <= b - b2 - n2 <= MAX_GAP and (best[j][0], -best[j][1]) > (covered, -start):
                    covered, start = best[j]
            best.append((covered + n, start))
        ends: dict[int, tuple[int, int]] = {}  # by start: words covered, end in the text
        for (_, b, n), (covered, start) in zip(own, best, strict=True):
            if covered > ends.get(start, (0, 0))[0]:
                ends[start] = covered, b + n
        good = sorted((start, end, covered) for start, (covered, end) in ends.items() if covered >= MIN_COVER * sizes[t])
        kept: list[tuple[int, int, int]] = []
        for start, end, covered in good:  # of chains that overlap in the text, the one that covers most
            if kept and start < kept[-1][1]:
                if covered > kept[-1][2]:
                    kept[-1] = start, end, covered
            else:
                kept.append((start, end, covered))
        out += [(t, start, end, covered / sizes[t]) for start, end, covered in kept]
    return out


def _scanned(auto: Automaton, phrases: dict[str, list[int]]):
    sizes = [len(b) for b in auto.bodies]

    def one(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        w = tk.Words(texts, tk.ALNUM)
        number = auto.number(w)
        place: dict[int, list[int]] = {}
        base: dict[int, set[str]] = {}
        for label, phrase in phrases.items():
            fits = np.flatnonzero(w.run_fits(len(phrase)))
            for j, x in enumerate(phrase):
                fits = fits[number[fits + j] == x]
            for d, i in zip((np.searchsorted(w.first, fits, "right") - 1).tolist(), fits.tolist(), strict=True):
                place.setdefault(d, []).append(i - int(w.first[d]))
                base.setdefault(d, set()).add(label)
        spans: dict[int, list[tuple[int, int, int, float]]] = {}
        known = np.concatenate(([False], number >= 0, [False]))
        cut = np.zeros(len(known) + 1, bool)
        cut[w.first + 1] = True  # a run ends where a text ends
        known_here, before = known[1:-1], known[:-2] & ~cut[1 : len(known) - 1]
        begin = np.flatnonzero(known_here & ~before)
        after = known[2:] & ~cut[2 : len(known)]
        stop = np.flatnonzero(known_here & ~after) + 1
        long = stop - begin >= MIN_MATCH
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for a, b in zip(begin[long].tolist(), stop[long].tolist(), strict=True):
            d = int(np.searchsorted(w.first, a, "right")) - 1
            found.setdefault(d, []).extend(auto.matches(number[a:b].tolist(), a - int(w.first[d])))
        for d, x in found.items():
            if got := chains(x, sizes):
                spans[d] = got
        out: list[list] = [[] for _ in range(7)]
        for d in range(len(texts)):
            p, got = place.get(d, []), spans.get(d, [])
            labels = base.get(d, set()) | {auto.labels[x[0]] for x in got}
            values = (len(p), min(p, default=None), max(p, default=None), ",".join(sorted(base.get(d, ()))), ",".join(sorted(labels)), min(1.0, max((x[3] for x in got), default=0.0)), ",".join(f"{auto.labels[t]}:{a}:{b}" for t, a, b, _ in sorted(got, key=lambda x: (x[1], x[0]))))
            for column, v in zip(out, values, strict=True):
                column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(w.counts.astype(np.int64)), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tk.by_parts(batches, "text", one)

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base phrases with their places, labels, the best covered share and the spans found."""
    auto = Automaton(TEMPLATES if templates is None else templates)
    for phrase in PHRASES.values():
        for x in words_of(phrase):
            if x not in auto.vocabulary:
                auto.vocabulary[x] = len(auto.vocabulary)
    flat = tk.Words([b" ".join(auto.vocabulary)], tk.ALNUM, lower=False)
    auto.code_order = np.argsort(flat.hash)
    auto.sorted_codes = flat.hash[auto.code_order]
    phrases = {label: [auto.vocabulary[x] for x in words_of(p)] for label, p in PHRASES.items()}
    return narrow(docs, id_col, text_col).mapInArrow(_scanned(auto, phrases), SCHEMA)
