"""License scans: a generalised suffix automaton of licence tokens.

All phrases and templates are read into one suffix automaton over words.
Streaming a text through it gives its matching statistics: for each place, the
longest stretch of words ending there that stands in some template.  Stretches
that can't be made longer to the right are the maximal matches; those of
``ANCHOR`` words and more are chained, template by template, in the order of
the template with bounded gaps, and a chain that covers ``SHARE`` of its
template is a span of that licence.

Words that no template has reset the automaton, so only runs of known words
are walked, one transition a word.  The phrases of the base are found in the
same walk: a phrase ends wherever the matched stretch is as long as it and the
state is one that its last word leads to.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_batches
from ._text import ALNUM, LOWER, slices, text_buffers, word_hashes, words

#: Fixed phrases and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Fixed texts: opening statements of widely used licences, and the one-line notices that name them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Words of the shortest match that is chained, words of text or template between two matches of a chain, and the share of a template that a chain must cover.
ANCHOR, GAP, SHARE = 3, 8, 0.6


def tokens(text: str) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return "".join(c if not c.isascii() or c.isalnum() else " " for c in low).split()


class SuffixAutomaton:
    """All stretches of several word sequences; a state knows the sequences and places where its stretches end."""

    def __init__(self, sequences: list[list[str]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, seq in enumerate(sequences):
            last = 0
            for place, w in enumerate(seq):
                last = self._extend(last, w)
                self.ends[last].add((number, place))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, link: int, nxt: dict[str, int]) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: str) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: str) -> int:
        if w in self.next[last]:  # known from an earlier sequence
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def step(self, state: int, length: int, w: str) -> tuple[int, int]:
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], length + 1
        return 0, 0


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES) -> None:
        sequences = [tokens(t) for t, _ in phrases] + [tokens(t) for _, t in templates]
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        self.sizes = [len(s) for s in sequences]
        self.base = len(phrases)
        self.automaton = SuffixAutomaton(sequences)
        #: The phrases that end in each state, by length.
        self.final = [[(self.sizes[n], n) for n, place in ends if n < self.base and place == self.sizes[n] - 1] for ends in self.automaton.ends]
        self.vocabulary = {w for s in sequences for w in s}
        raw = [w.encode() for w in sorted(self.vocabulary)]
        ends = np.cumsum([len(w) for w in raw])
        self.hashes = np.sort(word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))

    def run(self, run: list[str], first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrases (start, number) and maximal matches (end, length, state) of a run of words that begins at word ``first``."""
        a, state, length = self.automaton, 0, 0
        places, matches = [], []
        for i, w in enumerate(run):
            before = (state, length)
            state, length = a.step(state, length, w)
            if before[1] >= ANCHOR and length != before[1] + 1:
                matches.append((first + i - 1, before[1], before[0]))
            s = state  # phrases may end in shorter stretches too
            while s > 0:
                for size, n in self.final[s]:
                    if a.length[a.link[s]] < size <= min(length, a.length[s]):
                        places.append((first + i - size + 1, n))
                s = a.link[s]
        if length >= ANCHOR:
            matches.append((first + len(run) - 1, length, state))
        return places, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, share covered) of the chains that cover enough of a template."""
        open_: dict[int, list] = {}
        out = []

        def close(n: int) -> None:
            first, last, at, covered = open_.pop(n)
            if covered >= SHARE * self.sizes[n]:
                out.append((n, first, last, min(1.0, covered / self.sizes[n])))

        for end, length, state in matches:
            for n, place in sorted(self.automaton.ends[state]):
                if n < self.base:
                    continue
                start, begin = end - length + 1, place - length + 1
                c = open_.get(n)
                if c is not None:
                    over = max(0, c[1] - start + 1, c[2] - begin + 1)
                    if place > c[2] and end > c[1] and over < length and start - c[1] - 1 <= GAP and begin - c[2] - 1 <= GAP:
                        c[1], c[2] = end, place
                        c[3] += length - over
                        continue
                    if c[3] >= length and start - c[1] - 1 <= GAP:
                        continue
                    close(n)
                open_[n] = [start, end, place, length]
        for n in list(open_):
            close(n)
        return out


@functools.cache
def scanner() -> Scanner:
    return Scanner()


def _scan(batches):
    s = scanner()
    for b in batches:
        n_words = np.zeros(b.num_rows, np.int64)
        found: dict[int, tuple[list, list]] = {}
        for i, j in slices(text_buffers(b.column(1))[1]):
            data, offs = text_buffers(b.column(1).slice(i, j - i))
            data = LOWER[data]
            starts, ends, doc = words(data, offs, ALNUM)
            n_words[i:j] = np.bincount(doc, minlength=j - i)
            if not len(starts):
                continue
            h = word_hashes(data, starts, ends)
            at = np.minimum(np.searchsorted(s.hashes, h), len(s.hashes) - 1)
            known = s.hashes[at] == h
            # Runs of at least two known words of one text.
            idx = np.flatnonzero(known)
            if not len(idx):
                continue
            new = np.ones(len(idx), bool)
            new[1:] = (idx[1:] != idx[:-1] + 1) | (doc[idx[1:]] != doc[idx[:-1]])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(idx)))
            first_word = np.searchsorted(doc, np.arange(j - i))
            raw = data.tobytes()
            for x, n in zip(idx[begin[size > 1]].tolist(), size[size > 1].tolist(), strict=True):
                d = int(doc[x])
                run = [raw[starts[x + y] : ends[x + y]].decode() for y in range(n)]
                places, matches = s.run(run, x - int(first_word[d]))
                if places or matches:
                    own = found.setdefault(i + d, ([], []))
                    own[0].extend(places)
                    own[1].extend(matches)
        cols: list[list] = [[], [], [], [], [], [], []]
        for d in range(b.num_rows):
            places, matches = found.get(d, ((), ()))
            chains = s.chains(list(matches)) if matches else []
            base = {s.labels[n] for _, n in places}
            at = [p for p, _ in places]
            best = max([1.0 * bool(places), *(c[3] for c in chains)])
            for c, v in zip(cols, (len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s.labels[c[0]] for c in chains})), float(best), ",".join(f"{s.labels[n]}:{f}:{e + 1}" for n, f, e, _ in sorted(chains, key=lambda c: c[1:3]))), strict=True):
                c.append(v)
        arrays = [b.column(0), pa.array(n_words), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()), strict=True))]
        yield pa.record_batch(arrays, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def license_scan(documents: DataFrame) -> DataFrame:
    """Find licence phrases and templates in every text.

    Takes columns doc_id and text, whatever else there is; a row for each row.
    n_words; n_base, first_word and last_word (places of base phrases, words
    counted from 0, null where there are none); base_labels and labels
    (distinct, sorted, comma-joined; labels also has the templates found);
    score (1 for a base phrase, else the largest share of a template covered);
    spans (label:first:end of each template found, in words).  A null or empty
    text has no words and no labels.
    """
    rows = in_batches(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(_scan, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string")
