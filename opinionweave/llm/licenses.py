"""Licence scan: matching statistics of documents in a suffix automaton of licence tokens.

One generalised suffix automaton holds every template and phrase. A document's words are streamed through it;
after each word the state and length say what is the longest licence fragment that ends there. Fragments that
cannot be made longer and have ``min_match`` words or more are placed in their templates and chained, in order in
both document and template, into spans; a template whose span covers ``min_cover`` of its words gives its label.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS_ONLY, text_bytes

# Phrases and labels that the result must have.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# Notices of public licences, as words.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
)

COLUMNS = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first:bigint,last:bigint,cover:double>>"
)


class Automaton:
    """Generalised suffix automaton over word numbers, with the places of each state in each text."""

    def __init__(self, texts: list[list[int]]):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [defaultdict(set)]
        for t, words in enumerate(texts):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last][t].add(at)
        for v in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):  # shorter suffixes end there too
            for t, where in self.ends[v].items():
                self.ends[self.link[v]][t] |= where

    def _state(self, length: int, link: int, steps: dict) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(defaultdict(set))
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of exactly the longest suffix that ends at p followed by w."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new


class Scanner:
    def __init__(self, templates, phrases, min_match: int, min_cover: float, max_gap: int):
        texts = [t.encode().split() for t, _ in (*phrases, *templates)]
        self.labels = [label for _, label in (*phrases, *templates)]
        self.lengths = [len(t) for t in texts]
        self.n_phrases = len(phrases)
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.machine = Automaton([[self.number[w] for w in t] for t in texts])
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        # phrases that end in a state when the match is at least as long as they are
        self.whole = [
            [(self.lengths[t], t) for t, where in ends.items() if t < self.n_phrases and self.lengths[t] - 1 in where]
            for ends in self.machine.ends
        ]
        # a longer match ends in all phrases that its suffixes end in
        for s in sorted(range(1, len(self.whole)), key=self.machine.length.__getitem__):
            shorter = self.machine.link[s]
            self.whole[s] += [x for x in self.whole[shorter] if x[0] <= self.machine.length[shorter] and x not in self.whole[s]]

    def statistics(self, words: list[bytes]):
        """(word number, state, length) wherever two or more words match."""
        steps, link, size = self.machine.next, self.machine.link, self.machine.length
        state = length = 0
        for i, w in enumerate(map(self.number.get, words)):
            if w is None:
                state = length = 0
                continue
            while w not in steps[state]:
                state = link[state]
                length = size[state]
            state, length = steps[state][w], length + 1
            if length > 1:
                yield i, state, length

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Best chain per template and place: fragments in order in both, with gaps of max_gap words at most."""
        per: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, state, length in matches:
            for t, where in self.machine.ends[state].items():
                if t >= self.n_phrases:
                    per[t] += [(end, at, length) for at in sorted(where)]
        out = []
        for t, found in per.items():
            best: list[tuple[int, int, int]] = []  # words covered, first document word, template words reached
            for k, (end, at, length) in enumerate(found):
                mine = (length, end - length + 1)
                for j in range(k - 1, -1, -1):
                    e, a, _ = found[j]
                    if end - length - e > self.max_gap:
                        break
                    fresh = min(length, end - e, at - a)
                    if e < end and a < at and fresh > 0 and best[j][0] + fresh > mine[0]:
                        mine = (best[j][0] + fresh, best[j][1])
                best.append((*mine, end))
            top: dict[int, tuple[int, int, int]] = {}
            for covered, first, last in best:
                if covered > top.get(first, (0,))[0]:
                    top[first] = (covered, first, last)
            for covered, first, last in top.values():
                if covered >= self.min_cover * self.lengths[t]:
                    out.append((self.labels[t], first, last, min(1.0, covered / self.lengths[t])))
        return sorted(set(out))

    def scan(self, text: bytes) -> tuple:
        words = text.translate(WORDS_ONLY).split()
        starts, base, long, before = [], set(), [], None
        for i, state, length in self.statistics(words):
            for n, t in self.whole[state]:
                if length >= n:
                    starts.append(i - n + 1)
                    base.add(self.labels[t])
            if before and before[2] >= self.min_match and (before[0] + 1 != i or before[2] + 1 != length):
                long.append(before)
            before = (i, state, length)
        if before and before[2] >= self.min_match:
            long.append(before)
        spans = self.spans(long)
        score = 1.0 if base else max((s[3] for s in spans), default=0.0)
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {s[0] for s in spans})), score,
            [dict(zip(("label", "first", "last", "cover"), s, strict=True)) for s in spans],
        )


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES,
    min_match: int = 3, min_cover: float = 0.6, max_gap: int = 12,
) -> DataFrame:
    """Licence phrases and covered template spans of every text.

    One row per input row, repeated rows included, with the id and the columns of ``COLUMNS``; other columns are
    not read, so their names cannot clash. Null and empty texts have no words, no places, null first and last word,
    empty labels and score 0. The whole text is streamed, whatever its length; an empty table gives no rows. The
    templates are fixed values of this module or the caller's and go to the tasks; no data is shuffled.
    """
    kind = docs.schema[id_col].dataType
    names = [c.strip().split(" ")[0] for c in COLUMNS.split(", ")][:7] + ["spans"]
    given = (tuple(templates), tuple(phrases), min_match, min_cover, max_gap)

    def run(batches):
        scanner = Scanner(*given)
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
                [("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, types, strict=True))], [id_col, *names]
            )

    slim = docs.select(F.col(id_col), text_bytes(text_col).alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {COLUMNS}")
