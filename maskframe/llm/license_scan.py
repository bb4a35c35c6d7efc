"""License scans: a generalised suffix automaton of licence tokens streams over a text's words.

The automaton gives matching statistics: at each word the longest stretch ending there that occurs in some template. Long
stretches are chained along a template, across short gaps, into spans; a span that covers enough of it carries its label.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, slices

#: The phrases of the base and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages by which licences are known, from their public texts, several a label.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
]
#: Words of a match that count; words of text between matches of one chain; share of a template that carries its label.
LEAST, GAP, COVER = 3, 6, 0.8
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Words of lower-cased text: digits, a-z and every character beyond ASCII."""
    return raw.translate(_WORDS).split()


class Automaton:
    """Generalised suffix automaton over token sequences; each state knows the templates it occurs in and where first."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]  # template -> index of the last token of its first occurrence
        for t, seq in enumerate(sequences):
            last = 0
            for c in seq:
                last = self._extend(last, c)
        for t, seq in enumerate(sequences):
            at = 0
            for i, c in enumerate(seq):
                at = self.next[at][c]
                s = at
                while s > 0 and t not in self.ends[s]:
                    self.ends[s][t] = i
                    s = self.link[s]

    def _state(self, length: int, link: int, out: dict[int, int]) -> int:
        self.len.append(length), self.link.append(link), self.next.append(out), self.ends.append({})
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # another sequence has been here
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
        cur, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return cur

    def matches(self, tokens: list[int], start: int) -> list[tuple[int, int, int]]:
        """(first word, length, state) of the longest matches that can't be extended to the right."""
        out, s, n = [], 0, 0
        for i, c in enumerate(tokens):
            if c not in self.next[s] and n >= LEAST:
                out.append((start + i - n, n, s))
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.len[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
        if n >= LEAST:
            out.append((start + len(tokens) - n, n, s))
        return out


class Scanner:
    def __init__(self) -> None:
        self.vocab: dict[bytes, int] = {}
        number = lambda w: self.vocab.setdefault(w, len(self.vocab))
        self.sizes, self.names, sequences = [], [], []
        for name, text in TEMPLATES:
            seq = [number(w) for w in words_of(text.encode())]
            sequences.append(seq), self.sizes.append(len(seq)), self.names.append(name)
        self.phrases = [([number(w) for w in p.encode().split()], label) for p, label in BASE.items()]
        self.automaton = Automaton(sequences)

    def chains(self, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template) of the spans that matches chain into."""
        open_: dict[int, list] = {}
        done: list[tuple[int, list]] = []
        for start, n, state in found:
            for t, end in self.automaton.ends[state].items():
                at = end - n + 1
                c = open_.get(t)
                if c and start - c[1] <= GAP and at >= c[2] and at - c[2] <= GAP:
                    c[1], c[2], c[3] = start + n, end + 1, c[3] + n
                else:
                    if c:
                        done.append((t, c))
                    open_[t] = [start, start + n, end + 1, n]
        done += open_.items()
        return [(self.names[t], c[0], c[1], min(1.0, c[3] / self.sizes[t])) for t, c in done]

    def scan(self, raw: bytes) -> tuple:
        words = words_of(raw)
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))
        base, starts = set(), []
        for phrase, label in self.phrases:
            hit = np.ones(max(0, len(ids) - len(phrase) + 1), bool)
            for k, p in enumerate(phrase):
                hit &= ids[k : k + len(hit)] == p
            if hit.any():
                base.add(label)
                starts.append(np.flatnonzero(hit))
        known = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
        found = []
        for a, z in zip(known[::2].tolist(), known[1::2].tolist()):
            if z - a >= LEAST:
                found += self.automaton.matches(ids[a:z].tolist(), a)
        spans = [s for s in self.chains(found) if s[3] >= COVER]
        every = np.concatenate(starts) if starts else None
        score = max([s[3] for s in spans] + [0.5 * bool(base)])
        return len(words), 0 if every is None else len(every), None if every is None else int(every.min()), None if every is None else int(every.max()), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), score, spans


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``spans`` lists (label, first word, end, share of the template). Null and empty texts have no words, empty labels and
    score 0; repeated rows are scanned each; an empty table gives none; other columns are ignored.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in slices(batches, "_t"):
            got = list(zip(*map(s.scan, bytes_of(b.column("_t"))))) or [[]] * 8
            spans = pa.array([[dict(zip(("label", "first_word", "end_word", "share"), x)) for x in one] for one in got[7]], span)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(got, kinds)), spans], names=names)

    kind = docs.select(F.col(key)).dtypes[0][1]
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,share:double>>"
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t")).mapInArrow(run, schema)
