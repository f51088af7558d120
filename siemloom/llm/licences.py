"""Licence scan by a generalised suffix automaton of licence tokens.

The automaton accepts every run of words that occurs in a template. A text's words are streamed through it; at each word it gives the
longest run ending there that some template holds (the matching statistics). Runs that can't grow are the maximal matches. Those of at least LONG
words are chained by template, in rising order of both places, into covered spans; a template is found where a chain covers enough of it. A base
phrase is found wherever the automaton's longest run ends with the whole phrase.

Words are runs of digits, A-Z in lower case, a-z and bytes outside ASCII. Null and empty texts have no words. Rows are kept as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemloom.llm.words import NON_ALNUM, Words, pieces, small_batches

# Phrases of which every place is reported, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Passages of public licence texts, with their labels.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
           "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
           "distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
                "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
           "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
           "the above copyright notice and this permission notice appear in all copies",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
           "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
             "this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "all-rights": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}
#: Fewest words of a match that counts towards a chain, share of a template that a chain must cover, most foreign words between two matches.
LONG, COVER, GAP = 4, 0.7, 20


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), NON_ALNUM, lower=True).hashes


class SuffixAutomaton:
    """Of several token sequences; end[state] gives, by sequence, where the first occurrence of the state's runs ends."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.end: list[dict[int, int]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                state = last
                while state > 0 and k not in self.end[state]:
                    self.end[state][k] = place
                    state = self.link[state]

    def _state(self, size: int, edges: dict[int, int], link: int, ends: dict[int, int]) -> int:
        self.next.append(dict(edges))
        self.link.append(link)
        self.size.append(size)
        self.end.append(dict(ends))
        return len(self.size) - 1

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None and self.size[known] == self.size[last] + 1:
            return known
        new = None if known is not None else self._state(self.size[last] + 1, {}, 0, {})
        state = last
        if new is not None:
            while state >= 0 and token not in self.next[state]:
                self.next[state][token] = new
                state = self.link[state]
        if state >= 0:
            target = self.next[state][token]
            if self.size[target] != self.size[state] + 1:
                copy = self._state(self.size[state] + 1, self.next[target], self.link[target], self.end[target])
                self.link[target] = copy
                while state >= 0 and self.next[state].get(token) == target:
                    self.next[state][token] = copy
                    state = self.link[state]
                target = copy
            if new is None:
                return target
            self.link[new] = target
        return new


class Scanner:
    def __init__(self, base: dict[str, str], templates: dict[str, str]) -> None:
        texts = [*base, *templates.values()]
        self.labels = [*base.values(), *templates]
        hashes = [word_hashes(t) for t in texts]
        self.vocabulary = np.unique(np.concatenate(hashes))
        tokens = [np.searchsorted(self.vocabulary, h).tolist() for h in hashes]
        self.length = [len(t) for t in tokens]
        self.n_base = len(base)
        self.least = min(self.length)
        self.automaton = SuffixAutomaton(tokens)
        #: Base phrases that end at a state's runs, if these are long enough.
        self.phrases: dict[int, list[int]] = defaultdict(list)
        for k in range(self.n_base):
            state = 0
            for token in tokens[k]:
                state = self.automaton.next[state][token]
            self.phrases[state].append(k)

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words in the templates' vocabulary, else -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def scan(self, run: list[int], start: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Of a run of words of the vocabulary: (first word, phrase) of each place, and (first word, words, template, its place) of matches."""
        a, places, matches, state, size = self.automaton, [], [], 0, 0
        for i, token in enumerate([*run, -1]):
            before, length = state, size
            while state and token not in a.next[state]:
                state = a.link[state]
                size = a.size[state]
            if token in a.next[state]:
                state, size = a.next[state][token], size + 1
            else:
                state, size = 0, 0
            if length >= LONG and size <= length:  # it could not grow
                first = start + i - length
                matches += [(first, length, k, e - length + 1) for k, e in a.end[before].items() if k >= self.n_base]
            up = state
            while up > 0:
                for k in self.phrases.get(up, ()):
                    if self.length[k] <= size:
                        places.append((start + i + 1 - self.length[k], k))
                up = a.link[up]
        return places, matches

    def chains(self, matches: list[tuple[int, int, int, int]]) -> tuple[dict[int, float], list[tuple[int, int, int]]]:
        """Covered share by template, and the spans (first word, word after the last, template) that cover enough."""
        share: dict[int, float] = {}
        spans = []
        by: dict[int, list] = defaultdict(list)
        for m in sorted(matches):
            by[m[2]].append(m)
        for k, own in by.items():
            chains: list[list[int]] = []  # first word, word after, place after in the template, words covered
            for first, size, _, place in own:
                best = max((c for c in chains if c[1] - size < first <= c[1] + GAP and c[2] - size < place), key=lambda c: c[3], default=None)
                if best is None:
                    chains.append([first, first + size, place + size, size])
                else:
                    new = min(size, first + size - best[1], place + size - best[2])
                    best[1], best[2], best[3] = first + size, place + size, best[3] + max(0, new)
                chains = [c for c in chains if c[1] + GAP >= first or c[3] >= COVER * self.length[k]] or chains[-1:]
                top = max(c[3] for c in chains) / self.length[k]
                share[k] = max(share.get(k, 0.0), min(1.0, top))
            spans += [(c[0], c[1], k) for c in chains if c[3] >= COVER * self.length[k]]
        return share, spans


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, places (word, label) of base phrases, spans (start, stop, label) of templates, score."""
    small_batches(docs.sparkSession)
    made: list[Scanner] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Scanner(base, templates))
        scanner = made[0]
        for batch in batches:
            n_words, places, spans, scores = [], [], [], []
            for _, _, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets, NON_ALNUM, lower=True)
                tokens = scanner.tokens(words.hashes)
                known = tokens >= 0
                begin = np.flatnonzero(known & np.r_[True, ~known[:-1] | (words.doc[1:] != words.doc[:-1])][:len(known)])
                stop = np.flatnonzero(known & np.r_[~known[1:] | (words.doc[1:] != words.doc[:-1]), True][:len(known)]) + 1
                long = stop - begin >= scanner.least
                found: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
                for a, b in zip(begin[long].tolist(), stop[long].tolist(), strict=True):
                    doc = int(words.doc[a])
                    p, m = scanner.scan(tokens[a:b].tolist(), a - int(words.first[doc]))
                    found[doc][0].extend(p)
                    found[doc][1].extend(m)
                n_words += words.counts.tolist()
                for doc in range(len(words.counts)):
                    p, m = found.get(doc, ((), ()))
                    share, covered = scanner.chains(m) if m else ({}, [])
                    places.append([{"word": w, "label": scanner.labels[k]} for w, k in sorted(p)])
                    spans.append([{"start": a, "stop": b, "label": scanner.labels[k]} for a, b, k in sorted(covered)])
                    scores.append(1.0 if p else max(share.values(), default=0.0))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words, pa.int64()),
                pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))),
                pa.array(scores, pa.float64())], ["doc_id", "n_words", "places", "spans", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, places array<struct<word:long,label:string>>, spans array<struct<start:long,stop:long,label:string>>, score double")


def report(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, and comma-joined labels."""
    labels = F.transform("places", lambda p: p["label"])
    words = F.transform("places", lambda p: p["word"])
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, F.transform("spans", lambda s: s["label"])))), ",").alias("labels"),
        "score")
