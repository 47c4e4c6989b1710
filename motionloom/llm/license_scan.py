"""Licence families of paragraphs: sparse word n-gram logistic regression.

A paragraph is a line of a text, and besides, where words of a template run on over
lines that no blank line parts, the words from the first to the last of them: so a
wrapped notice is judged whole. A paragraph's word unigrams and bigrams, hashed into
BUCKETS, are the sparse features of a softmax regression over the families and an
unknown class. It is trained on varied copies of TEMPLATES and, as unknown, on notices
of OTHERS and on all different lines of at most SAMPLE documents (in the order of a
hash of their key) that resemble no template. A temperature calibrates the
probabilities; it is fitted, and the accuracy measured, by models that haven't seen
the held-out templates. A predicted family must be confirmed: enough of the word
trigrams of one of its templates must stand in the paragraph.

Cases: null or empty text: no paragraphs, family null; blank lines are no
paragraphs; ties of paragraphs go to the first; repeated rows and null keys are
returned each; empty table: no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.llm import words as W
from motionloom.llm.common import bulks, column, bounded_batches, texts

BUCKETS, SAMPLE, CONFIRM, LEAST_PROBABILITY, GAP = 1 << 16, 1000, 0.6, 0.5, 12

# Notices by which public licences are usually named or granted.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.", "This work is licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License, Version 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "Use of this source code is governed by a BSD-style license."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 3.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Licensed under the GNU General Public License, version 2.", "Released under the GNU GPL version 3."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "This work is licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.', 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited."],
}
# Notices of licences that are none of these families.
OTHERS = [
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This is free and unencumbered software released into the public domain.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Distributed under the Boost Software License, Version 1.0.",
    "You may distribute this package under the terms of the Artistic License 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under the Open Database License (ODbL) v1.0.",
]
FAMILIES = [*sorted(TEMPLATES), "unknown"]
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _words(b: np.ndarray, bounds: np.ndarray):
    low = W.lowered(b)
    inside = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    starts, ends = W.runs(inside, bounds)
    return starts, ends, W.hashes(low, starts, ends)


def grams(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of unigrams and bigrams of words h, and the paragraph of each."""
    two = of[1:] == of[:-1]
    pair = (h[:-1][two] * W.POWERS[3]) ^ (h[1:][two] * W.POWERS[5])
    ids = np.concatenate([h, pair]) >> np.uint64(48)
    return ids.astype(np.int64), np.concatenate([of, of[:-1][two]])


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of word trigrams (all words together, if fewer than three)."""
    if len(h) < 3:
        return np.unique(h)
    return np.unique((h[:-2] * W.POWERS[9]) ^ (h[1:-1] * W.POWERS[11]) ^ (h[2:] * W.POWERS[13]))


def _one(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8)
    return _words(b, np.array([0, len(b)]))[2]


class Scanner:
    def __init__(self, ordinary: list[str], seed: int = 3, epochs: int = 5):
        self.templates = [(k, f, shingles(_one(t))) for k, f in enumerate(FAMILIES[:-1]) for t in TEMPLATES[f]]
        self.known = np.unique(np.concatenate([t for *_, t in self.templates]))
        rng = np.random.default_rng(seed)
        unlike = [t for t in ordinary if self.confirmation(_one(t))[1] < 0.3]
        fillers = [w for t in unlike for w in t.split()] or ["lorem", "ipsum", "dolor"]
        notices = [(k, t) for k, f in enumerate(FAMILIES[:-1]) for t in TEMPLATES[f]] + [(len(FAMILIES) - 1, t) for t in OTHERS]
        feats, y, source = [], [], []
        for n, (k, t) in enumerate(notices):
            for v in range(24):
                own = t.split()
                if v and len(own) > 4:
                    own = [w for w in own if rng.random() > 0.05]
                own = [w.upper() if v % 7 == 3 else w for w in own]
                pad = rng.integers(0, 12, 2) if v % 3 == 2 else (0, 0)
                around = [[fillers[i] for i in rng.integers(0, len(fillers), int(m))] for m in pad]
                feats.append(self._features(" ".join(around[0] + own + around[1])))
                y.append(k)
                source.append(n)
        for n, t in enumerate(unlike):
            feats.append(self._features(t))
            y.append(len(FAMILIES) - 1)
            source.append(len(notices) + n)
        y, source = np.array(y), np.array(source)
        # the last notice of a family of several, and of the others, isn't seen by the model that is measured
        last = {k: n for n, (k, _) in enumerate(notices) if sum(j == k for j, _ in notices) > 1}
        held = np.isin(source, list(last.values())) | ((source >= len(notices)) & (source % 5 == 0))
        logits, target = self._fit(feats, y, ~held, rng, epochs)(np.flatnonzero(held)), y[held]
        grid = np.geomspace(0.3, 5, 30)
        loss = [-np.log(self._softmax(logits / t)[np.arange(len(target)), target] + 1e-12).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        self.held_out_accuracy = float((logits.argmax(axis=1) == target).mean())
        p = self._softmax(logits / self.temperature).max(axis=1)
        #: Mean probability and accuracy of held-out paragraphs, by probability.
        self.reliability = [(float(p[b].mean()), float((logits.argmax(axis=1) == target)[b].mean()), int(b.sum())) for lo in (0.0, 0.5, 0.7, 0.9) if (b := (p >= lo) & (p < {0.0: 0.5, 0.5: 0.7, 0.7: 0.9, 0.9: 1.1}[lo])).any()]
        self._fit(feats, y, np.ones(len(y), bool), rng, epochs)
        self.weights = self.weights.astype(np.float32)

    @staticmethod
    def _features(text: str) -> np.ndarray:
        h = _one(text)
        return grams(h, np.zeros(len(h), np.int64))[0]

    def _fit(self, feats: list[np.ndarray], y: np.ndarray, use: np.ndarray, rng, epochs: int):
        """Train on the rows in use; gives a function from rows to logits."""
        self.weights = np.zeros((BUCKETS, len(FAMILIES)))
        self.bias = np.zeros(len(FAMILIES))
        self.bias[-1] = 2.0
        squares = np.full((BUCKETS, len(FAMILIES)), 1e-8)
        rows = np.flatnonzero(use)
        share = np.bincount(y[rows], minlength=len(FAMILIES)) / max(1, len(rows))
        for _ in range(epochs):
            for i in rng.permutation(rows):
                ids = feats[i]
                if not len(ids):
                    continue
                g = self._softmax(self.weights[ids].sum(axis=0) / np.sqrt(len(ids)) + self.bias)
                g[y[i]] -= 1
                g *= min(2.0, 1 / max(share[y[i]] * len(FAMILIES), 0.1)) / np.sqrt(len(ids))
                u = np.unique(ids)
                squares[u] += g * g
                self.weights[u] -= 0.3 * g / np.sqrt(squares[u])
        return lambda at: np.array([self.weights[feats[i]].sum(axis=0) / np.sqrt(max(1, len(feats[i]))) + self.bias for i in at])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def confirmation(self, h: np.ndarray, family: int | None = None) -> tuple[int, float]:
        """The family of the most contained template (of this family only, if given), and how much of it is contained."""
        s, best = shingles(h), (0, 0.0)
        full = np.unique(h)
        for k, _, t in self.templates:
            if family in (None, k) and len(t):
                own = full if len(t) < 1 else s
                c = float(np.isin(t, own).mean())
                if c > best[1]:
                    best = k, c
        return best

    def _runs(self, h: np.ndarray, starts: np.ndarray, b: np.ndarray, bounds: np.ndarray, line: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words, of more than one line, from the first to the last template trigram of a run of such."""
        if len(h) < 3:
            return []
        three = (h[:-2] * W.POWERS[9]) ^ (h[1:-1] * W.POWERS[11]) ^ (h[2:] * W.POWERS[13])
        hit = np.flatnonzero(np.isin(three, self.known))
        if not len(hit):
            return []
        # no run goes on over a blank line or into the next text
        ends = np.flatnonzero(b == 10)
        blank = ends[1:][[not bytes(b[a + 1 : z]).strip() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]] if len(ends) > 1 else np.zeros(0, np.int64)
        walls = np.searchsorted(starts, np.sort(np.concatenate([blank, bounds])))
        side = lambda i: np.searchsorted(walls, i, "right")
        hit = hit[side(hit) == side(hit + 2)]
        if not len(hit):
            return []
        new = np.concatenate([[True], (np.diff(hit) > GAP) | (side(hit[1:]) != side(hit[:-1]))])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit)) - 1
        return [(int(hit[f]), int(hit[z]) + 3) for f, z in zip(first, last, strict=True) if line[hit[f]] != line[hit[z] + 2]]

    def scan(self, b: np.ndarray, bounds: np.ndarray):
        """For each paragraph with words: text, line in it, family, probability, similarity; runs over lines stand last."""
        line = np.zeros(len(b) + 1, bool)
        line[bounds] = True
        line[1:][b == 10] = True
        cuts = np.flatnonzero(line)
        if not len(b):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0), np.zeros(0), 0)
        starts, _, h = _words(b, cuts)
        para = np.searchsorted(cuts, starts, "right") - 1
        lines = len(cuts) - 1
        runs = self._runs(h, starts, b, bounds, para)
        words = np.concatenate([np.arange(len(h)), *(np.arange(f, z) for f, z in runs)])
        of = np.concatenate([para, *(np.full(z - f, lines + k) for k, (f, z) in enumerate(runs))]).astype(np.int64)
        n = lines + len(runs)
        ids, of_gram = grams(h[words], of)
        logits = np.zeros((n, len(FAMILIES)))
        order = np.argsort(of_gram, kind="stable")
        size = np.bincount(of_gram, minlength=n)
        has = np.flatnonzero(size)
        for a in range(0, len(has), 20_000):  # slabs bound the memory of the gathered weights
            part = has[a : a + 20_000]
            lo, hi = np.searchsorted(of_gram[order], [part[0], part[-1] + 1])
            got = self.weights[ids[order[lo:hi]]]
            logits[part] = np.add.reduceat(got, np.searchsorted(of_gram[order[lo:hi]], part), axis=0) / np.sqrt(size[part])[:, None]
        p = self._softmax((logits + self.bias) / self.temperature)
        family, probability, similarity = p.argmax(axis=1), p.max(axis=1), np.zeros(n)
        first = np.searchsorted(of, np.arange(n + 1))
        for k in np.flatnonzero((size > 0) & (family < len(FAMILIES) - 1)):
            similarity[k] = self.confirmation(h[words[first[k] : first[k + 1]]], int(family[k]))[1]
        doc = np.searchsorted(bounds, cuts[:-1], "right") - 1
        place = np.arange(lines) - np.searchsorted(doc, doc)
        begin = para[[f for f, _ in runs]] if runs else np.zeros(0, np.int64)
        doc, place = np.concatenate([doc, doc[begin]]), np.concatenate([place, place[begin]])
        return doc[has], place[has], family[has], probability[has], similarity[has], int((has >= lines).sum())


def train(docs: DataFrame, sample: int = SAMPLE) -> Scanner:
    """A scanner whose unknown class is learned from paragraphs of at most `sample` documents."""
    few = texts(docs)
    ids = few.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = few.join(F.broadcast(ids), "doc_id").select("doc_id", F.sha2("text", 256).alias("s"), "text").collect()
    lines = [x.strip() for r in sorted(rows, key=lambda r: (r[0], r[1])) for x in r[2].split("\n")]
    return Scanner([x for x in dict.fromkeys(lines) if x])


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """One row per document: its most probable confirmed licence paragraph, or else what it is predicted to be.

    family is null without a licence paragraph; confirmed says whether a template agrees;
    n_licence counts the confirmed paragraphs, and families names all confirmed families.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for table in bulks(batches):
            n = len(table)
            doc, place, family, p, like, over_lines = scanner.scan(*W.flat(column(table, "text")))
            whole = np.arange(len(doc)) < len(doc) - over_lines
            known = family < len(FAMILIES) - 1
            sure = known & (p >= LEAST_PROBABILITY) & (like >= CONFIRM)
            best = np.full(n, -1)
            at = np.flatnonzero(known & (p >= LEAST_PROBABILITY))
            at = at[np.lexsort((place[at], -p[at], ~sure[at], doc[at]))]
            d, first = np.unique(doc[at], return_index=True)
            best[d] = at[first]
            none = best < 0
            pick = lambda x, kind: pa.array(x[best] if len(x) else np.zeros(n, x.dtype), kind, mask=none)
            names = np.array(FAMILIES)[family] if len(family) else np.zeros(0, "U1")
            every: list[set] = [set() for _ in range(n)]
            for i in np.flatnonzero(sure).tolist():
                every[doc[i]].add(str(names[i]))
            yield pa.RecordBatch.from_arrays(
                [column(table, "doc_id"), pa.array(np.bincount(doc[whole], minlength=n), pa.int64()), pa.array(np.bincount(doc[sure], minlength=n), pa.int64()), pa.array([None if z else str(names[i]) for i, z in zip(best, none, strict=True)], pa.string()), pick(place, pa.int64()), pick(p, pa.float64()), pick(like, pa.float64()), pa.array([False if z else bool(sure[i]) for i, z in zip(best, none, strict=True)]), pa.array([sorted(x) for x in every], pa.list_(pa.string()))],
                ["doc_id", "n_paragraphs", "n_licence", "family", "paragraph", "probability", "similarity", "confirmed", "families"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_paragraphs long, n_licence long, family string, paragraph long, probability double, similarity double, confirmed boolean, families array<string>")
