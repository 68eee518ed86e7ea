"""Licence scans with a trained classifier of word windows and a comparison with templates.

A paragraph ends at a line without words; wrapped lines are joined.  In it, every stretch of words from one 2-gram of a
template to another, at most `SLACK` words longer than the template, is a window if it has at least `LEAST_COVER` of the
template's 2-grams.  Its features are the word 1- and 2-grams (A-Z lower-cased) that some template has, counted and divided by
the root of its words.  Multinomial logistic regression over them gives a family, or unknown.  It is trained on templates,
whole, in parts and between words of the corpus, against lines of at most `NEGATIVE_DOCS` documents and shuffled template
words.  A temperature fitted on rows kept back calibrates the probabilities.

Each window whose family has a probability of at least `LEAST_SCORE` is a notice, those with most 2-grams for their words first;
notices of one family don't overlap.  A window that overlaps notices of other families is judged by its other words, and needs a 2-gram
among them that no other family has.  A notice is reported with the number of its first line.

Null and empty texts have no paragraphs.  Equal texts get equal results; every window of every row is looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import PLAIN, Words, chunks, windows

NEGATIVE_DOCS = 300
LEAST_SCORE, LEAST_COVER = 0.5, 0.7
# As many words as training puts around a template.
SLACK = 22
UNKNOWN = "unknown"
SCANNED = ("doc_id long, n_paragraphs long, licences array<struct<paragraph: long, family: string, score: double, cover: double>>")

# Wordings by which works name their licence.
TEMPLATES = {
    "agpl": ["GNU Affero General Public License", "licensed under the GNU AGPL version 3",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "apache": ["Licensed under the Apache License, Version 2.0", "released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0",
               "you may not use this file except in compliance with the License"],
    "bsd": ["licensed under the BSD 3-Clause License", "Released under the BSD License",
            "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["CC0 1.0 Universal", "dedicated to the public domain under CC0", "released into the public domain"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "released under the GNU GPL version 2 or later",
            "redistribute it and/or modify it under the terms of the GNU General Public License",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-only"],
    "isc": ["licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["licensed under the GNU Lesser General Public License", "under the terms of the GNU LGPL version 2.1",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License", "licensed under the MIT license", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["licensed under the Mozilla Public License, version 2.0", "subject to the terms of the Mozilla Public License, v. 2.0"],
    "reserved": ["All rights reserved", "may not be reproduced without written permission", "proprietary and confidential"],
}


def _paragraphs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For paragraphs with words: bounds in the words and document; for each word its line number in the document."""
    breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    line = breaks[words.starts] - breaks[words.offsets[doc]] if len(doc) else np.zeros(0, np.int64)
    first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(line, prepend=0) > 1))
    return np.append(first, len(doc)), doc[first], line


@dataclass
class Model:
    grams: np.ndarray  # sorted hashes of the n-grams of templates
    weights: np.ndarray
    bias: np.ndarray
    families: list[str]  # unknown first
    covers: dict[str, list[np.ndarray]]  # sorted hashes of the 2-grams of each template
    temperature: float = 1.0

    def features(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of the weights of each n-gram that is known, and its paragraph."""
        pairs, starts = windows(hashes, bounds, 2)
        every = np.concatenate([hashes, pairs])
        owner = np.searchsorted(bounds, np.concatenate([np.arange(len(hashes)), starts]), "right") - 1
        at = np.minimum(np.searchsorted(self.grams, every), len(self.grams) - 1)
        hit = self.grams[at] == every
        return at[hit], owner[hit]

    def probabilities(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        rows, owner = self.features(hashes, bounds)
        n = len(bounds) - 1
        logits = np.stack([np.bincount(owner, w, n) for w in self.weights.T[:, rows]], axis=1) if n else np.zeros((0, len(self.families)))
        logits = (logits / np.sqrt(np.maximum(np.diff(bounds), 1))[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def __post_init__(self) -> None:
        templates = [(k, t) for k, f in enumerate(self.families) if k for t in self.covers[f]]
        self.family = np.array([k for k, _ in templates])
        self.pairs = np.unique(np.concatenate([t for _, t in templates]))
        self.has = np.stack([np.isin(self.pairs, t) for _, t in templates])  # template by 2-gram
        self.sizes = self.has.sum(axis=1)
        owners = np.stack([self.has[self.family == k].any(axis=0) for k in range(1, len(self.families))])
        self.only = np.where(owners.sum(axis=0) == 1, owners.argmax(axis=0) + 1, 0)  # the family that alone has the 2-gram

    def notices(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, float, float]]:
        """Paragraph, first word, family, probability and cover of each notice."""
        pairs, starts = windows(hashes, bounds, 2)
        gram = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        hit = self.pairs[gram] == pairs
        gram, starts = gram[hit], starts[hit]
        owner = np.searchsorted(bounds, starts, "right") - 1
        out = []
        for k in np.unique(owner):
            a, b = np.searchsorted(owner, [k, k + 1])
            enough = np.flatnonzero(self.has[:, np.unique(gram[a:b])].sum(axis=1) >= LEAST_COVER * self.sizes)
            if len(enough):
                out += [(int(k), *x) for x in self._accepted(hashes, self._covered(gram[a:b], starts[a:b], enough), gram[a:b], starts[a:b])]
        return out

    def _covered(self, gram: np.ndarray, starts: np.ndarray, templates: np.ndarray) -> list[tuple[bool, int, int, int, int, float]]:
        """Windows: if no 2-gram is its family's alone, words less twice the 2-grams, words, first word, family, cover; in the order of judging."""
        found = set()
        for t in templates:
            k, size = int(self.family[t]), int(self.sizes[t])
            mine = np.flatnonzero(self.has[t, gram])
            at, own, alone = starts[mine].tolist(), gram[mine].tolist(), (self.only[gram[mine]] == k).tolist()
            for i in range(len(at)):
                seen, exclusive = set(), False
                for j in range(i, len(at)):
                    words = at[j] + 2 - at[i]
                    if words > size + 1 + SLACK:
                        break
                    exclusive |= alone[j]
                    if own[j] not in seen:
                        seen.add(own[j])
                        if len(seen) >= LEAST_COVER * size:
                            found.add((not exclusive, words - 2 * len(seen), words, at[i], k, len(seen) / size))
                    if len(seen) == size:
                        break
        return sorted(found)

    def _accepted(self, hashes: np.ndarray, covered: list, gram: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, float, float]]:
        if not covered:
            return []
        base = min(x[3] for x in covered)
        taken = np.zeros(max(x[3] + x[2] for x in covered) - base, np.int64)  # a bit for each family
        cuts = np.concatenate([[0], np.cumsum([x[2] for x in covered])])
        p = self.probabilities(np.concatenate([hashes[x[3]:x[3] + x[2]] for x in covered]), cuts)
        waiting, out, more = list(enumerate(covered)), [], True
        while more:
            more, left = False, []
            for n, x in waiting:
                _, _, words, at, k, cover = x
                own = taken[at - base:at - base + words]
                if (own & (1 << k)).any():
                    continue
                score, first = float(p[n, k]), at
                if own.any():
                    free = own == 0
                    here = starts[(starts >= at) & (starts < at + words - 1) & (self.only[gram] == k)] - at
                    if not (free[here] & free[here + 1]).any():
                        continue
                    score, first = float(self.probabilities(hashes[at:at + words][free], np.array([0, int(free.sum())]))[0, k]), at + int(free.argmax())
                if score < LEAST_SCORE:
                    left.append((n, x))
                    continue
                own |= np.where(own == 0, 1 << k, 0)
                out.append((first, k, score, cover))
                more = True
            waiting = left
        return sorted(out)

    def cover(self, family: str, hashes: np.ndarray) -> float:
        own = windows(hashes, np.array([0, len(hashes)]), 2)[0]
        return max(float(np.isin(t, own).mean()) for t in self.covers[family])


def _hashes(text: str) -> np.ndarray:
    return Words(pa.array([text]), PLAIN, lower=True).hashes()


def fit(negatives: list[str], seed: int = 11) -> Model:
    """Trained on the templates against `negatives`, paragraphs of the corpus."""
    rng = np.random.default_rng(seed)
    families = [UNKNOWN, *TEMPLATES]
    hashed = {f: [_hashes(t) for t in texts] for f, texts in TEMPLATES.items()}
    two = lambda h: np.unique(windows(h, np.array([0, len(h)]), 2)[0])
    covers = {f: [two(h) for h in hs] for f, hs in hashed.items()}
    grams = np.unique(np.concatenate([x for hs in hashed.values() for h in hs for x in (h, two(h))]))
    model = Model(grams, np.zeros((len(grams), len(families))), np.zeros(len(families)), families, covers)
    plain = [h for h in map(_hashes, negatives) if len(h) and max(model.cover(f, h) for f in covers) < 0.5]
    words = np.concatenate([h for hs in hashed.values() for h in hs])
    other = np.concatenate(plain) if plain else words[:1]
    rows, labels = list(plain), [0] * len(plain)
    for k, f in enumerate(families[1:], 1):
        for h in hashed[f]:
            for _ in range(30):
                size = len(h) if rng.random() < 0.5 else max(2, int(len(h) * rng.uniform(0.7, 1.0)))
                at = int(rng.integers(0, len(h) - size + 1))
                around = [rng.choice(other, int(rng.integers(0, 12))) if rng.random() < 0.6 else other[:0] for _ in range(2)]
                rows.append(np.concatenate([around[0], h[at:at + size], around[1]]))
                labels.append(k)
    for _ in range(400):
        rows.append(rng.choice(words, int(rng.integers(2, 20))))
        labels.append(0)
    order = rng.permutation(len(rows))
    bounds = np.concatenate([[0], np.cumsum([len(rows[i]) for i in order])])
    flat, y = np.concatenate([rows[i] for i in order]), np.array(labels)[order]
    at, owner = model.features(flat, bounds)
    x = np.zeros((len(rows), len(grams)))
    np.add.at(x, (owner, at), 1.0)
    x /= np.sqrt(np.maximum(np.diff(bounds), 1))[:, None]
    kept = np.arange(len(rows)) % 5 == 0
    target = np.eye(len(families))[y]
    speed_w, speed_b = np.zeros_like(model.weights), np.zeros_like(model.bias)
    for _ in range(300):  # gradient descent with momentum
        z = x[~kept] @ model.weights + model.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - target[~kept]) / (~kept).sum()
        speed_w = 0.9 * speed_w - 4.0 * (x[~kept].T @ d + 1e-5 * model.weights)
        speed_b = 0.9 * speed_b - 4.0 * d.sum(axis=0)
        model.weights += speed_w
        model.bias += speed_b
    z = x[kept] @ model.weights + model.bias

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(q)), y[kept]]).mean())

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    return model


def negative_paragraphs(docs: DataFrame, most: int = NEGATIVE_DOCS) -> list[str]:
    """Paragraphs of at most `most` documents, drawn by a hash of doc_id."""
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.lit("licence"), "doc_id"), F.lit(1 << 30))
    rows = docs.filter(draw < int(min(1.0, 1.5 * most / max(n, 1)) * (1 << 30))).select("text").limit(most).collect()
    return [p for r in rows for p in (r["text"] or "").split("\n") if p.strip()]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs (with words) and the confirmed `licences` of each row; `paragraph` is the first line of the notice."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(negative_paragraphs(rows)))

    def classify(batches):
        m = sent.value
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"), PLAIN, lower=True)
                hashes = words.hashes()
                bounds, doc, line = _paragraphs(words)
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k, first, family, score, cover in m.notices(hashes, bounds):
                    found[doc[k]].append({"paragraph": int(line[first]), "family": m.families[family], "score": score, "cover": cover})
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_paragraphs": pa.array(np.bincount(doc, minlength=part.num_rows), pa.int64()),
                    "licences": pa.array(found, pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("score", pa.float64()), ("cover", pa.float64())])))})

    return rows.mapInArrow(classify, SCANNED)
