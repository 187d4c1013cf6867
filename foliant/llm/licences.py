"""Licence scans: a trained classifier of paragraphs, confirmed against templates.

A paragraph is a line with words; a line with several notices is cut between them, and what holds none is read in
overlapping windows, if long. Multinomial logistic regression
over its word 1- and 2-grams gives each licence family a probability, with ``unknown`` as a class of its own:
shuffled template words, invented words and other legal phrases teach it, and a temperature fitted on held-out
paragraphs calibrates it. A prediction counts when its probability is MIN_SCORE or more and a template of the
family agrees: most of the template's word pairs are in the paragraph, or most of the paragraph's in the template.

The model is trained from the templates alone (a second on the driver, the same on every run) and goes to the
workers with the function. A text without a telling word pair of any template (one that is not of two
common words) holds none, so it is passed over after one look at its words. One pair is enough: some have no more. Nothing is shuffled.

Notices are found by the templates over the whole line: places with most of a template's word pairs, close together.
Each is a match of its own, of the same or another family; only where places overlap does the closer agreement count.
Windows that overlap and name one family are one match.

Defined cases: null and empty texts have no paragraphs and no matches; words that fit two families give
the likelier; rows that repeat are scanned each.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, per_text

MIN_SCORE = 0.5
MIN_TEMPLATE = 0.6
MIN_PARAGRAPH = 0.8
MIN_PAIRS = 5
WINDOW = 80
SEED = 3
COPIES = 24
UNKNOWN = "unknown"

#: Short notices in common use, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is licensed under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}
#: What families are called in short notices, and how these are worded. ``{}`` is the name.
NAMES = {
    "apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0"), "mit": ("MIT License",), "bsd": ("BSD 3-Clause License", "BSD 2-Clause License"), "gpl": ("GNU General Public License, version 2", "GNU General Public License v3.0"),
    "lgpl": ("GNU Lesser General Public License v3.0",), "agpl": ("GNU Affero General Public License v3.0",), "mpl-2.0": ("Mozilla Public License 2.0",), "cc-by": ("Creative Commons Attribution 4.0 International License",),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International License",), "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License",), "cc-by-nd": ("Creative Commons Attribution-NoDerivatives 4.0 International License",),
    "cc0": ("CC0 1.0 Universal license",), "isc": ("ISC License",), "unlicense": ("Unlicense",),
}
WORDINGS = ("Released under the {}.", "Licensed under the {}.", "Distributed under the terms of the {}.")
#: Paragraphs of the licences' own texts that stand alone in files.
PARAGRAPHS = {
    "apache-2.0": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",),
    "mit": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "bsd": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "gpl": ("You should have received a copy of the GNU General Public License along with this program.",),
    "lgpl": ("You should have received a copy of the GNU Lesser General Public License along with this library.",),
    "agpl": ("You should have received a copy of the GNU Affero General Public License along with this program.",),
}
for _family, _names in NAMES.items():
    _more = [w.format(n) for n in _names for w in WORDINGS] + [*PARAGRAPHS.get(_family, ())]
    TEMPLATES[_family] += tuple(t for t in _more if t not in TEMPLATES[_family])
OTHER = (
    "All rights reserved.", "Driving license number and version of the form.", "The license to practise was granted by the state.", "Terms of use and conditions of sale apply to this work.",
    "This work was released in the spring.", "You may not use this form except in the office.", "The general public was asked to obtain a copy of the report.", "Permission was granted by the owner of the house.",
    "He was licensed under the old law to sell books.", "The foundation published version 3 of its report.", "This program is broadcast free of charge in the evening.", "The project is under review.",
)
_WORD = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_STOP = frozenset(b"the of and to in is a this be it or with by for on at that are was as any an not if".split())


def words_of(line: bytes) -> list[bytes]:
    return _WORD.findall(line.lower())


def _grams(words: list[bytes]) -> list[bytes]:
    return words + [a + b" " + b for a, b in zip(words, words[1:])]


def _training(seed: int = SEED) -> tuple[list[tuple[list[bytes], int]], list[str]]:
    """Paragraphs as words, with class numbers: templates with words dropped and strange words around; the last class is unknown."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    every = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t.encode())})

    def strange(n: int) -> list[bytes]:
        return [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(n)]

    out: list[tuple[list[bytes], int]] = []
    for k, family in enumerate(TEMPLATES):
        for t in TEMPLATES[family]:
            words = words_of(t.encode())
            for c in range(COPIES):
                kept = [w for w in words if c == 0 or rng.random() > 0.06] or words
                out.append((strange(int(rng.integers(0, 6)) if c else 0) + kept + strange(int(rng.integers(0, 6)) if c else 0), k))
    unknown = len(TEMPLATES)
    for t in OTHER:
        out += [(strange(int(rng.integers(0, 4))) + words_of(t.encode()), unknown) for _ in range(COPIES)]
    for _ in range(len(out) // 2):
        n = int(rng.integers(3, 30))
        known = [every[i] for i in rng.integers(0, len(every), n)]
        mixed = known[: int(rng.integers(0, n))] + strange(int(rng.integers(1, 12)))
        rng.shuffle(mixed)
        out.append((list(mixed), unknown))
    order = rng.permutation(len(out))
    return [out[i] for i in order], families


@cache
def model() -> dict:
    """{"families", "grams": gram -> row of weights, "bias", "temperature"}"""
    data, families = _training()
    hold = len(data) // 5
    train, held = data[hold:], data[:hold]
    counts: dict[bytes, int] = {}
    for words, _ in train:
        for g in set(_grams(words)):
            counts[g] = counts.get(g, 0) + 1
    grams = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= 3))}

    def dense(rows: list) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(grams)), np.float32)
        for i, (words, _) in enumerate(rows):
            at = [grams[g] for g in set(_grams(words)) if g in grams]
            if at:
                x[i, at] = 1 / np.sqrt(len(at))
        return x, np.array([k for _, k in rows])

    x, y = dense(train)
    w, b = np.zeros((len(grams), len(families)), np.float32), np.zeros(len(families), np.float32)
    goal = np.eye(len(families), dtype=np.float32)[y]
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(120):
        g = (softmax(x @ w + b) - goal) / len(y)
        vw = 0.9 * vw + x.T @ g + 1e-5 * w
        vb = 0.9 * vb + g.sum(0)
        w -= 4.0 * vw
        b -= 4.0 * vb
    hx, hy = dense(held)
    z = hx @ w + b
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(hy)), hy] + 1e-12).mean()
    temperature = min(np.geomspace(0.2, 5, 60).tolist(), key=loss)
    return {"families": families, "grams": grams, "weights": w, "bias": b, "temperature": float(temperature)}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Scanner:
    def __init__(self, trained: dict, min_score: float = MIN_SCORE):
        self.m, self.min_score = trained, min_score
        self.pairs = {f: [{(a, b) for w in [words_of(t.encode())] for a, b in zip(w, w[1:])} for t in ts] for f, ts in TEMPLATES.items()}
        vocabulary = sorted({w for sets in self.pairs.values() for s in sets for p in s for w in p})
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.telling = np.zeros((len(vocabulary) + 1,) * 2, bool)
        for sets in self.pairs.values():
            for s in sets:
                for a, b in s:
                    if not (a in _STOP and b in _STOP):
                        self.telling[self.number[a], self.number[b]] = True
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.templates = [(s, words_of(t.encode())) for f, ts in TEMPLATES.items() for s, t in zip(self.pairs[f], ts, strict=True)]
        self.holders: dict[tuple[bytes, bytes], list[int]] = {}
        for k, (s, _) in enumerate(self.templates):
            for p in s:
                self.holders.setdefault(p, []).append(k)

    def _numbers(self, text: bytes) -> np.ndarray:
        out: list[int] = []
        known = self.cache
        for w in text.lower().split():
            n = known.get(w)
            if n is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                n = known[w] = tuple(self.number.get(x, 0) for x in _WORD.findall(w))
            out += n
        return np.array(out, np.int64)

    def confirm(self, family: str, words: list[bytes], whole: bool = False) -> float:
        """The best agreement with a template of the family, or 0; ``whole``: only most of a template confirms."""
        mine = set(zip(words, words[1:]))
        best = 0.0
        for t in self.pairs[family]:
            both = len(mine & t)
            of_template = both / len(t)
            of_mine = both / len(mine) if mine and both >= MIN_PAIRS and not whole else 0.0
            if of_template >= MIN_TEMPLATE or of_mine >= MIN_PARAGRAPH:
                best = max(best, of_template, of_mine)
        return best

    def notices(self, words: list[bytes]) -> list[tuple[int, int, set[tuple[int, int]]]]:
        """Disjoint ranges of words, in order, that hold most of a template within half as many words again as it has,
        with the ranges in each that are a template word for word."""
        places: dict[int, list[int]] = {}
        for i, p in enumerate(zip(words, words[1:])):
            for k in self.holders.get(p, ()):
                places.setdefault(k, []).append(i)
        found, exact = [], set()
        for k, at in places.items():
            pairs, template = self.templates[k]
            n = len(template)
            if len(at) < MIN_TEMPLATE * len(pairs):
                continue
            for j, first in enumerate(at):
                seen: set[tuple[bytes, bytes]] = set()
                best = None
                for i in at[j:]:
                    if i + 2 - first > n + n // 2:
                        break
                    if (pair := (words[i], words[i + 1])) not in seen:
                        seen.add(pair)
                        if len(seen) >= MIN_TEMPLATE * len(pairs):  # pairs of the template, less those between that are not
                            best = max(best or (-len(words), 0), (2 * len(seen) - (i + 1 - first), i + 2))
                if best:
                    found.append((-best[0], first, best[1]))
                    if words[first : first + n] == template:
                        exact.add((first, first + n))
        out: list[tuple[int, int]] = []
        free = np.ones(len(words), bool)
        for _, first, end in sorted(found):
            if free[first:end].all():
                free[first:end] = False
                out.append((first, end))
        return [(first, end, {(a, b) for a, b in exact if first <= a and b <= end}) for first, end in sorted(out)]

    def classify(self, words: list[bytes]) -> tuple[str, float]:
        m = self.m
        at = [m["grams"][g] for g in set(_grams(words)) if g in m["grams"]]
        z = m["bias"] + (m["weights"][sorted(at)].sum(0) / np.sqrt(len(at)) if at else 0)
        p = softmax(z / m["temperature"])
        k = int(p.argmax())
        return m["families"][k], float(p[k])

    def judge(self, words: list[bytes], whole: bool = False) -> tuple[str, float, float] | None:
        """(family, score, similarity) of words that are a licence notice."""
        ids = np.array([self.number.get(w, 0) for w in words], np.int64)
        if len(ids) < 2 or not self.telling[ids[:-1], ids[1:]].any():
            return None
        family, score = self.classify(words)
        if family == UNKNOWN or score < self.min_score or not (like := self.confirm(family, words, whole)):
            return None
        return family, score, like

    def line(self, words: list[bytes]) -> list[tuple[int, int, str, float, float]]:
        """(first word, end, family, score, similarity) of every notice of a line, in order."""
        ids = np.array([self.number.get(w, 0) for w in words], np.int64)
        if len(ids) < 2 or not self.telling[ids[:-1], ids[1:]].any():
            return []
        notices = self.notices(words)
        alone = len(words) <= WINDOW and len(notices) < 2
        if alone and not notices:
            return [(0, len(words), *m)] if (m := self.judge(words)) else []
        out = []
        edges = [0, *(x for n in notices for x in n[:2]), len(words)]
        for k, (first, end, exact) in enumerate(notices):
            pad = WINDOW if alone else max(0, WINDOW - (end - first)) // 2
            m = self.judge(words[max(edges[2 * k], first - pad) : min(edges[2 * k + 3], end + pad)])
            for a, b in sorted(exact):  # another family's template that stands there word for word, if likelier
                if (other := self.judge(words[a:b])) and (m is None or other[0] != m[0] and other[1] > m[1]):
                    m = other
            if m:
                out.append((0, len(words), *m) if alone else (first, end, *m))
        if alone:
            return out
        for low, high in zip(edges[::2], edges[1::2]):  # what lies between
            last: dict[str, int] = {}
            for a in range(low, max(low + 1, high - WINDOW // 2), WINDOW // 2):
                b = min(a + WINDOW, high)
                if not (m := self.judge(words[a:b], bool(notices))):
                    continue
                if m[0] in last and out[last[m[0]]][1] > a:
                    first, _, *old = out[last[m[0]]]
                    out[last[m[0]]] = (first, b, *max(m, tuple(old), key=lambda x: x[1]))
                else:
                    last[m[0]] = len(out)
                    out.append((a, b, *m))
        return sorted(out)

    def __call__(self, text: bytes) -> tuple[int, list[dict]]:
        """(paragraphs, matches in order); start and end are places of bytes in the text's UTF-8: the line's, or those
        of the notice's words if the line has several notices or is longer than a window."""
        lines = text.split(b"\n")
        n = sum(1 for x in lines if x and not x.isspace())
        numbers = self._numbers(text)
        if len(numbers) < 2 or not self.telling[numbers[:-1], numbers[1:]].any():
            return n, []
        found, start = [], 0
        for i, line in enumerate(lines):
            words = words_of(line)
            matches = self.line(words)
            spans = [m.span() for m in _WORD.finditer(line.lower())] if matches else []
            for first, end, family, score, like in matches:
                a, b = (0, len(line)) if (first, end) == (0, len(words)) else (spans[first][0], spans[end - 1][1])
                found.append({"line": i, "start": start + a, "end": start + b, "family": family, "score": score, "similarity": like})
            start += len(line) + 1
        return n, found


_KIND = pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("score", pa.float64()), ("similarity", pa.float64())]))
_TYPE = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("family", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("similarity", T.DoubleType())]))


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The columns ``keep``, n_paragraphs and matches (line, start, end, family, score, similarity)."""
    trained = model()

    def make():
        scanner = Scanner(trained, min_score)

        def work(texts: list[bytes]) -> list:
            out = [scanner(t) for t in texts]
            return [[n for n, _ in out], [found for _, found in out]]

        return work

    return per_text(docs, keep, text_col, [("n_paragraphs", T.LongType(), pa.int64()), ("matches", _TYPE, _KIND)], make)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_matches, families (distinct, sorted, comma between) and the largest score (0 without a match)."""
    out = scan(docs, [id_col], text_col)
    return out.select(
        F.col(id_col).alias("doc_id"), "n_paragraphs", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["family"]))), ",").alias("families"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
