"""Licence scan: winnowed template fingerprints in an inverted index, then banded alignment.

Templates are cut into runs of K words; the smallest hash of each WINDOW runs goes to the index (winnowing: Schleimer
et al., 2003). A document looks up all of its runs, so any stretch of K + WINDOW - 1 words in common is found; hits close
to one another name a candidate, and a banded alignment of the template with the words there counts the matches. Edits can
leave no such stretch, so windows that hold enough words of a template are candidates too: no report is lost to the index.
Reported: each stretch that covers at least `coverage` of a template, with its span in characters.

Null and empty texts give no rows; templates shorter than K words are one run; repeated rows give repeated reports, and
an empty table none. Overlapping reports of one template are told apart by their first word; of equal alignments the one
that begins first is reported. Very long texts are read whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, WINDOW = 3, 4
WORD = re.compile(r"\w+")

# Public notices by which licences are granted.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def words_of(text: str) -> list[str]:
    """Lower-cased words; split first, as lower case may be longer than the text that spans refer to."""
    return [w.lower() for w in WORD.findall(text)]


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [words_of(templates[n]) for n in self.names]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for ws in self.words]
        self.grams: dict[tuple[int, ...], list[tuple[int, int]]] = {}  # by the words of the run, so lengths never mix
        self.member = np.zeros((len(self.ids), len(self.vocabulary) + 1), bool)  # the last column is the word -1
        for t, ids in enumerate(self.ids):
            self.member[t, ids] = True
            runs = self.runs(ids)
            order = [xxhash.xxh64_intdigest(np.array(r, np.int64).tobytes()) for r in runs]
            chosen = {min(range(a, min(a + WINDOW, len(runs))), key=lambda k: (order[k], -k)) for a in range(max(1, len(runs) - WINDOW + 1))} if runs else set()
            for k in chosen:
                self.grams.setdefault(runs[k], []).append((t, k))

    def runs(self, ids: np.ndarray) -> list[tuple[int, ...]]:
        n, own = min(K, len(ids)), ids.tolist()
        return [tuple(own[k : k + n]) for k in range(len(own) - n + 1)] if n else []

    def hits(self, doc: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """template -> [(place in document, place in template)]; -1 in doc is a word of no template."""
        out: dict[int, list[tuple[int, int]]] = {}
        known, own = doc >= 0, doc.tolist()
        for n in sorted({len(g) for g in self.grams}):
            if len(own) < n:
                continue
            full = known[: len(own) - n + 1].copy()
            for k in range(1, n):
                full &= known[k : len(own) - n + 1 + k]
            for at in np.nonzero(full)[0].tolist():
                for t, k in self.grams.get(tuple(own[at : at + n]), ()):
                    out.setdefault(t, []).append((at, k))
        return out

    def windows(self, doc: np.ndarray, coverage: float) -> dict[int, np.ndarray]:
        """template -> starts of the windows of its length and two bands in which enough words are of the template."""
        out = {}
        for t, ids in enumerate(self.ids):
            need, size = coverage * len(ids), len(ids) + 2 * band_of(len(ids))
            if not need or len(doc) < need:
                continue
            total = np.concatenate([[0], np.cumsum(self.member[t][doc])])
            low = np.arange(-size + 1, len(doc))
            starts = low[total[np.minimum(low + size, len(doc))] - total[np.maximum(low, 0)] >= need]
            if len(starts):
                out[t] = starts
        return out


def band_of(m: int) -> int:
    return max(2, m // 8)


def align(template: np.ndarray, doc: np.ndarray, band: int) -> tuple[int, int, int]:
    """Most equal words of the template and doc in order, |place difference| <= band: (matches, first, end in doc)."""
    m, n = len(template), len(doc)
    # best[j]: (matches, -first place, end) with the template's words so far and doc[:j]
    best = [(0, 0, 0)] * (n + 1)
    for i in range(m):
        new = [(0, 0, 0)] * (n + 1)
        low, high = min(n, max(0, i - band)), min(n, i + band + 1)
        new[low] = best[low]
        for j in range(low, high):
            a = max(best[j + 1], new[j])
            if template[i] == doc[j]:
                s, f, _ = best[j]
                a = max(a, (s + 1, f if s else -j, j + 1))
            new[j + 1] = a
        for j in range(high, n):
            new[j + 1] = new[high]
        best = new
    s, f, e = best[n]
    return s, -f, e


def _between(ids: np.ndarray, doc: np.ndarray, starts: np.ndarray, coverage: float, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(matched, first, end) of stretches in the windows at starts, outside of the stretches already taken."""
    m, band = len(ids), band_of(len(ids))
    size, need, out = m + 2 * band, coverage * m, []
    times = np.bincount(ids)
    edges = [(0, 0), *sorted(taken), (len(doc), len(doc))]
    for (_, left), (right, _) in zip(edges, edges[1:]):
        if right - left < need:
            continue
        done, best, until = left, None, 0
        for w in starts[(starts + size > left) & (starts < right)].tolist():
            if best and w >= until:
                out.append(best)
                done, best = best[2], None
            low, high = max(w, done), min(w + size, right)
            if high - low < need:
                continue
            part = doc[low:high]
            if np.minimum(np.bincount(part[part >= 0], minlength=len(times))[: len(times)], times).sum() < (best[0] + 1 if best else need):
                continue
            matched, first, end = align(ids, part, 2 * band)
            if matched >= need and (not best or matched > best[0]):
                until = until if best else low + size
                best = (matched, low + first, low + end)
        if best:
            out.append(best)
    return out


def scan(text: str, index: Index, coverage: float) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) in order of place."""
    get = index.vocabulary.get
    doc = np.fromiter((get(w, -1) for w in words_of(text)), np.int64)
    found, taken = [], {}
    for t, hits in sorted(index.hits(doc).items()):
        ids, done = index.ids[t], -1
        m, band = len(ids), band_of(len(ids))
        for at, k in sorted(hits):
            if at < done:
                continue
            low = max(0, at - k - band, done)
            matched, first, end = align(ids, doc[low : at - k + m + band], 2 * band)
            if matched >= coverage * m and matched:
                found.append((t, matched, low + first, low + end))
                taken.setdefault(t, []).append((low + first, low + end))
                done = low + end
    for t, starts in index.windows(doc, coverage).items():
        found += [(t, *r) for r in _between(index.ids[t], doc, starts, coverage, taken.get(t, []))]
    places = [p.span() for p in WORD.finditer(text)] if found else []
    out = [(index.names[t], matched / len(index.ids[t]), matched, places[a][0], places[b - 1][1]) for t, matched, a, b in found]
    return sorted(out, key=lambda r: (r[3], r[0]))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """(id_col, template, coverage, n_matched, start, end): every stretch that covers enough of a template."""
    templates = templates or TEMPLATES

    def run(batches):
        index = Index(templates)
        for b in batches:
            rows = [(doc, *r) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for r in scan(t, index, coverage)]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[3:])], names=[id_col, "template", "coverage", "n_matched", "start", "end"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"`{id_col}` long, template string, coverage double, n_matched long, start long, end long")
