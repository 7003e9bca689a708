"""License scans: winnowed fingerprints of license texts pick candidates, banded alignment reports coverage and spans.

Texts are words of letters and digits in lower case. A template's fingerprints are the smallest hash of every window of
``WINDOW`` neighbouring runs of ``GRAM`` words; an inverted index maps a fingerprint to its templates and places. All runs of a
document are looked up, so whatever a window guarantees for the template is found at any place of a text of any length. Hits
of a template that lie close together make a region; a region with enough of the template's fingerprints is aligned with it in
a band around the diagonals of the hits (local alignment by words). A match is reported if its words cover at least the wanted
share of the template; of overlapping matches the one with most words stays (ties: the earlier, then the smaller name).

Cases: null, empty and wordless texts have no matches; a text is scanned whole; every occurrence is a row; repeated rows are
scanned each. Templates without words are ignored, shorter ones than a run are one run. Rows without an id are scanned too.
Other columns are not read. Empty tables and empty template lists give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wavelane.llm.shingles import shingle_hashes

GRAM, WINDOW = 3, 3
COVERAGE = 0.8
SHARE = 0.2      # least share of a template's fingerprints in a region
SLACK = 6        # words that the band reaches beyond the hits' diagonals
MOST_FINGERPRINTS = 2_000_000  # the index is sent to all tasks

# Notices and texts of common licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

_word = re.compile(r"[^\W_]+")


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the fingerprints: the last smallest hash of every window of neighbouring hashes."""
    if not len(hashes):
        return []
    span = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], span)
    picked = views.argmin(axis=1) + np.arange(len(views))  # first of the reversed order is the last of the window
    return sorted({len(hashes) - 1 - int(p) for p in picked})


@dataclass
class Index:
    names: list[str]
    words: list[list[str]]
    prints: list[int]                            # fingerprints per template
    places: dict[tuple, list[tuple[int, int]]]   # run of words -> (template, word)
    keys: np.ndarray                             # hashes of the runs, sorted
    gram: int


def build_index(templates: list[tuple[str, str]], gram: int = GRAM, window: int = WINDOW) -> Index:
    names, words, prints, places, keys = [], [], [], {}, set()
    for name, text in templates:
        found = [m[0].lower() for m in _word.finditer(text)]
        hashes = shingle_hashes(text, gram)
        if not len(hashes):
            continue
        at = winnow(hashes, window)
        for place in at:
            places.setdefault(tuple(found[place:place + gram]), []).append((len(names), place))
            keys.add(int(hashes[place]))
        names.append(name)
        words.append(found)
        prints.append(len(at))
    if sum(prints) > MOST_FINGERPRINTS:
        raise ValueError("too many templates to send to the tasks; scan them in parts")
    return Index(names, words, prints, places, np.array(sorted(keys), np.uint64), gram)


def align(template: list[str], words: list[str], low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, last + 1 word) of the best local alignment with word - place in [low, high]; (0, 0, 0) without one.

    A match counts 2, a difference or a gap -1; of equal scores the first end is taken.
    """
    width = high - low + 1
    best, end = 0, (0, 0, 0)
    nothing = (0, 0, 0)                # score, matched, first word
    above = [nothing] * (width + 1)
    for i, own in enumerate(template):
        row, left = [], nothing
        for k in range(width):
            j = i + low + k
            if j < 0 or j >= len(words):
                row.append(nothing)
                left = nothing
                continue
            score, matched, first = above[k]
            if not score:
                first = j
            cell = (score + 2, matched + 1, first) if own == words[j] else (score - 1, matched, first)
            up = above[k + 1]
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, left[1], left[2])
            if cell[0] <= 0:
                cell = nothing
            elif cell[0] > best:
                best, end = cell[0], (cell[1], cell[2], j + 1)
            row.append(cell)
            left = cell
        above = [*row, nothing]
    return end


def _matches(own: list[str], words: list[str], low: int, high: int, coverage: float) -> list[tuple[int, int, int]]:
    """All (matched words, first, last + 1 word) of a template in the band that cover enough of it; best first."""
    begin, out = max(low, 0), []
    window = words[begin:high + len(own)]
    while True:
        matched, first, last = align(own, window, low - begin, high - begin)
        if not matched or matched < coverage * len(own) - 1e-9:
            return out
        out.append((matched, begin + first, begin + last))
        window[first:last] = [""] * (last - first)  # no word, so the next round finds another place


def scan(text: str | None, index: Index, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, start, end) in a text, by place; start and end count characters."""
    hashes = shingle_hashes(text, index.gram)
    if not len(hashes) or not len(index.keys):
        return []
    if not (index.keys[np.minimum(np.searchsorted(index.keys, hashes), len(index.keys) - 1)] == hashes).any():
        return []
    spans = [m.span() for m in _word.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    by_template: dict[int, list[tuple[int, int]]] = {}
    for word in range(max(len(words) - index.gram, 0) + 1):
        for template, place in index.places.get(tuple(words[word:word + index.gram]), ()):
            by_template.setdefault(template, []).append((word, place))
    found = []
    for template, hits in by_template.items():
        own, regions = index.words[template], []
        for word, place in hits:
            # Hits of one copy lie within its length and near its diagonal.
            if regions and word - regions[-1][0][0] <= len(own) + SLACK and abs(word - place - regions[-1][-1][0] + regions[-1][-1][1]) <= SLACK:
                regions[-1].append((word, place))
            else:
                regions.append([(word, place)])
        for region in regions:
            if len({p for _, p in region}) < SHARE * index.prints[template]:
                continue
            diagonals = [w - p for w, p in region]
            for matched, first, last in _matches(own, words, min(diagonals) - SLACK, max(diagonals) + SLACK, coverage):
                found.append((-matched, first, index.names[template], last, matched / len(own)))
    taken, out = [], []
    for negative, first, name, last, share in sorted(set(found)):
        if all(last <= a or b <= first for a, b in taken):
            taken.append((first, last))
            out.append((name, share, -negative, spans[first][0], spans[last - 1][1]))
    return sorted(out, key=lambda x: x[3])


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, coverage: float = COVERAGE, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """key, license, coverage, words, start, end, matched text; one row per match."""
    shared = docs.sparkSession.sparkContext.broadcast(build_index(TEMPLATES if templates is None else templates))  # bounded, see build_index

    def run(batches):
        index = shared.value
        for batch in batches:
            out = []
            for one, value in zip(batch["key"], batch["text"]):
                out.extend((one, *m, value[m[3]:m[4]]) for m in scan(value, index, coverage))
            yield pd.DataFrame(out, columns=["key", "license", "coverage", "words", "start", "end", "matched"])

    found = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInPandas(
        run, "key long, license string, coverage double, words long, start long, end long, matched string")
    return found.withColumnRenamed("key", key)
