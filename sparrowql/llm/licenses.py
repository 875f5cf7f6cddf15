"""License scans: winnowed template fingerprints, then banded alignment.

Templates are cut into word grams, and winnowing keeps the least hash of each
window of grams. The kept fingerprints form an inverted index (hash -> template,
offset). Every gram of a document is looked up; a hit points to a diagonal (where
the template would begin). Places with enough hits nearby are aligned in a band,
and matched words over the template's words are the coverage, reported from
``COVERAGE`` on with the spans of the matched runs.

Nothing within ``edits(n)`` word edits of a template of n words (a fifth) is
missed: one of edits + 1 equal pieces of it stays intact, so gram and window
are chosen such that together they are no longer than such a piece (4 words of
long templates, 2 of one of five words), and every edit spoils as many kept
grams as a gram has words, at most, which gives the least number of hits.
A match with a coverage of ``COVERAGE`` but more edits, through words put in, is
reported where it has these hits. Matches of one template don't overlap: the
best is taken, of equal ones the first; templates that overlap are all reported.

Null texts count as empty; repeated rows and null ids are rows like any other;
an empty table gives an empty result. Documents are only mapped; the templates
are a bounded parameter (``TEMPLATE_BYTES``), which tasks hold whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparrowql.llm.passages import Seeds, Vocabulary, align, gram_hashes, joined, word_spans, words
from sparrowql.llm.shared import slices, trimmed, with_fields

#: Words of a gram at most.
GRAM = 3
COVERAGE, EDITS = 0.8, 0.2
#: Text of all templates at most; a task holds them whole.
TEMPLATE_BYTES = 4_000_000

#: Notices by which licenses are granted, by SPDX name and form.
NOTICES: dict[str, str] = {
    "MIT/grant": "Released under the MIT License.",
    "Apache-2.0/grant": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0/grant": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0/grant": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/grant": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/grant": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0/notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0/notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "MPL-2.0/notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "LGPL/notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
}


def _texts() -> dict[str, str]:
    """The full texts that lie beside this module, by SPDX name."""
    found = resources.files("sparrowql.llm").joinpath("license_texts").iterdir()
    return {f"{f.name.removesuffix('.txt')}/text": f.read_text(encoding="utf-8") for f in sorted(found, key=lambda f: f.name)}


TEMPLATES = NOTICES | _texts()

#: (template, coverage, start, end, matched spans) in code points; a text's matches are sorted by start.
Match = tuple[str, float, int, int, list[tuple[int, int]]]


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the least hash of each window of hashes (the last of equals)."""
    if not len(hashes):
        return []
    spots = range(max(1, len(hashes) - window + 1))
    return sorted({max(range(i, min(i + window, len(hashes))), key=lambda k: (-int(hashes[k]), k)) for i in spots})


def edits(n: int) -> int:
    return int(n * EDITS)


class Templates:
    def __init__(self, templates: Mapping[str, str]):
        tokens = {name: words(text) for name, text in templates.items() if words(text)}
        self.names = list(tokens)
        self.vocabulary = Vocabulary(list(tokens.values()))
        self.codes = [self.vocabulary.encode(w) for w in tokens.values()]
        self.least_hits = []
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for p, code in enumerate(self.codes):
            intact = max(1, len(code) // (edits(len(code)) + 1))
            k = min(GRAM, intact)
            hashes = gram_hashes(code, k)
            kept = winnow(hashes, intact - k + 1)
            self.least_hits.append(max(1, len(kept) - k * edits(len(code))))
            entries.setdefault(k, []).extend((int(hashes[at]), p, at) for at in kept)
        self.index = [Seeds(e, k) for k, e in sorted(entries.items())]

    def find(self, text: str) -> list[Match]:
        """The matches of one text."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[str]) -> list[list[Match]]:
        """The matches of each text."""
        codes = [self.vocabulary.encode(words(text)) for text in texts]
        x, ends = joined(codes)
        places: dict[int, dict[int, list[list[int]]]] = defaultdict(dict)
        for index in self.index:
            found, hits = index.starts(x, ends)
            for rows in np.split(np.arange(len(found)), np.flatnonzero((np.diff(found[:, :2], axis=0) != 0).any(1)) + 1):
                if len(rows):
                    text, p = found[rows[0], :2].tolist()
                    if groups := self._groups(p, found[rows, 2], hits[rows]):
                        places[text][p] = groups
        return [self._matches(texts[k], codes[k], places[k]) if k in places else [] for k in range(len(texts))]

    def _groups(self, p: int, starts: np.ndarray, hits: np.ndarray) -> list[list[int]]:
        """Sorted starts that lie with enough hits within twice the edits, in groups as close to one another."""
        band = edits(len(self.codes[p]))
        before = np.concatenate([[0], np.cumsum(hits)])
        end = np.searchsorted(starts, starts + 2 * band, side="right")
        enough = np.flatnonzero(before[end] - before[:-1] >= self.least_hits[p])
        taken = np.zeros(len(starts) + 1, np.int64)
        np.add.at(taken, enough, 1)
        np.add.at(taken, end[enough], -1)
        starts = starts[np.cumsum(taken[:-1]) > 0]
        if not len(starts):
            return []
        return [x.tolist() for x in np.split(starts, np.flatnonzero(np.diff(starts) > 2 * band) + 1)]

    def _best(self, p: int, code: np.ndarray, starts: list[int]) -> Iterator[list[int]]:
        """Matched positions of the matches on the diagonals of a group: the best, and then those on either side of it."""
        n, band = len(self.codes[p]), edits(len(self.codes[p]))
        left = [starts]
        while left:
            starts = left.pop()
            _, matched, a, b = align(self.codes[p], code, starts[0] - band, starts[-1] + band)
            if len(matched) >= COVERAGE * n:
                yield matched
                # either is smaller, as a match is longer than three bands
                left += [x for x in ([s for s in starts if s + n - band <= a], [s for s in starts if s + band >= b]) if x]

    def _matches(self, text: str, code: np.ndarray, places: dict[int, list[list[int]]]) -> list[Match]:
        spans, found = word_spans(text), []
        for p, groups in sorted(places.items()):
            n = len(self.codes[p])
            best: list[list[int]] = []
            for matched in sorted((m for starts in groups for m in self._best(p, code, starts)), key=lambda m: (-len(m), m[0])):
                if all(matched[-1] < m[0] or matched[0] > m[-1] for m in best):
                    best.append(matched)
            for matched in best:
                runs = np.split(np.array(matched), np.flatnonzero(np.diff(matched) > 1) + 1)
                where = [(spans[r[0]][0], spans[r[-1]][1]) for r in runs]
                found.append((self.names[p], len(matched) / n, where[0][0], where[-1][1], where))
        return sorted(found, key=lambda x: (x[2], x[0]))


def license_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each match: id, ``license``, ``coverage``, ``start``, ``end``, ``spans`` (matched runs)."""
    templates = dict(templates)
    if sum(len(t.encode()) for t in templates.values()) > TEMPLATE_BYTES:
        raise ValueError(f"templates hold more than {TEMPLATE_BYTES} bytes")
    schema = with_fields(docs.select(id_col).schema, license="string", coverage="double", start="int", end="int", spans="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                rows = [(d, *x) for d, matches in enumerate(known.find_all(texts)) for x in matches]
                if not rows:
                    continue
                columns = [part.column(id_col).take(pa.array([r[0] for r in rows], pa.int64()))]
                for k, kind in ((1, pa.string()), (2, pa.float64()), (3, pa.int32()), (4, pa.int32())):
                    columns.append(pa.array([r[k] for r in rows], kind))
                columns.append(pa.array([",".join(f"{a}:{b}" for a, b in r[5]) for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), schema)
