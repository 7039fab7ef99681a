"""License scan: MinHash bands over overlapping windows, then exact shingle containment.

Words are runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased;
shingles have five words. Texts and templates are cut into windows of ``WINDOW`` words
(``WINDOW_SHINGLES`` shingles); text windows start every ``STRIDE`` words, template windows
at every word, so some text window lies within a long template in full and a template of up
to ``WINDOW - STRIDE + 1`` words lies in some text window in full.

Each window has ``BANDS`` MinHash bands of one row. A text window retrieves the templates
that share a band with it. A window that holds m of its 12 shingles in common with a
template window collides with probability 1 - (1 - m/12) ** 64 at least: 0.996 for a single
shingle, above 0.99999 from two on.

Retrieved templates are verified exactly: around the windows, the places where the text has
shingles of the template are split into occurrences, and an occurrence counts when it holds
at least ``CONTAINMENT`` of the template's distinct shingles.

Templates are the notices in ``TEMPLATES`` and the whole texts in ``license_texts``, cut at
blank lines into sections of at least ``SECTION`` words, so that a body without its opening
has the hits of its other sections (``<license>-text``, one hit a section). Sections are
indexed by a window every ``STRIDE`` words: a text window inside one holds 8 shingles of some
template window at least.

One-line statements have too few shingles for a containment of 0.8 when one word differs, so
they are judged word by word: every place of a license's name (``NAMES``) is compared with
the ``STATEMENTS`` around that name, and ``CONTAINMENT`` of a statement's words must stand at
their places ("Released under the MIT License" holds 4 of the 5 words of "licensed under the
MIT License"). Of names that start at the same word the longest one counts.

Defined cases: NULL and empty texts, and texts of fewer than four words, have no hit; a
template that occurs several times has a hit each time; repeated rows give repeated hits; an
empty table gives no rows; extra columns are not read. Windows are cut from the joined texts
of an Arrow batch; a window across two texts retrieves, it is never a hit by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textstats import PUNCTUATION, SHINGLE, mix, shingles, utf8, words

WINDOW = 16
STRIDE = 8
WINDOW_SHINGLES = WINDOW - SHINGLE + 1
BLOCK = WINDOW_SHINGLES - STRIDE
BANDS = 64
CONTAINMENT = 0.8
CHUNK = 1 << 18
SECTION = 24
SOME_BITS = 20
HIT = "doc_id long, license string, start_word long, end_word long, containment double"

# Notices and the openings of well-known licenses, as published.
TEMPLATES = {
    "Apache-2.0-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions "
        "and limitations under the License."),
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation"),
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "BSD-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"),
    "ISC-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted"),
}

# Names of licenses in one-line statements.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0",
                   "Apache 2.0", "Apache 2.0 License", "Apache Software License 2.0",
                   "Apache Software License, Version 2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3",
                "GNU General Public License v3.0", "GNU General Public License 3.0",
                "GNU GPL version 3", "GNU GPL v3", "GNU GPLv3", "GPL version 3", "GPL v3", "GPLv3",
                "GPL 3.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2",
                "GNU General Public License v2.0", "GNU General Public License 2.0",
                "GNU GPL version 2", "GNU GPL v2", "GNU GPLv2", "GPL version 2", "GPL v2", "GPLv2",
                "GPL 2.0"),
    "GPL": ("GNU General Public License", "GNU GPL"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",
                 "GNU Affero General Public License v3", "GNU AGPL v3", "AGPLv3", "AGPL 3.0"),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "LGPL", "LGPL 2.1", "LGPL 3.0"),
    "MIT": ("MIT License",),
    "BSD": ("BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "2-Clause BSD License",
            "3-Clause BSD License", "new BSD License", "simplified BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0",
                "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0",
                "Eclipse Public License v2.0", "EPL 2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",
                        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",
                        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"),
}
IDENTIFIERS = {name: name for name in NAMES if name[-1].isdigit()} | {
    "MIT": "MIT", "ISC": "ISC", "BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD",
    "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0-only": "GPL-3.0",
    "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL", "LGPL-2.1-or-later": "LGPL",
    "LGPL-3.0-only": "LGPL", "LGPL-3.0-or-later": "LGPL"}
# What stands before a name; the verbs whose statement would miss 0.8 with another verb.
STATEMENTS = tuple(f"{verb} {link}" for verb in (
    "licensed", "released", "distributed", "published", "available", "provided")
    for link in ("under", "under the", "under a", "under the terms of the")) + (
    "governed by the", "subject to the terms of the", "dedicated to the public domain under")
IDENTIFIER = "SPDX-License-Identifier:"


def license_texts() -> list[tuple[str, str]]:
    """Sections of the whole license texts."""
    out = []
    for file in sorted(resources.files(__package__).joinpath("license_texts").iterdir(),
                       key=lambda f: f.name):
        if not file.name.endswith(".txt"):
            continue
        sections: list[str] = []
        for part in file.read_text(encoding="utf-8").split("\n\n"):
            if sections and len(sections[-1].split()) < SECTION:
                sections[-1] += "\n" + part
            else:
                sections.append(part)
        if len(sections) > 1 and len(sections[-1].split()) < SECTION:
            sections[-2] += "\n" + sections.pop()
        out += [(file.name.removesuffix(".txt") + "-text", x) for x in sections]
    return out


def _tokens(column: pa.Array):
    body, offs = utf8(column)
    _, hashes, upto = words(body, offs, PUNCTUATION)
    return hashes, upto


def _band_values(runs: np.ndarray, band: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((runs ^ mix(np.array([band + 1], np.uint64))[0])
                * np.uint64(0x9E3779B97F4A7C15 + 2 * band) >> np.uint64(32)).astype(np.uint32)


class Index:
    """Band values of all template windows, and the templates' shingles."""

    def __init__(self, templates: dict[str, str], sections: list[tuple[str, str]]) -> None:
        self.names, self.shingles, self.order = [], [], []
        pairs: list[set[tuple[int, int]]] = [set() for _ in range(BANDS)]
        every = [(*x, 1) for x in templates.items()] + [(*x, STRIDE) for x in sections]
        for name, text, step in every:
            hashes, _ = _tokens(pa.array([text]))
            runs = shingles(hashes)
            if not len(runs):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.names.append(name)
            sets, first = np.unique(runs, return_index=True)
            self.shingles.append(sets)
            self.order.append(first)
            last = max(0, len(runs) - WINDOW_SHINGLES)
            starts = [*range(0, last, step), last]
            for band in range(BANDS):
                least = np.lib.stride_tricks.sliding_window_view(
                    _band_values(runs, band), min(len(runs), WINDOW_SHINGLES)).min(1)[starts]
                pairs[band].update((v, len(self.names) - 1) for v in least.tolist())
        self.bands = []
        for own in map(sorted, pairs):
            values = np.array([v for v, _ in own], np.uint32)
            self.bands.append((values, np.array([t for _, t in own])))
        self.some: list[np.ndarray] = []

    def open(self) -> None:
        """Make, in the task, the tables of the values' first bits."""
        for values, _ in self.bands:
            some = np.zeros(1 << SOME_BITS, bool)
            some[values >> (32 - SOME_BITS)] = True
            self.some.append(some)

    def retrieve(self, runs: np.ndarray) -> list[np.ndarray]:
        """Per template the sorted numbers of the text windows that share a band."""
        blocks = -(-len(runs) // BLOCK)
        steps = STRIDE // BLOCK
        found: list[list[np.ndarray]] = [[] for _ in self.names]
        for band, ((values, owners), some) in enumerate(zip(self.bands, self.some)):
            own = np.full((blocks + 2) * BLOCK, 0xFFFFFFFF, np.uint32)
            own[:len(runs)] = _band_values(runs, band)
            least = own[::BLOCK]
            for k in range(1, BLOCK):
                least = np.minimum(least, own[k::BLOCK])
            least = np.minimum(np.minimum(least[:-2], least[1:-1]), least[2:])[::steps]
            maybe = np.flatnonzero(some[least >> (32 - SOME_BITS)])
            low = np.searchsorted(values, least[maybe], "left")
            high = np.searchsorted(values, least[maybe], "right")
            for w, a, b in zip(maybe[high > low], low[high > low], high[high > low]):
                for t in owners[a:b]:
                    found[t].append(w)
        return [np.unique(np.array(x, np.int64)) for x in found]


class Statements:
    """Statements of licenses, as word hashes, by the name that they hold."""

    def __init__(self) -> None:
        self.names: dict[tuple[int, ...], tuple[str, list[np.ndarray]]] = {}
        before = [_tokens(pa.array([x]))[0] for x in STATEMENTS]
        for license, names in NAMES.items():
            for name in names:
                self._add(license, name, before)
        before = [_tokens(pa.array([IDENTIFIER]))[0]]
        for name, license in IDENTIFIERS.items():
            self._add(license, name, before)

    def _add(self, license: str, name: str, before: list[np.ndarray]) -> None:
        core = tuple(_tokens(pa.array([name]))[0].tolist())
        self.names.setdefault(core, (license, []))[1].extend(before)

    def hits(self, hashes: np.ndarray, upto: np.ndarray) -> list[tuple]:
        """(text, license, first word, end word, part) of every place of a name that holds
        ``CONTAINMENT`` of a statement's words; per place the longest name counts."""
        out, taken = [], set()
        for core, (license, heads) in sorted(self.names.items(), key=lambda x: -len(x[0])):
            size = len(core)
            at = np.flatnonzero(hashes[:max(0, len(hashes) - size + 1)] == np.uint64(core[0]))
            for k in range(1, size):
                at = at[hashes[at + k] == np.uint64(core[k])]
            doc = np.searchsorted(upto, at, "right") - 1
            inner = at + size <= upto[doc + 1]
            at, doc = at[inner], doc[inner]
            if not len(at):
                continue
            best, first = np.zeros(len(at)), at.copy()
            for head in heads:
                same = np.zeros((len(head), len(at)), bool)
                for k, word in enumerate(head):
                    spot = at - len(head) + k
                    same[k] = (spot >= upto[doc]) & (hashes[np.maximum(spot, 0)] == word)
                part = (same.sum(0) + size) / (len(head) + size)
                begin = np.where(same.any(0), at - len(head) + same.argmax(0), at)
                better = (part > best) | (part == best) & (begin < first)
                best, first = np.where(better, part, best), np.where(better, begin, first)
            for x, d, a, part in zip(at.tolist(), doc.tolist(), first.tolist(), best.tolist()):
                if part >= CONTAINMENT and x not in taken:
                    taken.add(x)
                    out.append((d, license, a - int(upto[d]), x + size - int(upto[d]), part))
        return out


def _occurrences(at: np.ndarray, place: np.ndarray, length: int):
    """Split matched positions where the template starts over or a gap is too wide."""
    cut = np.flatnonzero((np.diff(place) <= 0) | (np.diff(at) > length)) + 1
    yield from zip(np.concatenate([[0], cut]), np.append(cut, len(at)))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, license, start_word, end_word (exclusive), containment`` of every hit
    (``templates``: only of these, instead of all notices, texts and statements)."""
    index = Index(templates or TEMPLATES, [] if templates else license_texts())
    statements = None if templates else Statements()

    def hits(hashes: np.ndarray, upto: np.ndarray) -> list[tuple]:
        out = statements.hits(hashes, upto) if statements else []
        runs = shingles(hashes)
        for a in range(0, len(runs), CHUNK):
            piece = runs[a:a + CHUNK + WINDOW]
            for t, windows in enumerate(index.retrieve(piece)):
                windows = windows[windows * STRIDE < CHUNK]
                if not len(windows):
                    continue
                sets, n = index.shingles[t], len(index.shingles[t])
                reach = max(index.order[t]) + WINDOW
                starts = windows * STRIDE + a
                low = np.maximum(starts - reach, 0)
                high = np.minimum(starts + WINDOW_SHINGLES + reach, len(runs))
                covered = np.zeros(high.max() - low[0] + 1, np.int32)
                np.add.at(covered, low - low[0], 1)
                np.add.at(covered, high - low[0], -1)
                near = np.flatnonzero(np.cumsum(covered[:-1]) > 0) + low[0]
                pos = np.minimum(np.searchsorted(sets, runs[near]), n - 1)
                same = sets[pos] == runs[near]
                at, pos = near[same], pos[same]
                doc = np.searchsorted(upto, at, "right") - 1
                inner = at + SHINGLE <= upto[doc + 1]
                at, pos, doc = at[inner], pos[inner], doc[inner]
                for d in np.unique(doc):
                    mine = doc == d
                    x, p = at[mine], index.order[t][pos[mine]]
                    for i, j in _occurrences(x, p, int(max(index.order[t])) + SHINGLE):
                        part = len(np.unique(p[i:j])) / n
                        if part >= CONTAINMENT:
                            out.append((int(d), index.names[t], int(x[i] - upto[d]),
                                        int(x[j - 1] + SHINGLE - upto[d]), part))
        return sorted(set(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index.open()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = hits(*_tokens(batch.column(1)))
            cols = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d in cols[0]], pa.int64()), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()),
                 pa.array(cols[4], pa.float64())],
                names=["doc_id", "license", "start_word", "end_word", "containment"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, HIT)
