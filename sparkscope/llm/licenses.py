"""Licence scan: matching statistics against a generalised suffix automaton of licence words."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.llm.kernels import binary_rows, word_hashes
from sparkscope.session import workers_see_package

# Base phrases and their labels.
PHRASES: dict[str, str] = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Characteristic passages of well-known licence texts, by label.
PASSAGES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "GNU Lesser General Public License",
    ),
    "agpl": (
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version",
        "GNU Affero General Public License",
    ),
    "gfdl": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
        "GNU Free Documentation License",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution",
        "licensed under a BSD style license",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
        "Mozilla Public License",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
        "Eclipse Public License",
    ),
    "cddl": ("Common Development and Distribution License",),
    "eupl": ("Licensed under the EUPL", "European Union Public Licence"),
    "artistic": ("under the terms of the Artistic License", "The intent of this document is to state the conditions under which a Package may be copied"),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "wtfpl": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",),
    "cc0": ("CC0 1.0 Universal", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1", "SIL Open Font License"),
    "psf": ("Python Software Foundation License",),
    "postgresql": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, "
        "and without a written agreement is hereby granted",
    ),
    "ms-pl": ("Microsoft Public License",),
    "odbl": ("made available under the Open Database License", "Open Data Commons Open Database License"),
}
# Identifiers of the SPDX list and the labels they stand for.
SPDX: dict[str, str] = {
    "MIT": "mit", "Apache-2.0": "apache", "GPL-2.0": "gpl", "GPL-3.0": "gpl", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "GFDL-1.3": "gfdl",
    "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "ISC": "isc", "MPL-2.0": "mpl", "EPL-1.0": "epl", "EPL-2.0": "epl", "CDDL-1.0": "cddl", "EUPL-1.2": "eupl",
    "Artistic-2.0": "artistic", "Zlib": "zlib", "BSL-1.0": "boost", "Unlicense": "unlicense", "WTFPL": "wtfpl", "CC0-1.0": "cc0", "OFL-1.1": "ofl",
    "PSF-2.0": "psf", "PostgreSQL": "postgresql", "MS-PL": "ms-pl", "ODbL-1.0": "odbl",
}
# Names by which licences are called for short, by label, and the versions that follow them.
_NAMED: dict[str, tuple[str, ...]] = {
    "mit": ("MIT", "MIT/X11", "Expat"), "apache": ("Apache 2", "Apache 2.0", "Apache-2", "ASL 2.0"), "bsd": ("BSD", "2-clause BSD", "3-clause BSD", "BSD 2-clause", "BSD 3-clause", "Simplified BSD", "New BSD", "Modified BSD"),
    "isc": ("ISC",), "zlib": ("zlib", "zlib/libpng"), "boost": ("Boost Software", "Boost"), "artistic": ("Artistic", "Perl Artistic"), "postgresql": ("PostgreSQL",), "psf": ("PSF",), "ofl": ("SIL Open Font", "Open Font"),
    "gpl": ("GPL", "GNU GPL"), "lgpl": ("LGPL", "GNU LGPL"), "agpl": ("AGPL", "GNU AGPL"), "gfdl": ("GFDL", "GNU FDL"), "mpl": ("MPL",), "epl": ("EPL",), "cddl": ("CDDL",), "eupl": ("EUPL",),
}
_VERSIONED: dict[str, tuple[str, ...]] = {"gpl": ("2", "3"), "lgpl": ("2", "2.1", "3"), "agpl": ("3",), "mpl": ("1.1", "2"), "epl": ("1", "2"), "eupl": ("1.1", "1.2")}
# The parts of Creative Commons licences in their spellings, the combinations and the versions.
_CC_PARTS = {
    "by": ("Attribution",), "nc": ("NonCommercial", "Non-Commercial"), "sa": ("ShareAlike", "Share Alike"), "nd": ("NoDerivatives", "NoDerivs"),
}
_CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")


def _templates() -> dict[str, tuple[str, ...]]:
    """All template texts by label: passages, SPDX tags, short names with "license" or a version, and Creative Commons names by their parts and versions."""
    out = {label: list(texts) for label, texts in PASSAGES.items()}
    for label, names in _NAMED.items():
        # the base phrases count by themselves
        out.setdefault(label, []).extend(t for n in names for t in (f"{n} license", f"{n} licence", f"{n} licensed", f"{n} licenced") if t.lower() not in PHRASES)
    for label, versions in _VERSIONED.items():
        for v in versions:
            out[label] += [f"{label}v{v}", f"{label} v{v}", f"{label} version {v}", f"GNU {label} {v}"]
    out["gpl"] += ["General Public Licence"]
    out["apache"] += ["Apache Software License", "Apache Licence"]
    for name, label in SPDX.items():
        out.setdefault(label, []).append(f"SPDX-License-Identifier: {name}")
    for kind in _CC_KINDS:
        names = [" ".join(x) for x in itertools.product(*(_CC_PARTS[p] for p in kind.split("-")))]
        texts = out.setdefault(f"cc-{kind}", [])
        for version in _CC_VERSIONS:
            texts += [f"CC {kind} {version}", *(f"Creative Commons {n} {version}" for n in names)]
    return {label: tuple(texts) for label, texts in out.items()}


TEMPLATES: dict[str, tuple[str, ...]] = _templates()
#: Shortest match in words that takes part in a chain, the widest hole in a chain, and the template share and words that earn its label; a shorter template has to be whole.
MIN_MATCH, MAX_GAP, MIN_COVER, MIN_WORDS = 3, 8, 0.6, 8


class SuffixAutomaton:
    """Suffix automaton of several word sequences; knows for each state where its strings end in them.

    Ends are kept once, in the order of a walk through the tree of suffix
    links, in which those of a state are one slice.
    """

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        own: dict[int, list[tuple[int, int]]] = {}
        for s, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                own.setdefault(last, []).append((s, i + 1))
        children: list[list[int]] = [[] for _ in self.link]
        for state in range(1, len(self.link)):
            children[self.link[state]].append(state)
        self._ends: list[tuple[int, int]] = []
        self._first, self._last = [0] * len(self.link), [0] * len(self.link)
        stack = [(0, False)]
        while stack:
            state, left = stack.pop()
            if left:
                self._last[state] = len(self._ends)
                continue
            self._first[state] = len(self._ends)
            self._ends += own.get(state, ())
            stack.append((state, True))
            stack += [(c, False) for c in children[state]]

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(sequence, end) of all places of a state's strings."""
        return self._ends[self._first[state] : self._last[state]]

    def _new(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q that holds only the strings reached from p."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def statistics(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            else:
                state = length = 0
            yield state, length


class Scanner:
    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, Sequence[str]], min_match: int, max_gap: int, min_cover: float, min_words: int = MIN_WORDS):
        self.min_match, self.max_gap, self.min_cover, self.min_words = min_match, max_gap, min_cover, min_words
        texts = [(p, label) for p, label in phrases.items()] + [(t, label) for label, many in templates.items() for t in many]
        hashed = [word_hashes(t.encode()).tolist() for t, _ in texts]
        known = sorted({h for seq in hashed for h in seq})
        ids = {h: i + 1 for i, h in enumerate(known)}
        self.known = np.array(known, np.uint64)
        self.labels = [label for _, label in texts]
        self.sizes = [len(seq) for seq in hashed]
        self.bases = len(phrases)
        self.machine = SuffixAutomaton([[ids[h] for h in seq] for seq in hashed])
        m = self.machine
        #: sequences that count only as a whole, wherever they stand: phrases and short templates
        self.whole = [s < self.bases or size < min_words for s, size in enumerate(self.sizes)]
        #: those among a state's strings: (length, sequence)
        self.finished = [
            [(end, s) for s, end in m.ends(at) if self.whole[s] and end == self.sizes[s] > 1 and m.length[m.link[at]] < end <= m.length[at]] if at else []
            for at in range(len(m.link))
        ]
        #: sequences of one word by that word; they are looked up without a walk
        self.single: dict[int, list[int]] = {}
        for s, seq in enumerate(hashed):
            if len(seq) == 1 and self.whole[s]:
                self.single.setdefault(ids[seq[0]], []).append(s)
        self.is_single = np.isin(np.arange(len(known) + 1), list(self.single))
        self.places: dict[int, dict[int, list[int]]] = {}
        self.shortest = min([min_match, *(size for size, whole in zip(self.sizes, self.whole, strict=True) if whole and size > 1)])

    def scan(self, text: bytes | None) -> dict:
        hashes = word_hashes(text)
        place = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        ids = np.where(self.known[place] == hashes, place + 1, 0) if len(self.known) and len(hashes) else np.zeros(len(hashes), np.int64)
        live = np.flatnonzero(ids)
        base: list[tuple[int, int]] = []
        short: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        for at in np.flatnonzero(self.is_single[ids]).tolist():
            for s in self.single[int(ids[at])]:
                (base if s < self.bases else short).append((at, s))
        if len(live):
            breaks = np.flatnonzero(np.diff(live) > 1)
            for a, b in zip(live[np.r_[0, breaks + 1]].tolist(), live[np.r_[breaks, len(live) - 1]].tolist(), strict=True):
                if b - a + 1 >= self.shortest:
                    self._run(ids[a : b + 1].tolist(), a, base, short, matches)
        whole = [{"label": self.labels[s], "start": at, "end": at + self.sizes[s], "cover": 1.0, "earned": True} for at, s in short]
        spans = sorted([*whole, *self._chains(matches)], key=lambda d: (d["start"], d["end"], d["label"]))
        starts = [at for at, _ in base]
        base_labels = sorted({self.labels[s] for _, s in base})
        earned = [s for s in spans if s.pop("earned")]
        labels = sorted({*base_labels, *(s["label"] for s in earned)})
        return {
            "n_words": len(hashes), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(base_labels), "labels": ",".join(labels),
            "score": 1.0 if base else max((s["cover"] for s in spans), default=0.0),
            "spans": earned,
        }

    def _run(self, ids: list[int], offset: int, base: list, short: list, matches: list) -> None:
        held = (0, 0, 0)
        for i, (state, length) in enumerate(self.machine.statistics(ids), offset + 1):
            at = state
            while at > 0:
                for size, s in self.finished[at]:
                    if size <= length:
                        (base if s < self.bases else short).append((i - size, s))
                at = self.machine.link[at]
            if held[2] >= self.min_match and length <= held[2]:
                matches.append(held)
            held = (i, state, length)
        if held[2] >= self.min_match:
            matches.append(held)

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Per licence text and place, the matches in order in both and close together, as one span."""
        open_: dict[int, list] = {}
        done = []

        def close(s: int) -> None:
            start, end, _, covered = open_.pop(s)
            size = self.sizes[s]
            earned = covered >= self.min_cover * size and covered >= min(size, self.min_words)
            done.append({"label": self.labels[s], "start": start, "end": end, "cover": min(1.0, covered / size), "earned": earned})

        for end, state, length in matches:
            if state not in self.places:
                places = self.places.setdefault(state, {})
                for s, e in sorted(self.machine.ends(state)):
                    places.setdefault(s, []).append(e)
            for s, ends in self.places[state].items():
                if self.whole[s]:
                    continue
                chain = open_.get(s)
                if chain is not None:
                    # the first place in the template past the chain's end keeps both orders
                    then = next((e for e in ends if e > chain[2]), None)
                    if then is not None and end - length - chain[1] <= self.max_gap:
                        fresh = min(length, end - chain[1], then - chain[2])
                        open_[s] = [chain[0], end, then, chain[3] + max(0, fresh)]
                        continue
                    close(s)
                open_[s] = [end - length, end, ends[0], length]
        for s in list(open_):
            close(s)
        return done


@lru_cache(maxsize=4)
def _scanner(phrases: tuple, templates: tuple, min_match: int, max_gap: int, min_cover: float, min_words: int) -> Scanner:
    return Scanner(dict(phrases), dict(templates), min_match, max_gap, min_cover, min_words)


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])
_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN)),
]


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    min_match: int = MIN_MATCH,
    max_gap: int = MAX_GAP,
    min_cover: float = MIN_COVER,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row per document: word and phrase counts, labels, score and covered template spans; no shuffle.

    Null and empty texts have no words, no labels and score 0; every place of a
    phrase counts, overlapping ones too; repeated rows are scanned alike; extra
    columns are ignored.
    """
    workers_see_package(docs.sparkSession)
    key = (tuple(phrases.items()), tuple((k, tuple(v)) for k, v in templates.items()), min_match, max_gap, min_cover, min_words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*key)
        for batch in batches:
            found = [scanner.scan(t) for t in binary_rows(batch, "text")]
            arrays = [pa.array([f[name] for f in found], kind) for name, kind in _FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *(n for n, _ in _FIELDS)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,start:long,end:long,cover:double>>",
    )
