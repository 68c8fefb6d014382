"""License notices in documents: MinHash bands over overlapping text windows.

Words are runs of ASCII letters and digits, lower-cased. A template of n words has
shingles of five words (of all its words, if it has fewer). An occurrence is a passage of
at most 2n words that holds at least 0.8 of the template's shingles, however many words
were put between them and wherever it stands; passages of one template that overlap are
one occurrence.

Windows start every ``n // 4`` words and have ``2n + n // 4`` words, so each occurrence
lies whole in one of them. Template and window then have a Jaccard similarity of about
``0.8 / 2.45`` at least, for a template of six words 0.22 (``least_similarity``). With 48
bands of one value such a window shares no band with its template with probability
``(1 - 0.22)^48`` at most, below 1e-5. A window that holds fewer
template shingles than the least occurrence needs is not signed; this loses nothing.
Templates that share a band are verified by the exact containment of their shingles, as
words.

Sibling licenses have templates of their own. Where occurrences of different licenses
overlap, the one contained best is kept (of equals the longer template, then the name).
Templates of fewer than ``NOTICE_WORDS`` words are mentions: they name a license, or rights,
in passing, are counted apart and yield to notices.

Defined cases: null and empty texts, and an empty table, hold no license. Rows that repeat
and null ids are judged alike; other columns are ignored. A text may have any length and
any number of licenses; all are reported.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, replace
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import ready
from tripweave.llm.shingles import Signer, WordHashes, mix, windows

SHINGLE = 5
CONTAINED = 0.8
BANDS, BAND_ROWS = 48, 1
#: Words of a template that is a notice; shorter ones are mentions.
NOTICE_WORDS = 12
#: Words of an occurrence, in those of the template.
STRETCH = 2
_WORD = re.compile(r"[a-z0-9]+")

# Notices of common licenses.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero"
        " General Public License as published by the Free Software Foundation, either version 3 of the License,"
        " or (at your option) any later version",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0",),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
    ),
    "CC0-1.0": ("Released into the public domain under CC0 1.0",),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation; either version 2 of the License,"
        " or (at your option) any later version",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation, either version 3 of the License,"
        " or (at your option) any later version",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation; either version 2.1 of the License,"
        " or (at your option) any later version",
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation, either version 3 of the License,"
        " or (at your option) any later version",
    ),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL"
        " was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    "reserved": ("All rights reserved",),
}


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]
    shingle: int
    step: int
    reach: int  # words of a window

    @cached_property
    def shingles(self) -> frozenset[tuple[str, ...]]:
        return _tuples(self.words, self.shingle)

    @property
    def longest(self) -> int:
        """Words of an occurrence, at most. One shingle has no room between its words."""
        return len(self.words) * (STRETCH if len(self.words) > self.shingle else 1)


class Match(NamedTuple):
    license: str
    start: int
    end: int
    share: float
    words: int  # of the template

    @property
    def notice(self) -> bool:
        return self.words >= NOTICE_WORDS


def _tuples(words, size: int) -> frozenset[tuple[str, ...]]:
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def _templates(texts: dict[str, tuple[str, ...]]) -> list[Template]:
    out = []
    for name, notices in texts.items():
        for notice in notices:
            words = tuple(_WORD.findall(notice.lower()))
            step = max(1, len(words) // 4)
            t = Template(name, words, min(SHINGLE, len(words)), step, 0)
            out.append(replace(t, reach=t.longest + step))
    return out


def least_similarity(t: Template, contained: float = CONTAINED) -> float:
    """Least Jaccard similarity of a template and a window with an occurrence in it."""
    own, window = len(t.shingles), t.reach - t.shingle + 1
    shared = math.ceil(contained * own - 1e-9)
    return shared / (own + window - shared)


class Scanner:
    """Templates by band key, for windows of one text after the other."""

    def __init__(self, texts: dict[str, tuple[str, ...]] = TEMPLATES, contained: float = CONTAINED):
        self.contained = contained
        self.templates = _templates(texts)
        self.hashes, self.sign = WordHashes(), Signer(BANDS * BAND_ROWS, seed=5)
        self.known: dict[int, np.ndarray] = {}  # hashes of template shingles, by shingle size
        self.table: dict[int, np.ndarray] = {}  # which leading 16 bits they have
        self.bands: dict[tuple[int, int, int], dict[int, list[Template]]] = {}
        self.needed: dict[tuple[int, int, int], int] = {}  # template shingles of an occurrence, at least
        for size in {t.shingle for t in self.templates}:
            every = [self._hashed(list(t.words), size) for t in self.templates if t.shingle == size]
            self.known[size] = np.unique(np.concatenate(every))
            self.table[size] = np.zeros(1 << 16, dtype=bool)
            self.table[size][(self.known[size] >> np.uint64(48)).astype(int)] = True
        for t in self.templates:
            keys = self._keys(self._hashed(list(t.words), t.shingle))
            shape = (t.shingle, t.step, t.reach)
            held = self.bands.setdefault(shape, {})
            self.needed[shape] = min(self.needed.get(shape, len(t.words)), self._need(t))
            for key in keys:
                held.setdefault(int(key), []).append(t)

    def _hashed(self, words: list[str], size: int) -> np.ndarray:
        return windows(self.hashes([w.encode() for w in words]), size)

    def _keys(self, shingles: np.ndarray) -> np.ndarray:
        signed = self.sign(shingles).astype(np.uint64).reshape(BANDS, BAND_ROWS)
        key = np.arange(BANDS, dtype=np.uint64)
        for i in range(BAND_ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signed[:, i])
        return key

    def _need(self, t: Template) -> int:
        """Distinct shingles of an occurrence, at least."""
        return math.ceil(self.contained * len(t.shingles) - 1e-9)

    def scan(self, text: str) -> list[Match]:
        """Occurrences by place: first word, word after the last, containment."""
        words = _WORD.findall(text.lower())
        hashes = self.hashes([w.encode() for w in words])
        made: dict[int, np.ndarray] = {}
        found: dict[Template, set[tuple[int, int]]] = {}
        hits: dict[int, np.ndarray] = {}
        for (size, step, reach), bands in self.bands.items():
            if len(words) < size:
                continue
            shingles = windows(hashes, size, made)
            if size not in hits:
                near = np.flatnonzero(self.table[size][(shingles >> np.uint64(48)).astype(np.int64)])
                hits[size] = near[np.isin(shingles[near], self.known[size])]
            here = hits[size]
            if not len(here):
                continue
            # Starts, in steps, of the windows that hold a hit.
            width = reach - size + 1
            first = -(-np.maximum(here - width + 1, 0) // step)
            each = np.arange(width // step + 2)[None, :] + first[:, None]
            starts = np.unique(each[each * step <= here[:, None]]) * step
            held = np.searchsorted(here, starts + width) - np.searchsorted(here, starts)
            for start in starts[held >= self.needed[size, step, reach]].tolist():
                keys = self._keys(shingles[start : start + width])
                for t in {t for k in keys.tolist() for t in bands.get(k, ())}:
                    found.setdefault(t, set()).update(self._verified(words, start, reach, t))
        matches = [m for t, spans in found.items() for m in self._merged(words, t, spans)]
        return _best(matches)

    def _verified(self, words: list[str], start: int, reach: int, t: Template) -> list[tuple[int, int]]:
        """The least passages of a window that hold enough of the template."""
        part, need = words[start : start + reach], self._need(t)
        places: list[tuple[int, tuple[str, ...]]] = []
        for i in range(len(part) - t.shingle + 1):
            shingle = tuple(part[i : i + t.shingle])
            if shingle in t.shingles:
                places.append((i, shingle))
        out, held, left = [], Counter(), 0
        for i, shingle in places:
            held[shingle] += 1
            while held[places[left][1]] > 1:
                held[places[left][1]] -= 1
                left += 1
            if len(held) >= need:
                first = places[left][0]
                if i + t.shingle - first <= t.longest:
                    out.append((start + first, start + i + t.shingle))
                del held[places[left][1]]
                left += 1
        return out

    def _merged(self, words: list[str], t: Template, spans: set[tuple[int, int]]) -> list[Match]:
        """Overlapping passages as one, with what it holds of the template."""
        joined: list[list[int]] = []
        for a, b in sorted(spans):
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        share = lambda a, b: len(_tuples(words[a:b], t.shingle) & t.shingles) / len(t.shingles)
        return [Match(t.license, a, b, share(a, b), len(t.words)) for a, b in joined]


def _best(matches: list[Match]) -> list[Match]:
    """Of overlapping matches the best contained one, by place."""
    kept: list[Match] = []
    for m in sorted(matches, key=lambda m: (not m.notice, -m.share, -m.words, m.license, m.start)):
        if all(m.end <= k.start or k.end <= m.start for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m.start)


def report(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    contained: float = CONTAINED,
) -> DataFrame:
    """One row per document: doc_id, n_matches, licenses (names found by a notice,
    comma-joined), spans (license:first word:end word, comma-joined), least (smallest
    containment; null if none), n_mentions and mentions (names found by a short phrase)."""
    ready(docs.sparkSession)
    held: list[Scanner] = []  # one for each Python worker, made at its first batch

    def names(found: list[Match]) -> str:
        return ",".join(sorted({f.license for f in found}))

    def judge(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Scanner(templates, contained))
        rows = []
        for t in texts:
            found = held[0].scan(t or "")
            notices, mentions = [f for f in found if f.notice], [f for f in found if not f.notice]
            rows.append(
                (
                    len(notices),
                    names(notices),
                    ",".join(f"{f.license}:{f.start}:{f.end}" for f in found),
                    min((f.share for f in found), default=None),
                    len(mentions),
                    names(mentions),
                )
            )
        return pd.DataFrame(rows, columns=["n_matches", "licenses", "spans", "least", "n_mentions", "mentions"])

    shape = "n_matches long, licenses string, spans string, least double, n_mentions long, mentions string"
    judged = F.pandas_udf(judge, shape)
    return docs.select(F.col(doc_id).alias("doc_id"), judged(F.col(text)).alias("found")).select("doc_id", "found.*")
