"""Operator 5: license scan. MinHash bands over overlapping windows retrieve templates; exact containment verifies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import mix, text_slices, word_hashes

#: License statements in common use, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
]
#: Punctuation that does not tell words apart here.
DROP = b",.;:!?\"'()[]{}#$%&*|<>~^_=+\\/`"
SHINGLE = 2


def plan_bands(jaccard: float, rows: int, guarantee: float) -> int:
    """Bands of ``rows`` hashes that meet sets of at least ``jaccard`` with probability ``guarantee``."""
    return int(np.ceil(np.log(1 - guarantee) / np.log(1 - jaccard**rows)))


class Scanner:
    """Templates by window size. A window of w shingles, one every w/4, holds every stretch of up to 3w/4 shingles
    whole; sizes double, so a template has at least 3/8 as many shingles as its window, and a match that holds the
    share c of them has a Jaccard similarity of (3c/8) / (1 + 3(1-c)/4) at least. The bands follow from that."""

    def __init__(self, templates: list[tuple[str, str]], containment: float, guarantee: float, seed: int):
        self.containment = containment
        self.names = [n for n, _ in templates]
        self.words = [word_hashes([t], DROP)[0] for _, t in templates]
        self.masks: list[dict[int, int]] = [{} for _ in templates]
        for masks, words in zip(self.masks, self.words, strict=True):
            for i, w in enumerate(words.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
        self.sets = [set(self.shingles(w).tolist()) for w in self.words]
        self.sizes = sorted({self.window(len(w)) for w in self.words})
        self.bands = plan_bands(0.375 * containment / (1 + 0.75 * (1 - containment)), 1, guarantee)
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(0, 1 << 62, self.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, self.bands, dtype=np.uint64)
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for size in self.sizes:
            own = [i for i, w in enumerate(self.words) if self.window(len(w)) == size]
            bands = []
            for b in range(self.bands):
                pairs = sorted((int(self.hashes(self.shingles(self.words[i]), b).min()), i) for i in own)
                keys = np.array([k for k, _ in pairs], dtype=np.uint64)
                marks = np.zeros(1 << 16, dtype=bool)
                marks[(keys >> np.uint64(48)).astype(np.int64)] = True
                bands.append((keys, np.array([i for _, i in pairs]), marks))
            self.tables[size] = bands

    @staticmethod
    def shingles(words: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(words[:-1] * np.uint64(0x2000002000367) + words[1:])

    @staticmethod
    def window(words: int) -> int:
        size = 4
        while 3 * size // 4 < words - 1:
            size *= 2
        return size

    def hashes(self, shingles: np.ndarray, band: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (shingles ^ self.shift[band]) * self.factor[band]

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, last word, containment) of every verified match, matches that overlap a better
        one left out."""
        flat, bounds = word_hashes(texts, DROP)
        if len(flat) < SHINGLE:
            return []
        # every document has a grid of its own, so what stands beside it does not move its windows
        counts = np.maximum(np.diff(bounds) - 1, 0)
        widest = max(self.sizes, default=4) // 4
        room = -(-counts // widest) * widest
        begins = np.cumsum(room) - room
        inside = np.repeat(begins - bounds[:-1], counts)
        word = np.arange(counts.sum()) + np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts)
        shingle, place = self.shingles(flat)[word], word + inside
        seen: set[tuple[int, int, int]] = set()
        found = []
        for b in range(self.bands):
            low, step = np.full(int(room.sum()), (1 << 64) - 1, dtype=np.uint64), 1
            low[place] = self.hashes(shingle, b)
            for size in self.sizes:
                while step < size // 4:  # minima over steps of size/4, doubled from size to size
                    low = np.minimum(low[0::2], low[1::2])
                    step *= 2
                least = low.copy()
                owner = np.repeat(np.arange(len(room)), room // step)
                for j in range(1, 4):
                    if len(low) > j:
                        np.minimum(least[:-j], low[j:], out=least[:-j], where=owner[:-j] == owner[j:])
                keys, owners, marks = self.tables[size][b]
                at = np.flatnonzero(marks[(least >> np.uint64(48)).astype(np.int64)])
                if not len(at):
                    continue
                spot = np.searchsorted(keys, least[at])
                good = (spot < len(keys)) & (keys[np.minimum(spot, len(keys) - 1)] == least[at])
                for w, s in zip(at[good].tolist(), spot[good].tolist(), strict=True):
                    key, doc = least[w], int(owner[w])
                    first = int(bounds[doc] + w * step - begins[doc])
                    while s < len(keys) and keys[s] == key:
                        t = int(owners[s])
                        s += 1
                        if (t, w, size) not in seen:
                            seen.add((t, w, size))
                            for got in self.verify(t, flat[first : min(first + size + 1, bounds[doc + 1])]):
                                found.append((doc, t, int(first - bounds[doc] + got[0]), int(first - bounds[doc] + got[1]), *got[2:]))
        found = sorted(set(found), key=lambda f: (f[0], -f[5], -f[4], -len(self.words[f[1]]), f[2], f[3], f[1]))
        out: list[tuple[int, int, int, int, float]] = []
        taken: dict[int, list[tuple[int, int]]] = {}
        for f in found:
            spans = taken.setdefault(f[0], [])
            if all(f[3] < a or f[2] > z for a, z in spans):
                spans.append((f[2], f[3]))
                out.append((int(f[0]), f[1], int(f[2]), int(f[3]), f[4]))
        return out

    def verify(self, template: int, words: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(first, last, containment, share of the template's words in order) of disjoint stretches that hold enough of
        the template's shingles: the stretch that resembles the template most in order, then those before and behind. A
        stretch is no longer than what some window of the grid is sure to hold whole."""
        own = self.sets[template]
        shingles = self.shingles(words).tolist()
        return self._stretches(template, words.tolist(), shingles, [i for i, h in enumerate(shingles) if h in own])

    def _stretches(self, template: int, words: list[int], shingles: list[int], places: list[int]) -> list[tuple[int, int, float, float]]:
        size, length = len(self.sets[template]), len(self.words[template])
        if len({shingles[i] for i in places}) < self.containment * size:
            return []
        masks, ones, widest = self.masks[template], (1 << length) - 1, 3 * self.window(length) // 4 + 1
        best = (-1.0, 0, 0, 0.0, 0.0)
        for k, first in enumerate(places):
            held: set[int] = set()
            v, at = ones, first  # common subsequence of words[first:at] by bit-parallel dynamic programming
            for last in places[k:]:
                if last + SHINGLE - first > widest:
                    break
                for word in words[at : last + SHINGLE]:
                    if m := masks.get(word):
                        v = ((v + (v & m)) | (v & ~m)) & ones
                at = last + SHINGLE
                held.add(shingles[last])
                if len(held) >= self.containment * size:
                    common = length - v.bit_count()
                    score = common / (length + at - first - common)
                    if score > best[0]:
                        best = (score, first, at - 1, len(held) / size, common / length)
        _, first, last, share, ordered = best
        if not share:
            return []
        before = self._stretches(template, words, shingles, [i for i in places if i + SHINGLE <= first])
        behind = self._stretches(template, words, shingles, [i for i in places if i > last])
        return [*before, (first, last, share, ordered), *behind]


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = 0.85, guarantee: float = 0.9999, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License statements in the whole texts of ``docs``: (id_col, license string, template int, first_word long,
    last_word long, containment double), one row for each place.

    Words are compared without case (A-Z) and without ASCII punctuation but the hyphen. A place holds at least
    ``containment`` of the template's two-word shingles and is the stretch of its window that resembles the template
    most, so that statements side by side are places each; of places that overlap the one stays that holds the largest share
    of its template's words in order. Templates of fewer than
    two words are refused. Windows meet templates with probability ``guarantee`` or more. One pass, no shuffle. Null, empty and
    blank texts hold nothing; repeated rows give repeated rows; an empty table or no templates give an empty result;
    other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    if any(len(word_hashes([text], DROP)[0]) < SHINGLE for _, text in templates):
        raise ValueError("a template needs two words at least")
    scanner_args = (templates, containment, guarantee, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*scanner_args)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, stop in text_slices(batch, "text"):
                found = scanner.find(batch.column(1).slice(start, stop - start).to_pylist())
                if found:
                    doc, template, first, last, share = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[start + i] for i in doc], pa.int64()), pa.array([scanner.names[t] for t in template]), pa.array(template, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(share, pa.float64())], names=["id", "license", "template", "first_word", "last_word", "containment"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, license string, template int, first_word long, last_word long, containment double").withColumnRenamed("id", id_col)
