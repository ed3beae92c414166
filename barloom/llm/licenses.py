"""License scans: MinHash bands over text windows, then exact shingle containment (operator 4).

Each document is cut into overlapping windows as long as a template (in words);
windows begin at every ``step`` words, a quarter of the template's shingles, so
some window holds a copy of the template up to that shift. A window retrieves the
templates that agree with it in one of ``BANDS`` MinHash bands of ``ROWS`` slots;
a pair of similarity 0.6, the least that a template's own window can have at that
shift, is missed with probability below (1 - 0.36) ** 24, about 2 in 100,000. Of
the retrieved, a match has at least ``threshold`` of the template's ``SHINGLE``
-word shingles in the window and its margin. Windows without any shingle of a
template cannot match, so only those with one are hashed.

Words are lower-cased and cut at ASCII white space, without punctuation at their
ends. Cases: a null or empty text, or one without words, matches nothing; a
template with fewer words than a shingle has to occur whole; a null id is
reported as null; rows with equal ids are scanned one by one; other columns are
not read; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import GOLD, LOWER, WHITE, mix, shingles, slabs, span_hash, text_column, words

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 2
# Short public notices by which works state their license.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-rights-reserved": "All rights reserved.",
}
_WORD = LOWER.copy()
_WORD[WHITE] = 32
_WORD[[ord(c) for c in ".,;:!?()\"'[]"]] = 32


def _words(column):
    """Yields (first row, row after the last, word hashes, offsets of each text's)."""
    for i, j, data, at in slabs(column):
        clean = _WORD[data]
        starts, ends, first = words(clean, at)
        yield i, j, span_hash(clean, starts, ends), first


def _bands(sets: list) -> np.ndarray:
    """BANDS keys of the MinHash signature of each set of shingles."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    flat, out = np.concatenate(sets), []
    for band in range(BANDS):
        key = np.full(len(sets), (band + 1) * 0x9E37, np.uint64)
        for r in range(ROWS):
            seed = np.uint64((band * ROWS + r + 1) * int(GOLD) & (2**64 - 1))
            key = mix(key + np.minimum.reduceat(mix(flat ^ seed), at[:-1]))
        out.append(key)
    return np.stack(out, 1)


class Templates:
    def __init__(self, notices: dict[str, str]):
        self.names, self.sets, self.words = [], [], []
        names = sorted(notices)
        for i, _, h, at in _words(pa.array([notices[n] for n in names])):
            for k in range(len(at) - 1):
                own = h[at[k] : at[k + 1]]
                if len(own):
                    self.names.append(names[i + k])
                    self.words.append(len(own))
                    self.sets.append(np.unique(shingles(own, np.array([0, len(own)]), min(SHINGLE, len(own)))[0]))
        self.any = np.unique(np.concatenate(self.sets))
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.any & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.buckets: dict = {}
        for t, keys in enumerate(_bands(self.sets)):
            for key in keys.tolist():
                self.buckets.setdefault(key, set()).add(t)

    def matches(self, h: np.ndarray, at: np.ndarray, threshold: float):
        """Yields (text, template, containment, first word, copies) of the templates found in texts."""
        marked: dict[int, list] = {}
        shingled = {}
        for m in sorted({min(SHINGLE, n) for n in self.words}):
            s, where = shingled[m] = shingles(h, at, m)
            look = np.flatnonzero(self.sieve[(s & np.uint64(0xFFFF)).astype(np.int64)])
            look = look[np.isin(s[look], self.any)]
            text = np.searchsorted(where, look, "right") - 1
            for t, p in zip(text.tolist(), (look - where[text]).tolist()):
                marked.setdefault(t, []).append((m, p))
        for text, hits in marked.items():
            best: dict[int, list] = {}
            for size in sorted(set(self.words)):
                m = min(SHINGLE, size)
                places = np.array([p for k, p in hits if k == m], np.int64)
                if not len(places):
                    continue
                s, where = shingled[m]
                own = s[where[text] : where[text + 1]]
                width = size - m + 1
                step = max(1, width // 4)
                low = np.maximum(places - width + 1, 0)
                starts = np.unique(np.concatenate([low - low % step + k * step for k in range(0, width // step + 2)]))
                starts = starts[starts < len(own)]
                windows = [np.unique(own[a : a + width]) for a in starts.tolist()]
                for a, keys in zip(starts.tolist(), _bands(windows).tolist()):
                    for t in set().union(*(self.buckets.get(k, ()) for k in keys)):
                        if self.words[t] != size:
                            continue
                        part = own[max(0, a - step) : a + width + step]
                        inside = np.isin(part, self.sets[t])
                        share = len(np.unique(part[inside])) / len(self.sets[t])
                        if share >= threshold:
                            first = max(0, a - step) + int(np.flatnonzero(inside)[0])
                            best.setdefault(t, []).append((first, share))
            for t, found in best.items():
                found.sort()
                copies, end = 0, -1
                for first, _ in found:
                    if first > end:
                        copies, end = copies + 1, first + self.words[t] - 1
                yield text, t, max(x for _, x in found), found[0][0], copies


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, first_word, copies) of each template found in a row of docs."""

    def run(batches):
        templates = Templates(notices)
        for b in batches:
            rows, found = [], []
            for i, _, h, at in _words(text_column(b.column(1))):
                for text, t, share, first, copies in templates.matches(h, at, threshold):
                    rows.append(i + text)
                    found.append((templates.names[t], share, first, copies))
            if rows:
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(columns[0]), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=[id_col, "license", "containment", "first_word", "copies"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, license string, containment double, first_word long, copies long")
