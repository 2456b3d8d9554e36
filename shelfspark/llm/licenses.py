"""License scans (operator 10).

Five-word shingles of a document are MinHashed over overlapping windows.  Window sizes form a ladder (2, 4, 8, ...
shingles, each window half a size after the one before); a template of n shingles is looked for in the windows of
the smallest size of at least 2n, so each occurrence lies in one of them whole and the Jaccard similarity of window
and template is at least 1/4 (0.19 if a fifth of the template is changed).  With BANDS bands of one row the
chance to miss it is at most (1 - 0.25)^64 = 1e-8 (0.81^64 = 2e-6).  Retrieved windows are verified by exact shingle
containment: at least CONTAINMENT of the template's shingles must be in the window and its two neighbours.

Defined results: null and empty texts match nothing; overlapping finds of one template in a document count once,
with the largest containment; repeated rows are scanned each; no templates, no matches; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfspark.llm.arrays import LOWER, NOT_ALNUM, chunks, constants, ragged, shingles, word_hashes, words
from shelfspark.llm.common import bounded_batches

SHINGLE, BANDS, CONTAINMENT = 5, 64, 0.8
#: Short notices and opening paragraphs of public licenses (fixed texts).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
_ODD = constants(515, BANDS)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def doc_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    s, e, at = words(low, offsets, NOT_ALNUM)
    return shingles(word_hashes(low, s, e), at, SHINGLE)


class TemplateIndex:
    """Shingle sets of the templates and their MinHash values by window size."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.sets, by_size = [], {}
        for k, name in enumerate(self.names):
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            own = np.unique(doc_shingles(raw, np.array([0, len(raw)]))[0])
            self.sets.append(own)
            if len(own):
                by_size.setdefault(max(1, 1 << (len(own) - 1).bit_length()), []).append(k)
        #: half a window: (templates, their MinHash values, filter of leading bits)
        self.levels = {}
        for half, which in sorted(by_size.items()):
            values = np.stack([[(self.sets[k] * _ODD[b]).min() for b in range(BANDS)] for k in which])
            bits = np.zeros((BANDS, 1 << 16), bool)
            bits[np.arange(BANDS)[None, :], (values >> np.uint64(48)).astype(np.int64)] = True
            self.levels[half] = (np.array(which), values, bits)

    def scan(self, data: np.ndarray, offsets: np.ndarray, most_missing: bool = True) -> list[dict[int, float]]:
        """For each document its templates with their containment. most_missing: retrieve by MinHash; else try every window (for tests)."""
        values, at = doc_shingles(data, offsets)
        found: list[dict[int, float]] = [{} for _ in range(len(at) - 1)]
        if not len(values):
            return found
        candidates = set()
        if most_missing:
            # documents padded to whole blocks of every size, so that a level is the minima of neighbours of the one before
            whole = max(self.levels, default=1)
            room = -(-np.diff(at) // whole) * whole
            border = np.concatenate([[0], np.cumsum(room)])
            place = ragged(border[:-1], np.diff(at))
            empty = np.ones(int(border[-1]), bool)
            empty[place] = False
            empty = np.flatnonzero(empty)
            padded = np.zeros(int(border[-1]), np.uint64)
            padded[place] = values
            for b in range(BANDS):
                least, size = padded * _ODD[b], 1
                least[empty] = _MOST
                for half, (which, known, bits) in self.levels.items():
                    while size < half:
                        least, size = np.minimum(least[::2], least[1::2]), size * 2
                    maybe = np.flatnonzero(bits[b][(least >> np.uint64(48)).astype(np.int64)])
                    for i in maybe.tolist():
                        same = np.flatnonzero(known[:, b] == least[i]).tolist()
                        if not same:
                            continue
                        d = int(np.searchsorted(border, i * half, "right")) - 1
                        block = i - int(border[d]) // half
                        # the block is in the windows that start at it and at the one before; each must have this minimum
                        for w, other in ((block - 1, i - 1), (block, i + 1)):
                            inside = border[d] <= other * half < border[d + 1]
                            if w >= 0 and (not inside or least[other] >= least[i]):
                                candidates |= {(d, int(which[j]), w, half) for j in same}
        else:
            for half, (which, _, _) in self.levels.items():
                candidates |= {(d, int(k), w, half) for d in range(len(at) - 1) for w in range(-(-int(at[d + 1] - at[d]) // half)) for k in which}
        for d, k, w, half in candidates:
            region = values[max(at[d], at[d] + (w - 1) * half) : min(at[d + 1], at[d] + (w + 3) * half)]
            share = float(np.isin(self.sets[k], region).sum() / len(self.sets[k]))
            if share >= CONTAINMENT and share > found[d].get(k, 0):
                found[d][k] = share
        return found


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_licenses, licenses (names in order), best_containment of every row. Map only; the templates are a fixed small set."""
    bounded_batches(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        index = TemplateIndex(templates)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                found = index.scan(data, offsets)
                names = [[index.names[k] for k in sorted(f)] for f in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([max(f.values(), default=0.0) for f in found], pa.float64())], names=[key, "n_licenses", "licenses", "best_containment"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_licenses long, licenses array<string>, best_containment double")
