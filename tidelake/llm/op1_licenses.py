"""License scans: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidelake.llm import kernels as K
from tidelake.llm.op9_decontaminate import pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: public license notices
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
    "either express or implied. See the License for the specific language governing permissions and limitations under "
    "the License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "General Public License for more details.",
    "MIT": "Released under the MIT License.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.",
    "BSD-2-Clause notice": "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
    "ISC notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
    "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

GRAM, WINNOW, BAND = 3, 2, 6
TEMPLATE_BYTES = 8 << 20
MATCH, MISS, GAP = 2, -1, -1
SCHEMA = ("doc_id long, license string, matched long, template_words long, coverage double, first_word long, "
          "last_word long")


def winnow(h, size):
    """Positions of the smallest hash of every ``size`` neighbours (all of them in a tie)."""
    if len(h) <= size:
        return np.flatnonzero(h == h.min()) if len(h) else np.empty(0, dtype=np.int64)
    least = K.sliding(np.minimum, h, size)
    pad = np.zeros(size - 1, dtype=np.uint64)
    most = K.sliding(np.maximum, np.concatenate([pad, least, pad]), size)
    return np.flatnonzero(most == h)


class Index:
    """Fingerprint hash -> (template, position), as sorted arrays."""

    def __init__(self, templates, gram, size):
        self.names = sorted(templates)
        self.words, keys, held, place = [], [], [], []
        for i, name in enumerate(self.names):
            data, offsets = K.text_bytes(pa.array([templates[name]]), lower=True)
            h = K.span_hashes(data, *K.words(data, offsets, K.ALNUM)[:2])
            self.words.append(h)
            grams = K.window_hashes(h, gram)
            if len(h) and not len(grams):
                raise ValueError(f"template {name!r} has fewer than {gram} words")
            # every gram of a template is indexed: a text's fingerprints need not fall on the template's own
            keys.append(grams)
            held.append(np.full(len(grams), i))
            place.append(np.arange(len(grams)))
        keys, held, place = np.concatenate(keys), np.concatenate(held), np.concatenate(place)
        order = np.argsort(keys, kind="stable")
        self.keys, self.held, self.place = keys[order], held[order], place[order]

    def hits(self, h):
        """(index into h, template, place in the template) of every equal gram."""
        low, high = np.searchsorted(self.keys, h, side="left"), np.searchsorted(self.keys, h, side="right")
        n = high - low
        at = np.repeat(np.arange(len(h)), n)
        entry = np.repeat(low, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, self.held[entry], self.place[entry]


def align(text, template, low, high):
    """Best local alignment with diagonals (text place - template place) in [low, high].

    Returns (matched words, first and last matched place in the text).
    """
    width = high - low + 1
    # score, matches and first place of the best path into each cell of a row of the band
    above = [(0, 0, -1)] * (width + 1)
    best = (0, 0, -1, -1)
    for j in range(len(template)):
        row, left = [], (0, 0, -1)
        for d in range(width):
            i = j + low + d
            cell = (0, 0, -1)
            if 0 <= i < len(text):
                s, m, f = above[d]  # both step: the same diagonal
                if text[i] == template[j]:
                    cell = max(cell, (s + MATCH, m + 1, f if m else i), key=lambda c: c[0])
                else:
                    cell = max(cell, (s + MISS, m, f), key=lambda c: c[0])
                for s, m, f in (above[d + 1], left):  # a template word or a text word is skipped
                    if s + GAP > cell[0]:
                        cell = (s + GAP, m, f)
                if cell[0] > best[0] and text[i] == template[j]:
                    best = (cell[0], cell[1], cell[2], i)
            row.append(cell)
            left = cell
        above = row + [(0, 0, -1)]
    return best[1:]


def candidates(at, template, place, bands):
    """Groups of hits of one template near one diagonal: (template, lowest, highest diagonal)."""
    order = np.lexsort((at - place, template))
    at, template, place = at[order], template[order], place[order]
    diagonal = at - place
    new = np.ones(len(at), dtype=bool)
    new[1:] = (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > bands[template[1:]])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    return zip(template[heads], diagonal[heads], diagonal[tails])


def scan_licenses(docs, templates=None, min_coverage=0.8, gram=GRAM, size=WINNOW, band=BAND, id_col="doc_id", text_col="text"):
    """License notices in every document, with the matched share of the template and the span.

    Words are runs of letters and digits, A-Z lower-cased. The winnowed grams of a text
    are looked up in the inverted index of all template grams; hits near one diagonal
    make a candidate, which is aligned with the template inside a band of ``band`` words
    around it. One row per candidate whose matched words are at least ``min_coverage`` of
    the template: doc_id, license, matched, template_words, coverage, first_word and
    last_word (numbers of matched words of the text); of candidates that overlap for one
    template the best stays. Repeated notices give a row each, repeated rows of
    documents theirs. Null, empty and unlicensed texts give no row; a row without an id keeps
    the null. Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(t) for t in templates.values()) > TEMPLATE_BYTES:
        raise ValueError(f"templates of more than {TEMPLATE_BYTES} bytes are not broadcast; scan them in parts")
    spark = docs.sparkSession
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not templates:
        return spark.createDataFrame([], SCHEMA)
    index = Index(templates, gram, size)  # goes to every task with the function

    def run(batches):
        lengths = [len(w) for w in index.words]
        # narrower for short templates, so that notices one after the other stay apart
        bands = np.minimum(band, (np.array(lengths) - 1) // 2)
        for batch in pieces(batches):
            data, offsets = K.text_bytes(batch.column("text"), lower=True)
            starts, ends, first = K.words(data, offsets, K.ALNUM)
            h = K.span_hashes(data, starts, ends)
            grams = K.window_hashes(h, gram)
            owner = K.owners(first)
            whole = owner[:len(grams)] == owner[gram - 1:][:len(grams)]
            # a gram across two texts is never chosen over a real one
            prints = winnow(np.where(whole, grams, np.iinfo(np.uint64).max), size)
            prints = prints[whole[prints]]
            at, held, place = index.hits(grams[prints])
            at = prints[at]
            out = []
            for i in np.unique(owner[at]).tolist():
                mine = owner[at] == i
                text = h[first[i]:first[i + 1]]
                found = {}
                for t, low, high in candidates(at[mine] - first[i], held[mine], place[mine], bands):
                    # only the band around the candidate is looked at
                    low, high = int(low - bands[t]), int(high + bands[t])
                    base = max(0, low)
                    part = text[base:high + lengths[t]].tolist()
                    matched, head, tail = align(part, index.words[t].tolist(), low - base, high - base)
                    if matched >= min_coverage * lengths[t]:
                        found.setdefault(int(t), []).append((matched, head + base, tail + base))
                for t, spans in found.items():
                    kept = []
                    for matched, head, tail in sorted(spans, key=lambda s: (-s[0], s[1], s[2])):
                        if all(tail < a or head > b for _, a, b in kept):
                            kept.append((matched, head, tail))
                    out += [(batch.column("doc_id")[i].as_py(), index.names[t], m, lengths[t], m / lengths[t], a, b)
                            for m, a, b in sorted(kept, key=lambda s: s[1])]
            names = ["doc_id", "license", "matched", "template_words", "coverage", "first_word", "last_word"]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return frame.mapInArrow(run, SCHEMA)
