"""Substring dedup by difference-cover anchors."""

from __future__ import annotations

import sys
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from tidelake.llm import exchange as X
from tidelake.llm import kernels as K
from tidelake.llm import repeats

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: a perfect difference set; every distance modulo 31 is a difference of two members
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)


class CoverAnchors:
    """Anchors at word positions whose remainder modulo the period lies in a difference cover.

    Two equal windows at any two positions have a common offset below the period at which
    both positions are in the cover; an anchor of ``window - period + 1`` words fits behind it.
    """

    def __init__(self, window, period=PERIOD, cover=COVER):
        if window <= period:
            raise ValueError("the window must be longer than the period")
        if {(a - b) % period for a in cover for b in cover} != set(range(period)):
            raise ValueError("not a difference cover")
        self.period, self.cover, self.width = period, cover, window - period + 1

    # an anchor is long enough to be the only key of the windows around it
    parts = 1

    def keys(self, items, place, part):
        return items.once("anchors", lambda: K.window_hashes(items.h, self.width))[place]

    def fitting(self, items, place, part):
        return place

    def anchors(self, items, active):
        rest = (np.arange(len(items.h)) - items.offsets[items.owner]) % self.period
        chosen = np.isin(np.arange(self.period), self.cover)[rest]
        low, high = items.windows(active)
        # up to the last anchor inside the last window
        chosen &= K.covered(low, high + self.period - 1, len(items.h))
        place = np.flatnonzero(chosen)
        return place, self.keys(items, place, 0)

    def around(self, items, active, place, part):
        """(window starts, index of the anchor) of all windows that have one of the anchors in reach."""
        at = place[:, None] - np.arange(self.period)
        start = items.offsets[items.owner[place]]
        row, _ = np.nonzero(at >= start[:, None])
        return at[at >= start[:, None]], row

    def whole(self, items, at):
        return items.once("windows", lambda: K.window_hashes(items.h, items.window))[at]


def read_words(table, window):
    texts = table.column("text")
    data, offsets = K.text_bytes(texts)
    starts, ends, first = K.words(data, offsets)
    return texts, repeats.Items(K.span_hashes(data, starts, ends), first, X.ids_of(table)[0], window)


SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def dedup_passages(docs, window=50, id_col="doc_id", text_col="text", period=PERIOD, cover=COVER, with_text=True,
                   **sizes):
    """Remove every word inside a run of ``window`` words that also starts in a smaller id.

    Words are runs of non-blank characters, unchanged; kept words are joined by one space.
    Returns doc_id, n_words, n_removed, kept_text (null unless ``with_text``) and
    kept_sha256, one row per input row. Null and empty texts have no words. Rows without
    an id lose nothing and hold nothing for others; rows with equal ids do not remove each
    other's words, nor do repeats inside one document. Other columns are not read.
    """

    def finish(table, texts, items, removed):
        kept, gone, texts_out = [], [], []
        for i, text in enumerate(texts.to_pylist()):
            low, high = items.offsets[i], items.offsets[i + 1]
            split = (text or "").encode().split()
            drop = removed[low:high]
            gone.append(int(drop.sum()))
            clean = b" ".join(compress(split, ~drop) if gone[-1] else split)
            kept.append(K.sha256(clean))
            texts_out.append(clean.decode() if with_text else None)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": np.diff(items.offsets), "n_removed": pa.array(gone, pa.int64()),
                         "kept_text": pa.array(texts_out, pa.string()), "kept_sha256": pa.array(kept, pa.string())})

    return repeats.remove_repeats(docs, read_words, CoverAnchors(window, period, cover), finish, SCHEMA, window,
                                  id_col, text_col, **sizes)
