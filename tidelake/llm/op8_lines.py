"""Line dedup: hash ranges with the documents of a line in order, answered by keep bitmaps."""

from __future__ import annotations

import sys
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from tidelake.llm import exchange as X
from tidelake.llm import kernels as K

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "doc_id long, n_lines long, n_dropped long, keep binary, kept_text string, kept_sha256 string"
NEWLINE = 10


def line_spans(data, offsets):
    """(starts, ends, first line of each text and the total); an empty text has one empty line."""
    breaks = np.flatnonzero(data == NEWLINE)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    # an empty text shares its offset with its neighbour: the owner decides, then the place
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = ends[np.lexsort((ends, owner[np.argsort(order)]))]
    return starts, ends, np.searchsorted(owner, np.arange(len(offsets)))


def line_keys(data, offsets, shortest):
    """(hash of each line's key, mask of lines long enough, first line of each text)."""
    starts, ends, first = line_spans(data, offsets)
    solid = np.flatnonzero(K.WORD[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = high > low
    begin, end = starts.copy(), starts.copy()
    begin[some], end[some] = solid[low[some]], solid[high[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    h = K.span_hashes(K.LOWER[data], begin, end)
    return h, points[end] - points[begin] >= shortest, first


def bitmap(keep):
    """A document's kept lines, one bit each in line order, compressed."""
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(text, keep):
    """The text that a keep bitmap leaves of a text."""
    lines = (text or "").split("\n")
    return "\n".join(compress(lines, np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))))


def dedup_lines(docs, min_chars=20, min_docs=3, id_col="doc_id", text_col="text", with_text=True, carry=(), **sizes):
    """Drop lines whose key is in ``min_docs`` documents, but not from the largest id.

    A key is a line without blanks at both ends, A-Z lower-cased; keys below ``min_chars``
    code points stay everywhere. Hashes go to hash ranges with their documents; inside a
    range they are ordered by hash and descending id, so the first of each hash is the
    document that keeps the line. Returns doc_id, n_lines, n_dropped, keep (a compressed
    bitmap, see ``kept_lines``), kept_text (null unless ``with_text``) and kept_sha256, one
    row per input row. Null and empty texts have one empty line. Rows without an id
    keep all lines and count for none; rows with equal ids are one document. The columns
    in ``carry`` are returned in a struct ``carried``; others are not read.
    """
    extra, extra_schema = X.carried(docs, carry)
    frame, buckets, _ = X.blocks(docs, id_col, text_col, keep=extra, **sizes)

    def send(block, table):
        ids, active = X.ids_of(table)
        h, long, first = line_keys(*K.text_bytes(table.column("text")), min_chars)
        owner = K.owners(first)
        use = long & active[owner]
        h, doc = h[use], ids[owner[use]]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        cuts = K.group_starts(h)
        if not len(h):
            return []
        new = np.ones(len(h), dtype=np.uint64)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        largest = doc[np.append(cuts[1:], len(h)) - 1]
        return X.to_buckets(block, 1, buckets, h[cuts], largest, np.add.reduceat(new, cuts))

    def choose(bucket, table):
        src, h, x, y = X.gather(table, 1)
        if not len(h):
            return []
        order = np.lexsort((~x.view(np.int64), h))  # ~id: descending
        cuts = K.group_starts(h[order])
        sizes = np.diff(np.append(cuts, len(h)))
        keeper = np.repeat(x[order][cuts], sizes)
        common = np.repeat(np.add.reduceat(y[order], cuts) >= min_docs, sizes)
        return X.back(bucket, 1, src[order][common], h[order][common], keeper[common])

    def drop(block, table, found):
        ids, active = X.ids_of(table)
        data, offsets = K.text_bytes(table.column("text"))
        h, long, first = line_keys(data, offsets, min_chars)
        _, common, keeper, _ = X.gather(found, 1)
        order = np.argsort(common, kind="stable")
        owner = K.owners(first)
        at = K.lookup(h, common[order])
        keep = np.ones(len(h), dtype=bool)
        if len(common):
            keep = ~((at >= 0) & long & active[owner] & (ids[owner] < keeper.view(np.int64)[order][at]))
        bitmaps, texts, hashes, dropped = [], [], [], []
        for i in range(len(ids)):
            own = keep[first[i]:first[i + 1]]
            text = data[offsets[i]:offsets[i + 1]].tobytes()
            dropped.append(int((~own).sum()))
            if dropped[-1]:
                text = b"\n".join(compress(text.split(b"\n"), own))
            bitmaps.append(bitmap(own))
            hashes.append(K.sha256(text))
            texts.append(text.decode() if with_text else None)
        out = {"doc_id": table.column("doc_id"), "n_lines": np.diff(first), "n_dropped": pa.array(dropped, pa.int64()),
               "keep": pa.array(bitmaps, pa.binary()), "kept_text": pa.array(texts, pa.string()),
               "kept_sha256": pa.array(hashes, pa.string())}
        return pa.table(out | ({"carried": table.column("carried")} if carry else {}))

    return X.answer(frame, X.resolve(X.emit(frame, send), choose), drop, SCHEMA + extra_schema)
