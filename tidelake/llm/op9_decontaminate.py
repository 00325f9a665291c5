"""Benchmark decontamination: a broadcast set of test n-grams against all training windows."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidelake.llm import kernels as K
from tidelake.llm.exchange import carried
from tidelake.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# test text in one broadcast set; a larger test set is scanned for in several passes
SLICE_BYTES = 32 << 20
PIECE_BYTES = 1 << 20
# windows whose words a task remembers
KNOWN_WINDOWS = 100_000
HITS = "doc_id long, text string, spans array<struct<low:long,high:long>>, items array<string>"
KEPT = ["doc_id", "text", "spans", "items"]
SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "spans array<struct<low:long,high:long>>, clean_text string")


def pieces(batches, column="text", size=PIECE_BYTES):
    """The batches cut to about ``size`` bytes of text each, whole rows."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths.astype(np.int64)) // size
        cuts = K.group_starts(part)
        for low, high in zip(cuts, np.append(cuts[1:], batch.num_rows)):
            yield batch.slice(low, high - low)


class Grams:
    """The windows of test items: their sorted hashes and where they stand in the items' text.

    Flat arrays only: about 12 bytes a window beside 8 a word and the text itself, in memory as in the broadcast.
    Words are compared at the place in the text that a hash names.
    """

    def __init__(self, items, size):
        self.names = [name for name, _ in items]
        self.data, offsets = K.text_bytes(pa.array([text for _, text in items], pa.string()), lower=True)
        starts, ends, self.first = K.words(self.data, offsets, K.ALNUM)
        h, counts = K.span_hashes(self.data, starts, ends), np.diff(self.first)
        self.starts, self.ends = starts.astype(np.uint32), ends.astype(np.uint32)
        owner, self.tables = K.owners(self.first), {}
        for length in sorted({min(size, int(n)) for n in np.unique(counts) if n}):
            window = K.window_hashes(h, length)
            if length == size:
                at = np.flatnonzero(owner[:len(window)] == owner[length - 1:][:len(window)])
            else:
                at = self.first[:-1][counts == length]
            at = at[np.argsort(window[at], kind="stable")].astype(np.uint32)
            self.tables[length] = (window[at], at, self.sieve(window[at]))
        self.known = {}

    @staticmethod
    def sieve(keys):
        """A bit for the low bits of each hash: most windows are ruled out at once."""
        bits = max(16, int(len(keys) * 8).bit_length())
        table = np.zeros(1 << bits, dtype=bool)
        table[(keys & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        return np.packbits(table, bitorder="little")

    def texts(self, length, key):
        """{words: items} of the windows with a hash; looked at when first hit."""
        if (length, key) not in self.known:
            if len(self.known) >= KNOWN_WINDOWS:
                self.known.clear()
            keys, at, _ = self.tables[length]
            low, high = np.searchsorted(keys, [np.uint64(key)], side="left")[0], np.searchsorted(keys, [np.uint64(key)], side="right")[0]
            held = {}
            for p in at[low:high].tolist():
                name = self.names[int(np.searchsorted(self.first, p, side="right")) - 1]
                held.setdefault(joined(self.data, self.starts, self.ends, p, length), set()).add(name)
            self.known[length, key] = held
        return self.known[length, key]

    def hits(self, data, starts, ends, first, h):
        """(position, length, items) of every verified occurrence."""
        owner = K.owners(first)
        for length, (keys, _, sieve) in self.tables.items():
            window = K.window_hashes(h, length)
            bit = (window & np.uint64(8 * len(sieve) - 1)).astype(np.int64)
            at = np.flatnonzero(sieve[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            at = at[owner[at] == owner[at + length - 1]]
            at = at[K.lookup(window[at], keys) >= 0]
            for p in at.tolist():
                names = self.texts(length, int(window[p])).get(joined(data, starts, ends, p, length))
                if names is not None:
                    yield p, length, names


def joined(data, starts, ends, low, n):
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts[low:low + n], ends[low:low + n]))


def merged(spans):
    out = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def scan(frame, items, size, extra):
    """Add the spans (word numbers) and items that one slice of the test set hits."""
    grams = Grams(items, size)  # goes to every task with the function

    def run(batches):
        for batch in pieces(batches):
            data, offsets = K.text_bytes(batch.column("text"), lower=True)
            starts, ends, first = K.words(data, offsets, K.ALNUM)
            h = K.span_hashes(data, starts, ends)
            spans, names = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            found = {}
            for p, length, held in grams.hits(data, starts, ends, first, h):
                found.setdefault(int(np.searchsorted(first, p, side="right")) - 1, []).append((p, length, held))
            for i, hits in found.items():
                mine = [(s["low"], s["high"]) for s in spans[i]] + [(p - int(first[i]), p - int(first[i]) + n) for p, n, _ in hits]
                spans[i] = [{"low": low, "high": high} for low, high in merged(mine)]
                names[i] = sorted(set(names[i]).union(*(held for _, _, held in hits)))
            spans = pa.array(spans, batch.schema.field("spans").type)
            more = batch.schema.names[len(KEPT):]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), spans, pa.array(names, batch.schema.field("items").type),
                 *map(batch.column, more)], names=[*KEPT, *more])

    return frame.mapInArrow(run, HITS + extra)


def report(with_text):
    def run(batches):
        for batch in pieces(batches):
            data, offsets = K.text_bytes(batch.column("text"))
            starts, ends, first = K.words(data, offsets, K.ALNUM)
            spans, names = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            hit = [sum(s["high"] - s["low"] for s in own) for own in spans]
            texts = [None] * batch.num_rows
            if with_text:
                texts = batch.column("text").to_pylist()
                for i, own in enumerate(spans):
                    if own:
                        # a span goes from its first byte to its last, with what stands between its words
                        cuts = [(int(starts[first[i] + s["low"]]), int(ends[first[i] + s["high"] - 1])) for s in own]
                        edges = [int(offsets[i]), *(x for cut in cuts for x in cut), int(offsets[i + 1])]
                        texts[i] = b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])).decode()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(hit, pa.int64()),
                 pa.array([len(n) for n in names], pa.int64()),
                 pa.array([K.sha256(",".join(n).encode()) for n in names], pa.string()),
                 pa.array([n > 0 for n in hit], pa.bool_()), batch.column("spans"), pa.array(texts, pa.string()),
                 *map(batch.column, batch.schema.names[len(KEPT):])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "clean_text",
                       *batch.schema.names[len(KEPT):]])

    return run


def slices_of(benchmark, item_col, text_col, slice_bytes):
    """Slices of (item id as text, text), each of at most about ``slice_bytes`` of text."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("item IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # twice as many as needed: hashed slices are not equally large
    count = 1 if total <= slice_bytes else 2 * total // slice_bytes + 1
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(r["item"], r["text"]) for r in part.collect()]


def decontaminate(docs, benchmark, size=10, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
                  with_text=True, carry=(), slice_bytes=SLICE_BYTES):
    """Words of documents inside any window of ``size`` words of a test item.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lower-cased; an item with fewer words than ``size`` is one window. Test windows are
    broadcast as a hash set of at most about ``slice_bytes`` of text, larger test sets in
    passes; each hit is verified word by word. Returns doc_id, n_words, n_hit, n_items,
    items_sha256 (their ids, sorted as text, joined by commas), contaminated, spans (word
    numbers [low, high) of hit runs) and clean_text (the text without these spans; null
    unless ``with_text``), one row per input row. Null texts have no words and give a
    null clean_text; items without an id or text hit nothing. The columns in ``carry`` are
    returned in a struct ``carried``; others are not read.
    """
    row, extra = carried(docs, carry)
    none = F.expr("CAST(array() AS array<struct<low:long,high:long>>)")
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        none.alias("spans"), F.expr("CAST(array() AS array<string>)").alias("items"), *row)
    for k, items in enumerate(slices_of(benchmark, item_col, item_text_col, slice_bytes)):
        frame = scan(materialize(frame, "decontaminate") if k else frame, items, size, extra)
    return frame.mapInArrow(report(with_text), SCHEMA + extra)
