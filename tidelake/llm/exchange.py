"""Blocks of documents that ask a question of the whole table and get the answer back.

Many operators have one shape: each document derives keys (hashes of words, lines,
windows), what matters is who else holds a key, and the answer changes the document.
Here a *block* (a hashed group of documents of about ``BLOCK_BYTES``) sends one row per
*bucket* (a range of the hash space) with its distinct keys, so equal keys inside a
block are combined before the shuffle; buckets resolve keys and answer blocks, and
blocks are cogrouped with their answers. A key that a third of all documents holds
costs one entry per block, so no task gets a hot group of rows. The shuffle of
documents by block is planned once and reused by every step of a query.

Rows between blocks and buckets hold whole arrays, packed by ``kernels.pack``:
``key`` (bucket or block to go to), ``src`` (where it comes from), ``kind``, ``n``, and
the packed columns ``h`` (ascending), ``x`` and ``y``.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidelake.llm import kernels as K

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 1 << 19
BUCKET_BYTES = 1 << 23
MIN_BUCKETS = 64

MESSAGE = "key long, src long, kind int, n int, h binary, x binary, y binary"
ARROW = pa.schema([("key", pa.int64()), ("src", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()),
                   ("h", pa.binary()), ("x", pa.binary()), ("y", pa.binary())])


def small_batches(spark):
    """Bound an Arrow batch by bytes, not only by rows: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def carried(docs, names):
    """The named columns as one struct ``carried``, with its schema text; nothing if there are none."""
    if not names:
        return [], ""
    row = F.struct(*(F.col(f"`{n}`") for n in names)).alias("carried")
    return [row], f", carried {docs.select(row).schema[0].dataType.simpleString()}"


def block_of(column, count):
    """Number of the block that holds a document id."""
    return F.pmod(F.xxhash64(column), F.lit(count))


def blocks(docs, id_col="doc_id", text_col="text", block_bytes=BLOCK_BYTES, keep=()):
    """(frame of block, doc_id, text and ``keep``; number of buckets; number of blocks) of a document table.

    Only the named columns are read, so others may have any name. Documents without an
    id are spread by their text.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    count = max(1, math.ceil(size / block_bytes))
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)))
    frame = docs.select(block_of(key, count).alias("block"), F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"), *keep)
    return frame, max(MIN_BUCKETS, math.ceil(size / BUCKET_BYTES)), count


def in_order(table):
    """The rows of a block in an order that does not depend on the shuffle."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def ids_of(table):
    """(ids as long with 0 for null, mask of rows that have an id)."""
    column = table.column("doc_id")
    return column.fill_null(0).to_numpy().astype(np.int64), ~column.is_null().to_numpy()


def rows(items):
    """Message rows from (key, src, kind, h, x, y); ``h`` ascending, x and y may be None, x raw bytes."""
    out = {name: [] for name in ARROW.names}
    for key, src, kind, h, x, y in items:
        for name, value in zip(ARROW.names, (key, src, kind, len(h), K.pack_sorted(h),
                                             x if x is None or isinstance(x, bytes) else K.pack(x),
                                             K.pack(y) if y is not None else None)):
            out[name].append(value)
    return pa.table(out, schema=ARROW)


def to_buckets(src, kind, buckets, h, x=None, y=None):
    """Cut ascending keys into one item per bucket."""
    if not len(h):
        return
    key = K.bucket_of(h, buckets)
    cuts = K.group_starts(key)
    for low, high in zip(cuts, np.append(cuts[1:], len(h))):
        yield (int(key[low]), src, kind, h[low:high], None if x is None else x[low:high],
               None if y is None else y[low:high])


def gather(table, kind):
    """All entries of one kind: (src, h, x, y) as flat arrays; x, y as sent (unsigned)."""
    src, h, x, y = [], [], [], []
    for row in table.select(["src", "kind", "n", "h", "x", "y"]).to_pylist():
        if row["kind"] == kind and row["n"]:
            n = row["n"]
            src.append(np.full(n, row["src"], dtype=np.int64))
            h.append(K.unpack_sorted(row["h"], n))
            x.append(K.unpack(row["x"], n) if row["x"] else np.zeros(n, dtype=np.uint64))
            y.append(K.unpack(row["y"], n) if row["y"] else np.zeros(n, dtype=np.uint64))
    if not h:
        none = np.empty(0, dtype=np.uint64)
        return none.view(np.int64), none, none, none
    return np.concatenate(src), np.concatenate(h), np.concatenate(x), np.concatenate(y)


def back(bucket, kind, src, h, x=None, y=None):
    """One item per block from entries of any order."""
    order = np.lexsort((h, src))
    src, h = src[order], h[order]
    x, y = (None if v is None else v[order] for v in (x, y))
    cuts = K.group_starts(src)
    for low, high in zip(cuts, np.append(cuts[1:], len(src))):
        yield (int(src[low]), bucket, kind, h[low:high], None if x is None else x[low:high],
               None if y is None else y[low:high])


def emit(frame, fn):
    """fn(block, ordered table) -> items, for every block of documents."""

    def run(key, table):
        return rows(fn(key[0].as_py(), in_order(table)))

    return frame.groupBy("block").applyInArrow(run, MESSAGE)


def resolve(messages, fn):
    """fn(bucket, table of messages) -> items addressed to blocks."""

    def run(key, table):
        return rows(fn(key[0].as_py(), table))

    return messages.groupBy("key").applyInArrow(run, MESSAGE)


def answer(frame, messages, fn, schema=MESSAGE):
    """fn(block, ordered table, messages) for every block of documents with its answers."""

    def run(key, table, found):
        out = fn(key[0].as_py(), in_order(table), found)
        return rows(out) if schema is MESSAGE else out

    return frame.groupBy("block").cogroup(messages.groupBy("key")).applyInArrow(run, schema)
