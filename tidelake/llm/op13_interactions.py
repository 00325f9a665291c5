"""Filter interaction audit: removal steps of every filter order by a min-plus product of masks and positions."""

from __future__ import annotations

import sys
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidelake.llm import kernels as K
from tidelake.llm.op9_decontaminate import pieces
from tidelake.llm.stats import UPPER, per_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
# fixed values: the limits of the five filters
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 2
MARKS = np.isin(np.arange(256), list(b"#$%&*|"))
# so many orders that a part's rows stay few: 7! = 5040
MOST_FILTERS = 7


def text_masks(column):
    """Bits 1, 2, 4, 8 of the texts that fail A (few words), B (few distinct words), C (capitals), D (marks)."""
    data, offsets = K.text_bytes(column)
    starts, ends, first = K.words(data, offsets)
    words, owner = np.diff(first), K.owners(first)
    h = K.span_hashes(data, starts, ends)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    distinct = np.bincount(owner[new], minlength=len(words))
    points = per_text((data & 0xC0) != 0x80, offsets)
    fails = [words < MIN_WORDS, 100 * distinct < MIN_DISTINCT * words, 100 * per_text(UPPER[data], offsets) > MAX_UPPER * points,
             per_text(MARKS[data], offsets) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails)), data, offsets


def failures(docs, labels, id_col="doc_id", text_col="text", part_col="source"):
    """Rows part, mask, n, good, toxic: how many documents of a part fail which of the five filters.

    E, the filter of copies, is a matter of the whole table: texts are compared by their
    SHA-256. Copies are counted by (text, part, labels) before their smallest id is looked up, so
    a text that a third of all documents share is a few rows. A null text is an
    empty one, a null part an empty string. Rows without an id are no copies and have no
    copies; rows of one id are no copies of each other. A label holds if any row of its id says so.
    """

    def run(batches):
        for batch in pieces(batches):
            masks, data, offsets = text_masks(batch.column("text"))
            raw = memoryview(data)
            keys = [K.hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())],
                names=["doc_id", "part", "mask", "key"])

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        F.col(text_col).cast("string").alias("text"))
    measured = frame.mapInArrow(run, "doc_id long, part string, mask int, key binary")
    once = measured.groupBy("doc_id", "part", "mask", "key").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    once = once.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    known = F.col("doc_id").isNotNull()
    groups = once.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n_known"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"))
    least = groups.groupBy("key").agg(F.min("first.doc_id").alias("least"))
    own = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = groups.join(least, "key").withColumn("copies", F.col("n_known") - F.coalesce(own, F.lit(0)))
    bit = F.lit(1 << FILTERS.index("E"))
    split = F.explode(F.array(F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), F.col("copies").alias("n")),
                              F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")))).alias("row")
    rows = copies.select("part", "good", "toxic", split).select("part", "good", "toxic", "row.mask", "row.n").where("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
                                            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


class Orders:
    """All orders of k filters: the step at which a document with a mask of failures goes.

    ``places[o, f]`` is the step of filter f in order o (the inverse permutation); a mask
    adds nothing for a filter that fails and infinity for one that does not. The min-plus product
    of masks and places is the first failing step; k means that no filter fails.
    """

    def __init__(self, names):
        k = len(names)
        if not 0 < k <= MOST_FILTERS:
            raise ValueError(f"1 to {MOST_FILTERS} filters, for each has a place in every order")
        orders = np.array(list(permutations(range(k))))
        self.k, self.names = k, ["".join(names[f] for f in o) for o in orders]
        self.orders, self.places = orders, np.argsort(orders, axis=1)
        self.fails = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1 == 1
        cost = np.where(self.fails, 0, k)
        self.steps = np.minimum((cost[:, None, :] + self.places[None]).min(axis=2), k)

    def counts(self, weights):
        """Named arrays (order, step) from ``weights``: rows n, good, toxic, with an entry per mask."""
        n, k = weights[0], self.k
        order = np.broadcast_to(np.arange(len(self.orders)), self.steps.shape)

        def scatter(w):
            out = np.zeros((len(self.orders), k + 1), dtype=np.int64)
            np.add.at(out, (order, self.steps), np.broadcast_to(w[:, None], self.steps.shape))
            return out[:, :k]

        removed, good, toxic = (scatter(w) for w in weights)
        redundant, shapley = np.zeros_like(removed), np.zeros(k, dtype=np.int64)
        rows = np.arange(len(self.orders))
        for f in range(k):
            earlier = self.fails[:, f, None] & (self.steps < self.places[None, :, f])
            redundant[rows, self.places[:, f]] = (n[:, None] * earlier).sum(axis=0)
            shapley[f] = removed[rows, self.places[:, f]].sum()
        alone = n[1 << np.arange(k)]
        return {"kept": n.sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": redundant,
                "unique_fails": alone[self.orders], "good_lost": good, "toxic_lost": toxic, "shapley": shapley[self.orders]}


def interactions(masks, names=FILTERS):
    """For every part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``masks`` has part, mask (bit i: filter i fails), n, good and toxic, with any number of rows
    for a mask. Rows are summed by part and mask first, so a part is at most 2**k rows whatever it
    holds; a part without rows is not in the result, a step that removes nothing is, with zeros.
    A null part is a part of its own.
    """
    orders = Orders(names)

    def run(table):
        weights = np.zeros((3, 1 << orders.k), dtype=np.int64)
        at = table.column("mask").to_numpy()
        for w, name in zip(weights, ("n", "good", "toxic")):
            w[at] = table.column(name).to_numpy()
        size = len(orders.names) * orders.k
        out = {"part": pa.array(table.column("part")[:1].to_pylist() * size, pa.string()),
               "filter_order": pa.array(np.repeat(orders.names, orders.k)),
               "step": pa.array(np.tile(np.arange(1, orders.k + 1, dtype=np.int32), len(orders.names)))}
        return pa.table(out | {name: pa.array(v.ravel()) for name, v in orders.counts(weights).items()})

    sums = masks.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")))
    return sums.groupBy("part").applyInArrow(
        run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
             "good_lost long, toxic_lost long, shapley long")
