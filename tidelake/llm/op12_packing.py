"""Packing token sequences: combinations of lengths that fill a window, with repeat counts by non-negative least squares.

A document is whole windows and a rest below one window. The rests' histogram has fewer bins than
the window has tokens, so everything that is planned has a bound that no table raises: all
combinations of up to three lengths that fill the window (thinned by ``STEP``), their repeat counts
by non-negative least squares against the histogram, rounded so that none takes more than there
is, and greedy filling for what is left; what fills no window lies end to end in a stream that is
cut at every window. A plan row says which ranks of a length go where; documents find their
rows by an equal join.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelake.llm import tokens
from tidelake.llm.op9_decontaminate import pieces
from tidelake.session import estimated_bytes, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 2048
END_ID = 1
# of the combinations of three lengths, those whose larger two differ by a multiple of this odd number
STEP = 3
ROUNDS = 300
BATCH_BYTES = 1 << 22
# ranks that share a join key
CHUNK = 1024
# cut pieces are sent to every task up to this size
BROADCAST_BYTES = 32 << 20
PLAN = pa.schema([(c, pa.int64()) for c in ("cls", "low", "high", "per", "sequence", "at")])


def combinations(histogram, window=WINDOW, step=STEP):
    """Up to three lengths each, largest first and 0 for none, that fill the window and that the histogram can supply once."""
    have = np.flatnonzero(histogram)
    a, b = have, window - have
    two = np.stack([a, b, np.zeros_like(a)], axis=1)[a >= b]
    first, second = np.meshgrid(have, have, indexing="ij")
    third = window - first - second
    fits = (first >= second) & (second >= third) & (third > 0) & ((first - second) % step == 0)
    three = np.stack([first[fits], second[fits], third[fits]], axis=1)
    rows = np.concatenate([two, three])
    rows = rows[(histogram[rows] > 0).all(axis=1) | ((rows[:, 2] == 0) & (histogram[rows[:, :2]] > 0).all(axis=1))]
    uses = (rows[:, :, None] == rows[:, None, :]).sum(axis=2)
    return rows[((rows == 0) | (uses <= histogram[rows])).all(axis=1)]


def least_squares(rows, histogram, rounds=ROUNDS):
    """Repeat counts x >= 0 of the combinations that bring A x next to the histogram.

    Accelerated projected gradients: A has a column per combination with the times it uses each length.
    """
    real = rows.ravel() > 0
    lengths, column = rows.ravel()[real], np.repeat(np.arange(len(rows)), rows.shape[1])[real]
    size, goal = len(histogram), histogram.astype(float)
    use = lambda x: np.bincount(lengths, weights=x[column], minlength=size)
    back = lambda r: np.bincount(column, weights=r[lengths], minlength=len(rows))
    norm, v = 1.0, np.ones(len(rows))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(use(y) - goal) / (1.01 * norm))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def rounded(rows, x, histogram):
    """Whole repeat counts: x rounded down, then one more where it was cut most, never more than the histogram holds."""
    left = histogram.astype(np.int64).copy()
    count = np.zeros(len(rows), dtype=np.int64)
    whole, part = np.floor(x).astype(np.int64), x - np.floor(x)
    for want, order in ((whole, np.argsort(-x, kind="stable")), ((part > 0).astype(np.int64), np.argsort(-part, kind="stable"))):
        for i in order[want[order] > 0].tolist():
            own = [n for n in rows[i].tolist() if n]
            k = min(int(want[i]), *(int(left[n]) // own.count(n) for n in own))
            if k > 0:
                count[i] += k
                for n in own:
                    left[n] -= k
    return count


class Plan:
    """Which ranks of each length go to which sequence.

    A row: of a length, the ranks from ``low`` to ``high`` lie whole in the sequences from ``sequence`` on, ``per``
    in each from offset ``at``; or, with ``per`` 0, end to end in the stream from place ``at``, which is cut
    into windows and, where it ends, into powers of two.
    """

    def __init__(self, histogram, window):
        self.window, self.sequences, self.stream = window, 0, 0
        self.rows = {c: [] for c in PLAN.names}
        self.left, self.used = histogram.astype(np.int64).tolist(), [0] * len(histogram)

    def add(self, length, count, per, at):
        low = self.used[length]
        self.used[length] += count
        self.left[length] -= count
        for name, value in zip(PLAN.names, (length, low, low + count, per, self.sequences, at)):
            self.rows[name].append(value)

    def fill(self, pattern, times):
        """``times`` sequences of a pattern {length: items}."""
        at = 0
        for length, per in pattern.items():
            self.add(length, per * times, per, at)
            at += per * length
        self.sequences += times

    def residuals(self):
        """Greedily the longest that fits, again and again; a length that leaves a gap goes to the stream.

        Every step uses up a length, so there are no more steps than the window has tokens.
        """
        lengths = [n for n, c in enumerate(self.left) if c]
        while lengths:
            pattern, space, end = {}, self.window, len(lengths)
            while space and (end := bisect_right(lengths, space, 0, end)):
                n = lengths[end - 1]
                pattern[n] = min(self.left[n], space // n)
                space, end = space - n * pattern[n], end - 1
            longest = lengths[-1]
            if space:
                count = self.left[longest]
                self.add(longest, count, 0, self.stream)
                self.stream += count * longest
            else:
                self.fill(pattern, min(self.left[n] // m for n, m in pattern.items()))
            lengths = [n for n in lengths if self.left[n]]

    def ends(self):
        """Where the sequences of the stream begin that are no whole windows, and where it ends."""
        at = self.stream - self.stream % self.window
        out = [at]
        while at < self.stream:
            at += 1 << ((self.stream - at).bit_length() - 1)
            out.append(at)
        return out

    def table(self):
        return pa.table({c: pa.array(v, pa.int64()) for c, v in self.rows.items()}, schema=PLAN)


def plan_rests(histogram, window=WINDOW, step=STEP, rounds=ROUNDS):
    """The plan of all rests; ``histogram[n]`` is the number of rests of n tokens, 0 < n < window."""
    plan = Plan(histogram, window)
    rows = combinations(histogram, window, step)
    if len(rows):
        counts = rounded(rows, least_squares(rows, histogram, rounds), histogram)
        for i in np.flatnonzero(counts).tolist():
            plan.fill(Counter(n for n in rows[i].tolist() if n), int(counts[i]))
    plan.residuals()
    return plan


def crc(ids):
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


UNITS = pa.schema([*((c, pa.int64()) for c in ("row", "doc_id", "n", "cls", "part", "local", "count")),
                   ("crcs", pa.list_(pa.int64())), ("ids", pa.binary())])


def encoded(docs, vocabulary, end_id, window, id_col, text_col):
    """One row for the whole windows of a document (cls 0) and one for its rest (cls: its length).

    row, doc_id, n (tokens of the document), cls, part and local (rows or windows of this
    class before, in the same task), count, crcs, and a rest's ids.
    """
    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encoder, seen = tokens.encoder(vocabulary), np.zeros(window, dtype=np.int64)
        width = "<u2" if max(encoder.largest, end_id) < 1 << 16 else "<u4"
        for batch in pieces(batches, size=BATCH_BYTES):
            flat, at = encoder.encode(batch.column("text"))
            out = []
            for doc_id, low, high in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                ids = np.append(flat[low:high], np.uint32(end_id))
                full, rest = divmod(len(ids), window)
                same = ((part << 40) + number, doc_id, len(ids))
                number += 1
                if full:
                    crcs = [crc(ids[i:i + window]) for i in range(0, full * window, window)]
                    out.append((*same, 0, part, int(seen[0]), full, crcs, None))
                    seen[0] += full
                if rest:
                    ids = ids[full * window:]
                    out.append((*same, rest, part, int(seen[rest]), 1, [crc(ids)], ids.astype(width).tobytes()))
                    seen[rest] += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), UNITS.types)], schema=UNITS)

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, "row long, doc_id long, n long, cls long, part long, local long, count long, crcs array<bigint>, ids binary")


def pack(docs, vocabulary, window=WINDOW, end_id=END_ID, id_col="doc_id", text_col="text", step=STEP):
    """Pieces of all documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    A document is its ids by the vocabulary file and then ``end_id``; a null text is an
    empty one. A sequence holds ``window`` tokens but for the last few, which hold powers of two,
    so none needs padding. Whole windows of a document are sequences of their own; of its rest
    each combination takes all, only the greedy filling cuts some. Repeated rows and ids, and null
    ids, are documents of their own; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    if window < 2 or window & (window - 1):
        raise ValueError("the window is a power of two")
    units = materialize(encoded(docs, vocabulary, end_id, window, id_col, text_col), "units")
    parts = materialize(units.groupBy("cls", "part").agg(F.sum("count").alias("count")), "unit-counts")
    histogram = np.zeros(window, dtype=np.int64)
    for cls, count in parts.groupBy("cls").agg(F.sum("count")).collect():  # a row per length below the window
        histogram[cls] = count
    histogram[0] = 0
    plan = plan_rests(histogram, window, step)
    earlier = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("cls", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = units.drop("ids").join(parts, ["cls", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    ends = plan.ends()
    windows = ends[0] // window
    streamed = plan.sequences + windows + len(ends) - 1
    whole = ranked.where("cls = 0").select("doc_id", "n", "rank", F.posexplode("crcs").alias("i", "ids_crc32"))
    whole = whole.select(
        "doc_id", (F.col("i") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32",
        F.col("n").alias("doc_tokens"), (F.col("rank") + F.col("i") + streamed).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    spots = materialize(spark.createDataFrame(plan.table()), "plan")
    piece = lambda c: F.floor(F.col(c) / CHUNK)
    spots = spots.withColumn("chunk", F.explode(F.sequence(piece("low"), F.floor((F.col("high") - 1) / CHUNK))))
    found = ranked.where("cls > 0").withColumn("chunk", piece("rank")).join(spots, ["cls", "chunk"]).where("rank >= low AND rank < high")
    found = found.select("row", "cls", "doc_id", F.col("crcs")[0].alias("whole_crc"), F.col("n").alias("doc_tokens"),
                         (F.col("rank") - F.col("low")).alias("number"), "per", "sequence", "at")
    exact = found.where("per > 0").select(
        "row", "cls", "doc_id", "whole_crc", "doc_tokens", F.lit(0).cast("long").alias("piece_start"), F.col("cls").alias("length"),
        (F.col("sequence") + F.floor(F.col("number") / F.col("per"))).alias("sequence_id"),
        (F.col("at") + F.col("number") % F.col("per") * F.col("cls")).alias("offset"))
    # the stream: number of the sequence that holds a place, and where a sequence begins
    holds = lambda c: sum((F.when(c >= b, 1).otherwise(0) for b in ends[1:-1]), F.least(F.floor(c / window), F.lit(windows)))
    begins = F.array(*(F.lit(b).cast("long") for b in [*ends, ends[-1]]))
    start_of = lambda c: F.when(c < windows, c * window).otherwise(F.element_at(begins, (c - windows + 1).cast("int")))
    laid = found.where("per = 0").withColumn("low", F.col("at") + F.col("number") * F.col("cls")).withColumn("high", F.col("low") + F.col("cls"))
    laid = laid.withColumn("cell", F.explode(F.sequence(holds(F.col("low")), holds(F.col("high") - 1))))
    laid = laid.withColumn("from", F.greatest("low", start_of(F.col("cell")))).withColumn("to", F.least("high", start_of(F.col("cell") + 1)))
    laid = laid.select(
        "row", "cls", "doc_id", "whole_crc", "doc_tokens", (F.col("from") - F.col("low")).alias("piece_start"),
        (F.col("to") - F.col("from")).alias("length"), (F.col("cell") + plan.sequences).alias("sequence_id"),
        (F.col("from") - start_of(F.col("cell"))).alias("offset"))
    rests = materialize(exact.unionByName(laid), "rests")
    uncut = rests.where("length = cls").withColumn("ids_crc32", F.col("whole_crc")).drop("whole_crc")

    def crcs(batches):
        for batch in batches:
            found = [crc(np.frombuffer(ids, dtype=f"<u{len(ids) // cls}")[a:a + n]) for ids, cls, a, n in
                     zip(*(batch.column(c).to_pylist() for c in ("ids", "cls", "piece_start", "length")))]
            names = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(found, pa.int64())], names=[*names, "ids_crc32"])

    cut = rests.where("length < cls").drop("whole_crc")
    small = estimated_bytes(rests) <= BROADCAST_BYTES
    held = units.where("cls > 0").select("row", "ids").join(F.broadcast(cut) if small else cut, "row")
    kinds = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in cut.schema)
    held = held.select(*cut.columns, "ids").mapInArrow(crcs, f"{kinds}, ids_crc32 long")
    rests = uncut.unionByName(held).select(
        "doc_id", (F.col("doc_tokens") - F.col("cls") + F.col("piece_start")).alias("start"), "length", "ids_crc32", "doc_tokens",
        "sequence_id", F.col("offset").cast("long").alias("offset"))
    return whole.unionByName(rests)
