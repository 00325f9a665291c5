"""Mixing sources to target weights: a golden-ratio schedule over equal-token blocks."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelake.llm import kernels as K
from tidelake.llm.op9_decontaminate import pieces
from tidelake.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed value: the fractional part of the golden ratio
GOLDEN = 0.6180339887498949
BLOCK_WORDS = 4096
# the smallest target is made of so many blocks if the table allows
LEAST_BLOCKS = 500
# so many slots at most as long as blocks are below BLOCK_WORDS
SLOTS = 1 << 21
# rows of one running total; a source with more is cut into ranges of its shuffle order
CHUNK_ROWS = 4_000


def sizes(docs, id_col="doc_id", text_col="text", source_col="source"):
    """doc_id, source, size in words of every document."""

    def run(batches):
        for batch in pieces(batches):
            _, _, first = K.words(*K.text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(np.diff(first))],
                                             names=["doc_id", "source", "size"])

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, source string, size long")


def targets(sized, weights=(1, 2, 3), most=3):
    """Per source: number ``sid`` by code point (null last), source_size, target.

    Targets share the total of all sizes by weight and stop at ``most`` times their
    source's size; the excess goes to the others by weight until none is above. With
    sources ordered by the level at which they are full, the common level is the first
    that fills no further source. The windows here run over one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    rows = sums.withColumn("sid", number).withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("full", most * F.col("source_size")).withColumn("level", F.col("full") / F.col("weight"))
    order, everything = Window.orderBy("level", "sid"), Window.partitionBy()
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("common", (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0)))
                           / F.sum("weight").over(after))
    first = F.min(F.when(F.col("common") <= F.col("level"), F.struct("level", "sid", "common"))).over(everything)
    rows = rows.withColumn("common", first["common"])
    return rows.select("sid", "source", "source_size", F.least(F.col("full").cast("double"), F.col("common") * F.col("weight")).alias("target"))


def running(frame, value, name, chunks, position, order):
    """Running total of ``value`` before each row of a source, in ``chunks`` ranges of the shuffle order."""
    frame = frame.withColumn("chunk", F.floor(position * chunks).cast("long"))
    inside = Window.partitionBy("sid", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = frame.groupBy("sid", "chunk").agg(F.sum(value).alias("chunk_total"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "chunk", F.coalesce(F.sum("chunk_total").over(before), F.lit(0)).alias("chunk_start"))
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return frame.withColumn(name, own).join(totals, ["sid", "chunk"]).withColumn(
        name, (F.col(name) + F.col("chunk_start")).cast("long")).drop("chunk", "chunk_start")


def block_words(total, smallest, largest=BLOCK_WORDS):
    """Words of a block: small enough that each target is many blocks, large enough for SLOTS."""
    return max(1, min(largest, max(int(smallest // LEAST_BLOCKS), math.ceil(total / SLOTS))))


def schedule(spark, goals, total, block):
    """Slots (sid, rank): the source of each slot and its number among that source's slots.

    Slot i lies at the fractional part of i times the golden ratio; the source is the one
    whose range of cumulative target shares holds that point. Ranges meet points through a
    grid of cells, so this is an equal join.
    """
    slots = math.ceil(total / block)
    order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    ranges = goals.withColumn("low", F.coalesce(F.sum("target").over(order), F.lit(0.0)))
    whole = F.sum("target").over(Window.partitionBy())
    ranges = ranges.select("sid", (F.col("low") / whole).alias("low"), "target", whole.alias("whole")).where("target > 0")
    # a range ends where the next begins, the last one behind all points
    ranges = ranges.withColumn("high", F.lead("low", 1, 2.0).over(Window.orderBy("low", "sid")))
    cells = max(64, 8 * goals.count())
    cell = F.least(F.floor(F.col("high") * cells), F.lit(cells)).cast("long")
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells).cast("long"), cell)))
    point = F.col("id") * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * cells).cast("long"))
    held = points.join(ranges.select("sid", "low", "high", "cell"), "cell").where("point >= low AND point < high")
    held = held.select("slot", "sid")
    chunks = max(1, math.ceil(slots / CHUNK_ROWS))
    return running(held.withColumn("one", F.lit(1)), "one", "rank", chunks, F.col("slot") / F.lit(float(slots)), ["slot"]).drop("one")


def fill(slots, quotas, block, count):
    """The slots of each source so that they hold its quota: surplus ones go, missing ones follow the ``count`` slots.

    A schedule of points is off by a few slots per source, so few are added; the window
    here runs over those.
    """
    had = slots.groupBy("sid").agg(F.count("*").alias("had"))
    quotas = quotas.join(had, "sid", "left").select(
        "sid", F.coalesce("had", F.lit(0)).alias("had"), F.ceil(F.col("quota") / block).alias("needed"))
    kept = slots.join(quotas.select("sid", "needed"), "sid").where("rank < needed").select("slot", "sid", "rank")
    extra = quotas.where("had < needed").select("sid", F.explode(F.sequence(F.col("had"), F.col("needed") - 1)).alias("rank"))
    slot = F.row_number().over(Window.orderBy("rank", "sid")) - 1 + count
    return kept.union(extra.select(slot.cast("long").alias("slot"), "sid", "rank"))


def mix(docs, id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3), most=3, seed="mix"):
    """(documents with their size, target and taken words; the mix itself), for target weights.

    Documents of a source are shuffled by a hash of their id and laid end to end; the
    stream is cut into blocks of equal word count, going round again when it ends. The
    k-th slot of a source takes its k-th block. Where SLOTS makes blocks too large for the
    smallest target, each source ends at its own target in words, at least one, with a
    partial last block. The mix has one row per slot and document
    in it: slot, doc_id, source, low, high (word numbers). No document is taken more than
    ``most`` times. Documents without words are never taken; a source of only such
    documents has target 0; null is a source of its own. Equal ids and repeated rows are
    documents of their own. Other columns are not read.
    """
    spark = docs.sparkSession
    sized = materialize(sizes(docs, id_col, text_col, source_col), "sizes")
    goals = materialize(targets(sized, weights, most), "targets")
    whole = goals.agg(F.sum("source_size").alias("total"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    total, count = whole["total"] or 0, sized.count()
    block = block_words(total, whole["least"] or 0)
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    placed = sized.join(F.broadcast(goals) if goals.count() <= CHUNK_ROWS else goals, sized.source.eqNullSafe(goals.source)).select(
        "doc_id", sized.source, "size", "sid", "source_size", "target", mark.alias("mark"))
    position = F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    placed = running(placed, "size", "start", max(1, math.ceil(count / CHUNK_ROWS)), position, ["mark", "doc_id", "size"])
    placed = materialize(placed.drop("mark"), "streams")
    slots = materialize(schedule(spark, goals, total, block), "schedule")
    if block > max(1, (whole["least"] or 0) // LEAST_BLOCKS):
        quota = F.greatest(F.lit(1), F.round("target")).cast("long")
        lengths = materialize(goals.where("target > 0").select("sid", quota.alias("quota")), "quotas")
        slots = materialize(fill(slots, lengths, block, math.ceil(total / block)), "filled")
        lengths = lengths.withColumnRenamed("quota", "stream")
    else:
        taken = F.least(F.col("slots") * block, most * F.col("source_size"))
        lengths = slots.groupBy("sid").agg(F.count("*").alias("slots"))
        lengths = lengths.join(goals.select("sid", "source_size"), "sid").select("sid", taken.alias("stream"))
    # once round the source for every time its stream goes round
    laid = placed.where("size > 0").join(F.broadcast(lengths) if goals.count() <= CHUNK_ROWS else lengths, "sid")
    laid = laid.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    laid = laid.withColumn("low", F.col("start") + F.col("round") * F.col("source_size")).where("low < stream")
    laid = laid.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("stream")))
    laid = laid.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    pieces_ = laid.join(slots, ["sid", "rank"]).select(
        "slot", "doc_id", "source", "sid", "start",
        (F.greatest(F.col("low"), F.col("rank") * block) - F.col("low")).alias("low"),
        (F.least(F.col("high"), (F.col("rank") + 1) * block) - F.col("low")).alias("high"))
    sums = pieces_.groupBy("sid", "start").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    result = placed.join(sums, ["sid", "start"], "left").withColumn(
        "taken", F.when(F.col("size") > 0, F.coalesce(F.col("taken"), F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return result.select("doc_id", "size", "source_size", "target", "taken", "source"), pieces_.drop("sid", "start")
