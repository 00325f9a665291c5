"""Ordered per-key computations that survive a hot key.

A plain window sends every row of a key to one task. Here all groups are counted
first. The rows of groups that are too big for one task are sorted by key and order
column into ranges of about equal size (Spark's range shuffle); each range is computed
on its own, and a small summary per key and range carries the state from one range to the
next. Keys of ordinary size keep the plain window, and when no key is hot the plan
*is* the plain window.

``order`` is a list of column names that orders the rows of a key totally. Slices are
ranges of the first one, which may be of any type that Spark can sort. Rows of one key
with the same value of it stay together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.session import materialize

# A group up to MIN_ROWS is left to one task; slices hold about as many.
MIN_ROWS = 2_000_000


@dataclass
class Sliced:
    """A frame with ``_k`` (group) and ``_slice``; ``hot`` tells if any group was cut."""

    df: DataFrame
    hot: bool
    keys: list = field(default_factory=list)

    @property
    def group(self):
        return ["_k", "_slice"] if self.hot else list(self.keys)

    def clean(self, df: DataFrame) -> DataFrame:
        return df.drop("_k", "_slice", "_hot")


def hot_groups(df: DataFrame, keys, min_rows=None) -> DataFrame:
    """All groups above ``min_rows`` and their sizes ``_n`` (counts combine before the shuffle)."""
    limit = MIN_ROWS if min_rows is None else min_rows
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)


def slice_groups(df: DataFrame, keys, by: str, descending=False, min_rows=None) -> Sliced:
    """Cut the hot groups of ``df`` into ranges of ``by``, numbered in scan order."""
    keys = list(keys)
    limit = MIN_ROWS if min_rows is None else min_rows
    if keys:
        found = materialize(hot_groups(df, keys, limit), "hot")
        total = found.agg(F.sum("_n")).first()[0] or 0
    else:
        total = df.count()
    if total <= limit:
        return Sliced(df, False, keys)
    marked = df.withColumn("_k", F.struct(*keys) if keys else F.lit(0))
    if keys:
        listed = found.select(F.struct(*keys).alias("_k"))
        hot, cold = marked.join(listed, "_k", "left_semi"), marked.join(listed, "_k", "left_anti")
    else:
        hot, cold = marked, marked.limit(0)
    # Spark's own order of the column: NULL first and NaN last, the other way round when descending
    ranged = hot.repartitionByRange(math.ceil(total / limit), F.asc("_k"), F.desc(by) if descending else F.asc(by))
    # written, so that a range keeps its number whoever reads it
    sliced = materialize(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    rows = cold.withColumn("_slice", F.lit(0)).withColumn("_hot", F.lit(False)).unionByName(
        sliced.withColumn("_hot", F.lit(True)))
    return Sliced(rows.select(*df.columns, "_k", "_hot", "_slice"), True, keys)


def _ordering(order, backwards=False, descending=()):
    return [F.desc(c) if (c in descending) != backwards else F.asc(c) for c in order]


def scan(df: DataFrame, keys, order, sums=None, last=None, prev=None, following=None,
         min_rows=None) -> DataFrame:
    """Add columns computed while walking each key's rows in ``order``.

    ``sums``       running total up to and including the row
    ``last``       latest non-null value up to and including the row
    ``prev``       latest non-null value strictly before the row
    ``following``  first non-null value strictly after the row

    Each is a dict of output name to Column.
    """
    sums, last, prev, following = sums or {}, last or {}, prev or {}, following or {}
    cut = slice_groups(df, keys, order[0], min_rows=min_rows)
    base = cut.df
    # inputs become real columns, so that expressions are evaluated once
    inputs = {**{f"_s_{n}": c for n, c in sums.items()}, **{f"_l_{n}": c for n, c in last.items()},
              **{f"_p_{n}": c for n, c in prev.items()}, **{f"_f_{n}": c for n, c in following.items()}}
    base = base.select("*", *[c.alias(n) for n, c in inputs.items()])
    before = Window.partitionBy(*cut.group).orderBy(*_ordering(order))
    after = Window.partitionBy(*cut.group).orderBy(*_ordering(order, backwards=True))
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strictly = before.rowsBetween(Window.unboundedPreceding, -1)
    beyond = after.rowsBetween(Window.unboundedPreceding, -1)
    columns = {}
    for name in sums:
        columns[name] = F.sum(f"_s_{name}").over(upto)
    for name in last:
        columns[name] = F.last(f"_l_{name}", ignorenulls=True).over(upto)
    for name in prev:
        columns[name] = F.last(f"_p_{name}", ignorenulls=True).over(strictly)
    for name in following:
        columns[name] = F.last(f"_f_{name}", ignorenulls=True).over(beyond)
    out = base.select("*", *[c.alias(n) for n, c in columns.items()])
    if cut.hot:
        out = _carry(cut, base, out, order, sums, last, prev, following)
    return cut.clean(out.drop(*inputs))


def _carry(cut, base, out, order, sums, last, prev, following):
    """Join the state that earlier (or later) slices leave to every hot slice."""

    def edge(pick, column):
        return pick(F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("_v"))))

    totals = [F.sum(f"_s_{n}").alias(f"_c_{n}") for n in sums]
    totals += [edge(F.max, f"_l_{n}").alias(f"_c_{n}") for n in last]
    totals += [edge(F.max, f"_p_{n}").alias(f"_c_{n}") for n in prev]
    totals += [edge(F.min, f"_f_{n}").alias(f"_c_{n}") for n in following]
    state = base.filter("_hot").groupBy("_k", "_slice").agg(*totals)
    past = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy("_k").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    state = state.select(
        "_k", "_slice",
        *[F.sum(f"_c_{n}").over(past).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_c_{n}", ignorenulls=True).over(past)["_v"].alias(f"_c_{n}") for n in [*last, *prev]],
        *[F.last(f"_c_{n}", ignorenulls=True).over(future)["_v"].alias(f"_c_{n}") for n in following])
    out = out.join(state, ["_k", "_slice"], "left")
    for name in sums:
        total = F.coalesce(F.col(name) + F.col(f"_c_{name}"), F.col(name), F.col(f"_c_{name}"))
        out = out.withColumn(name, total)
    for name in [*last, *prev, *following]:
        out = out.withColumn(name, F.coalesce(F.col(name), F.col(f"_c_{name}")))
    return out.drop(*[f"_c_{n}" for n in [*sums, *last, *prev, *following]])


def over_previous(df: DataFrame, keys, order, n: int, columns, min_rows=None) -> DataFrame:
    """Add aggregates over the ``n`` rows before each row of a key.

    ``columns`` maps an output name to a function from a window to a Column.
    Hot slices borrow the last ``n`` rows of the slices before them.
    """
    cut = slice_groups(df, keys, order[0], min_rows=min_rows)
    rows = cut.df
    if cut.hot:
        names = df.columns
        latest = Window.partitionBy("_k", "_slice").orderBy(*_ordering(order, backwards=True))
        tails = (rows.filter("_hot").withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= n)
                 .groupBy("_k", "_slice")
                 .agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*names).alias("_row")))).alias("_tail")))
        near = Window.partitionBy("_k").orderBy("_slice").rowsBetween(-n, -1)
        lent = tails.select("_k", "_slice", F.flatten(F.collect_list("_tail").over(near)).alias("_lent"))
        kept = F.slice("_lent", F.greatest(F.size("_lent") - n + 1, F.lit(1)), n)
        halo = lent.select("_k", "_slice", F.explode(kept).alias("_e")).select(
            "_e._row.*", "_k", F.lit(True).alias("_hot"), "_slice", F.lit(True).alias("_halo"))
        rows = rows.withColumn("_halo", F.lit(False)).unionByName(halo)
    frame = Window.partitionBy(*cut.group).orderBy(*_ordering(order)).rowsBetween(-n, -1)
    out = rows.select("*", *[make(frame).alias(name) for name, make in columns.items()])
    if cut.hot:
        out = out.filter(~F.col("_halo")).drop("_halo")
    return cut.clean(out)


def ranking(df: DataFrame, keys, order, descending=(), ntile: int | None = None, min_rows=None) -> DataFrame:
    """Add ``row_number``, ``rank`` and ``dense_rank`` (and ``ntile``) per key.

    ``rank`` and ``dense_rank`` compare the first order column only;
    ``row_number`` and ``ntile`` use the whole order.
    """
    lead_desc = order[0] in descending
    cut = slice_groups(df, keys, order[0], descending=lead_desc, min_rows=min_rows)
    whole = Window.partitionBy(*cut.group).orderBy(*_ordering(order, descending=descending))
    values = Window.partitionBy(*cut.group).orderBy(*_ordering(order[:1], descending=descending))
    out = cut.df.select(
        "*", F.row_number().over(whole).cast("long").alias("row_number"),
        F.rank().over(values).cast("long").alias("rank"),
        F.dense_rank().over(values).cast("long").alias("dense_rank"))
    if not cut.hot:
        if ntile:
            out = out.withColumn("ntile", F.ntile(ntile).over(whole).cast("long"))
        return out
    # a count skips NULL, which is one more value of the order column
    distinct = F.count_distinct(order[0]) + F.max(F.col(order[0]).isNull().cast("int"))
    state = cut.df.filter("_hot").groupBy("_k", "_slice").agg(
        F.count("*").alias("_rows"), distinct.alias("_values"))
    past = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    state = state.select(
        "_k", "_slice", F.coalesce(F.sum("_rows").over(past), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_values").over(past), F.lit(0)).alias("_values"),
        F.sum("_rows").over(Window.partitionBy("_k")).alias("_total"))
    out = out.join(state, ["_k", "_slice"], "left")
    rows, seen = F.coalesce("_rows", F.lit(0)), F.coalesce("_values", F.lit(0))
    out = (out.withColumn("row_number", F.col("row_number") + rows)
           .withColumn("rank", F.col("rank") + rows)
           .withColumn("dense_rank", F.col("dense_rank") + seen))
    if ntile:
        size = Window.partitionBy("_k", "_slice")
        total = F.coalesce("_total", F.count("*").over(size))
        small = F.floor(total / F.lit(ntile)).cast("long")
        bigger = total % F.lit(ntile)
        edge = bigger * (small + 1)
        at = F.col("row_number")
        out = out.withColumn("ntile", F.when(
            at <= edge, F.floor((at - 1) / (small + 1)) + 1).otherwise(
            bigger + F.floor((at - 1 - edge) / F.greatest(small, F.lit(1))) + 1).cast("long"))
    return cut.clean(out.drop("_rows", "_values", "_total"))
