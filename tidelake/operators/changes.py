"""Row-level changes and versions. Every function gives new table content;
writing it (to a new place) is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators import skew
from tidelake.session import materialize
from tidelake.sources.levels import Log, newest


def insert_if_absent(target: DataFrame, source: DataFrame, key: str, order_col: str):
    """Rows to append, and a report of every source row as inserted or skipped.

    Per key the first source row in ``order_col`` counts (NULL first, ties by the other
    columns), and only when the target lacks the key; existing rows never change. A NULL
    key raises. The source is written once, so that each of its rows has a fixed number.
    """
    names = [c for c in source.columns if c != order_col]
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"NULL in key column {key}")).cast(
        source.schema[key].dataType)).otherwise(F.col(key))
    source = materialize(source.withColumn(key, checked).withColumn("_row", F.monotonically_increasing_id()), "source")
    # min of a struct combines inside every task first, so a hot key is no hot task
    ordered = [order_col, *[c for c in names if not isinstance(source.schema[c].dataType, T.MapType)]]
    payload = [c for c in names if isinstance(source.schema[c].dataType, T.MapType)]
    if payload:
        first = source.groupBy(key).agg(F.min_by(F.struct("*"), F.struct(*ordered, "_row")).alias("_f"))
    else:
        first = source.groupBy(key).agg(F.min(F.struct(*ordered, "_row")).alias("_f"))
    present = target.select(key).distinct()
    fresh = first.join(present, key, "left_anti")
    new_rows = fresh.select(*[F.col(f"_f.{c}").alias(c) for c in names])
    winners = fresh.select(key, F.col("_f._row").alias("_first"))
    inserted = F.coalesce(F.col("_row") == F.col("_first"), F.lit(False))
    report = source.join(winners, key, "left").select(
        key, order_col, F.when(inserted, F.lit("inserted")).otherwise(F.lit("skipped")).alias("status"))
    return new_rows, report


def merge_into(target: DataFrame, source: DataFrame, keys, update_cols, delete_when: Column | None = None):
    """Target content after a merge.

    Matched rows are deleted where ``delete_when`` (over source columns) holds and
    otherwise take ``update_cols`` from the source. Unmatched source rows are
    inserted, unmatched target rows stay. Two source rows for one target row raise.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    flag = F.coalesce(delete_when, F.lit(False)) if delete_when is not None else F.lit(False)
    marked = source.withColumn("_drop", flag)
    # one row per key; the count is checked where a target row matches
    names = source.columns
    single = marked.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct("*")).alias("_s"))
    t = target.alias("t")
    matched = t.join(single.alias("s"), keys, "left")
    twice = F.raise_error(F.lit("more than one source row matches a target row")).cast("boolean")
    gone = F.when(F.col("_n") > 1, twice).otherwise(F.coalesce(F.col("_s._drop"), F.lit(False)))
    hit = F.col("_n").isNotNull()
    updated = [F.when(hit, F.col(f"_s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in update_cols
               else F.col(c if c in keys else f"t.{c}").alias(c) for c in target.columns]
    kept = matched.filter(~gone).select(*updated)
    fresh = source.join(target.select(*keys).distinct(), keys, "left_anti")
    inserted = fresh.select(*[F.col(c) if c in names else F.lit(None).cast(target.schema[c].dataType).alias(c)
                              for c in target.columns])
    return kept.unionByName(inserted)


def update_where(df: DataFrame, predicate: Column, assignments: dict) -> DataFrame:
    """Set columns on matching rows; a NULL predicate is no match."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.select(*[
        F.when(hit, value).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c)
        if (value := assignments.get(c)) is not None else F.col(c) for c in df.columns])


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Drop rows whose predicate is true; false and NULL stay."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def as_of(log: DataFrame, keys, version_col: str, op: str, v) -> DataFrame:
    """Table content as of version ``v`` of an append-only change log."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    v = v if isinstance(v, Column) else F.lit(v)
    return newest(log.filter(F.col(version_col) <= v), keys, version_col).filter(F.col(op) != "delete")


def apply_changes(target: DataFrame, changes: DataFrame, keys, seq: str, op: str) -> DataFrame:
    """Target content after the changes: per key the highest sequence wins, deletes go."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    last = newest(changes, keys, seq)
    untouched = target.join(last.select(*keys), keys, "left_anti")
    written = last.filter(F.col(op) != "delete").select(*target.columns)
    return untouched.unionByName(written)


def as_of_batch(log: Log, spark, op: str, batch: int | None = None) -> DataFrame:
    """Table content as of a batch of a levelled log, from the few runs that end there."""
    return log.read(spark, batch).filter(F.col(op) != "delete")


def list_snapshots(log: DataFrame, keys, version_col: str, op: str, order_col: str | None = None,
                   min_rows=None) -> DataFrame:
    """Per version: inserts, updates, deletes and the rows live afterwards.

    A write to a key that is absent or was deleted is an insert; deleting an
    absent key counts as nothing. ``order_col`` orders changes inside a version.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order_col or version_col]
    seen = skew.scan(log.select(*{*keys, version_col, op, *order}), keys, order,
                     prev={"_before": F.col(op)}, min_rows=min_rows)
    live = F.coalesce(F.col("_before") != "delete", F.lit(False))
    gone = F.col(op) == "delete"

    def total(condition):
        return F.sum(condition.cast("long"))

    versions = seen.groupBy(version_col).agg(
        total(~gone & ~live).alias("inserts"), total(~gone & live).alias("updates"),
        total(gone & live).alias("deletes"))
    # one small row per version, read several times below
    versions = materialize(versions, "versions")
    return skew.scan(versions, [], [version_col], sums={"live_rows": F.col("inserts") - F.col("deletes")},
                     min_rows=min_rows)
