"""Reading, writing and arranging tables of files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators import skew
from tidelake.session import materialize
from tidelake.sources import places

BUILT_IN = ("parquet", "orc", "csv", "json", "text")


class FormatUnavailable(Exception):
    """The connector of a file format is not on the class path."""


class SchemaMismatch(Exception):
    """A frame does not fit the schema of its table."""


def read_table(spark, name: str) -> DataFrame:
    """A catalog table by name, or a Parquet folder or file by path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_files(spark, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    try:
        return (reader.schema(schema) if schema is not None else reader).load(path)
    except AnalysisException as error:
        raise _explained(error, fmt) from error


def write_table(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "append",
                partition_by=None, **options) -> None:
    """Write to a path or a catalog table.

    Partitioned output is rebalanced first: small partitions share a task and a
    hot one is split over several, so neither tiny files nor one huge file arise.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.format(fmt).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        if "/" in name:
            writer.save(name)
        else:
            writer.saveAsTable(name)
    except AnalysisException as error:
        raise _explained(error, fmt) from error


def _explained(error, fmt):
    if fmt in BUILT_IN or not ("DATA_SOURCE" in (error.getCondition() or "") or "data source" in str(error)):
        return error
    return FormatUnavailable(f"no connector for format {fmt!r} on the class path: {error}")


def write_bucketed(df: DataFrame, table: str, buckets: int, column: str, path: str) -> None:
    """Hash-bucketed table at ``path``: equal buckets join on ``column`` without a shuffle.

    Rows are shuffled by the bucket column first, so a bucket is one file; the rows of hot
    keys are left where they are, a file for each task and key.
    """
    hot = materialize(skew.hot_groups(df, [column]).select(column), "hot")
    if not hot.isEmpty():
        rest = df.join(hot, df[column].eqNullSafe(hot[column]), "left_anti").repartition(buckets, column)
        df = rest.unionByName(df.join(hot, df[column].eqNullSafe(hot[column]), "left_semi"))
    else:
        df = df.repartition(buckets, column)
    df.write.format("parquet").mode("overwrite").bucketBy(buckets, column).sortBy(column).option(
        "path", path).saveAsTable(table)


def join_bucketed(spark, left, right, left_key: str, right_key: str, min_rows=None) -> DataFrame:
    """Inner join of two bucketed tables, each given as (table, path), on their bucket columns.

    A bucket is read by one task, so the hot keys of either side are joined apart from
    the rest: read as plain files, which split, and shuffled with skew handling.
    """
    plain = [spark.read.parquet(side[1]) for side in (left, right)]
    found = [skew.hot_groups(side, [name], min_rows).select(F.col(name).alias("_hot_key"))
             for side, name in zip(plain, (left_key, right_key))]
    hot = materialize(found[0].union(found[1]).filter(F.col("_hot_key").isNotNull()).distinct(), "hot")
    on = F.col(left_key) == F.col(right_key)
    if hot.isEmpty():
        return spark.table(left[0]).join(spark.table(right[0]), on)

    def part(side, name, how):
        return side.join(hot, F.col(name) == F.col("_hot_key"), how)

    cold = part(spark.table(left[0]), left_key, "left_anti").join(part(spark.table(right[0]), right_key, "left_anti"), on)
    return cold.unionByName(part(plain[0], left_key, "left_semi").join(part(plain[1], right_key, "left_semi"), on))


CSV_TEXT = dict(header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false",
                ignoreTrailingWhiteSpace="false", lineSep="\n", emptyValue='""')


def load_documents(spark, path: str, fmt: str = "csv", schema=None, **options) -> DataFrame:
    """Text records with a declared schema; a malformed record raises."""
    if schema is None:
        raise ValueError("documents need a declared schema")
    if fmt == "csv":
        settings = {k: v for k, v in CSV_TEXT.items() if k not in ("lineSep", "emptyValue")}
        options = {**settings, "multiLine": "true", "mode": "FAILFAST", "emptyValue": "", **options}
    elif fmt == "json":
        options = {"mode": "FAILFAST", **options}
    return read_files(spark, path, fmt, schema, **options)


def enforce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the types and order of ``schema``; raises when columns or fields inside
    them are missing, extra or not castable without loss."""
    problems = list(_differences(df.schema, schema))
    if problems:
        raise SchemaMismatch(", ".join(problems))
    try:
        return df.to(schema)
    except AnalysisException as error:
        raise SchemaMismatch(str(error)) from error


def _differences(have, want, path=""):
    """Fields that only one of two types has, at any depth."""
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        old, new = set(have.fieldNames()), set(want.fieldNames())
        yield from (f"missing {path}{c}" for c in sorted(new - old))
        yield from (f"extra {path}{c}" for c in sorted(old - new))
        for c in sorted(old & new):
            yield from _differences(have[c].dataType, want[c].dataType, f"{path}{c}.")
    elif isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        yield from _differences(have.elementType, want.elementType, path)
    elif isinstance(have, T.MapType) and isinstance(want, T.MapType):
        yield from _differences(have.keyType, want.keyType, path)
        yield from _differences(have.valueType, want.valueType, path)


def union_evolved(*parts: DataFrame) -> DataFrame:
    """Old and new layouts of a table as one; columns an old part lacks read NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_by_time(df: DataFrame, path: str, ts_col: str, part_col: str, unit: str = "day") -> None:
    """Partition by a transform (day or month) of a time column."""
    part = F.trunc(ts_col, "month") if unit == "month" else F.to_date(ts_col)
    write_table(df.withColumn(part_col, part), path, partition_by=[part_col], mode="overwrite")


def read_by_time(df: DataFrame, ts_col: str, part_col: str, lo, hi, unit: str = "day") -> DataFrame:
    """Rows with ``lo <= ts < hi``; also filters the derived column, which prunes folders.

    ``unit`` is the coarsest unit the table was written with: a month column holds first
    days, which day values of the same column never precede. A part of a mixed table that
    lacks the column reads NULL there and is not pruned.
    """
    lo, hi = F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")
    first = F.trunc(lo, "month") if unit == "month" else F.to_date(lo)
    part = F.col(part_col)
    return df.filter((F.col(ts_col) >= lo) & (F.col(ts_col) < hi)
                     & (part.isNull() | ((part >= first) & (part <= F.to_date(hi)))))


def read_layouts(spark, paths, drop=()) -> DataFrame:
    """One table over folders written with different partition columns."""
    return union_evolved(*[spark.read.parquet(p) for p in paths]).drop(*drop)


def retain(df: DataFrame, ts_col: str, hours: int = 168) -> DataFrame:
    """Rows younger than ``hours``, measured from the newest row."""
    newest = df.agg((F.max(ts_col) - F.expr(f"INTERVAL {int(hours)} HOURS")).alias("edge"))
    return df.filter(F.col(ts_col) > newest.scalar())


def profile(df: DataFrame, cols=None) -> DataFrame:
    """Per column: rows, nulls, exact distinct values, min and max (as text).

    Every column is counted by value on its own column-pruned scan, so only
    distinct values are shuffled and a frequent value is one row per task.
    """
    parts = []
    for c in cols or df.columns:
        values = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        parts.append(values.agg(
            F.sum("n").alias("n_rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_nulls"),
            F.count("v").alias("n_distinct"), F.min("v").cast("string").alias("min_value"),
            F.max("v").cast("string").alias("max_value")).select(F.lit(c).alias("column_name"), "*"))
    return reduce(DataFrame.unionByName, parts)


# relative error of the sketches: distinct values (HLL with 2 ** LG entries) and ranks of quantiles (KLL)
HLL_LG, KLL_K = 12, 200


def _file_stats(df: DataFrame, cols) -> DataFrame:
    """Per file and column: rows, nulls, smallest and largest value as text, a sketch of distinct values and one of quantiles."""
    named = df.select(F.col("_metadata.file_path").alias("file"), *cols)
    parts = []
    for c in cols:
        numeric = isinstance(named.schema[c].dataType, T.NumericType)
        value = F.col(c)
        counted = value if isinstance(named.schema[c].dataType, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else value.cast("string")
        kll = F.kll_sketch_agg_double(value.cast("double"), KLL_K) if numeric else F.lit(None).cast("binary")
        parts.append(named.groupBy("file").agg(
            F.count("*").alias("n_rows"), (F.count("*") - F.count(c)).alias("n_nulls"), F.min(c).cast("string").alias("min_text"),
            F.max(c).cast("string").alias("max_text"), F.min(value.cast("double") if numeric else F.lit(None).cast("double")).alias("min_number"),
            F.max(value.cast("double") if numeric else F.lit(None).cast("double")).alias("max_number"),
            F.hll_sketch_agg(counted, HLL_LG).alias("distinct_sketch"), kll.alias("quantile_sketch")).select(F.lit(c).alias("column_name"), "*"))
    return reduce(DataFrame.unionByName, parts)


def add_stats(spark, path: str, stats: str, cols) -> int:
    """Read the files of a Parquet table that ``stats`` does not know and add their statistics; gives the number of new files.

    Files never change, so a file is read once however often the table grows.
    """
    def plain(name):  # file:/a and file:///a are one place
        return re.sub(r"^(\w+):/+", r"\1:/", name)

    known = set()
    if places.exists(spark, stats):
        known = {plain(r["file"]) for r in spark.read.parquet(stats).select("file").distinct().collect()}
    new = sorted(f for f in spark.read.parquet(path).inputFiles() if plain(f) not in known)
    if new:
        _file_stats(spark.read.option("basePath", path).parquet(*new), list(cols)).write.mode("append").parquet(stats)
    return len(new)


def table_stats(spark, stats: str, quantiles=(0.5,)) -> DataFrame:
    """Per column the exact rows, nulls, smallest and largest value, and estimates of distinct values and quantiles.

    Made of the files' statistics alone. Distinct values are off by 1.6 % (one standard deviation of a sketch of
    4096 entries), the rank of a quantile by about 1.7 %.
    """
    rows = spark.read.parquet(stats)
    merged = rows.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), F.min("min_number").alias("min_number"),
        F.max("max_number").alias("max_number"), F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"),
        F.kll_merge_agg_double("quantile_sketch").alias("_k"))
    number = F.col("max_number").isNotNull()
    found = [F.when(number, F.kll_sketch_get_quantile_double("_k", F.lit(float(q)))).alias(f"quantile_{str(q).replace('.', '_')}") for q in quantiles]
    return merged.select("column_name", "n_rows", "n_nulls", "n_distinct", "min_number", "max_number",
                         F.when(~number, F.col("min_text")).alias("min_text"), F.when(~number, F.col("max_text")).alias("max_text"), *found)


def analyze(spark, table: str) -> None:
    """Store table and column statistics for the optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
