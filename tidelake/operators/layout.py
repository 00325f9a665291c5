"""How rows are laid out in files."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.session import materialize


def spread_bits(column: int, columns: int, bits: int) -> list:
    """For every rank of a column the number whose bits, highest first, take turns with the other columns' bits."""
    if bits * columns > 62:
        raise ValueError("too many bits for one long")
    return [sum((rank >> place & 1) << (place * columns + columns - 1 - column) for place in range(bits)) for rank in range(1 << bits)]


def interleave(ranks, bits: int) -> Column:
    """Bits of the rank columns taken in turn, highest first."""
    parts = [F.get(F.lit(np.array(spread_bits(i, len(ranks), bits))), F.col(rank).cast("int")) for i, rank in enumerate(ranks)]
    return reduce(lambda a, b: a + b, parts)


# rows of the sample that gives the range boundaries
SAMPLE_ROWS = 20_000


def boundaries(df: DataFrame, cols, ranges: int, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Per column up to ``ranges - 1`` ascending values that cut it into ranges of about equal size.

    They are whole values of a sample of about ``sample_rows`` rows, chosen by a hash of the row.
    """
    picked = df.select(*cols)
    total = df.count()
    if total > sample_rows:
        share = F.pmod(F.xxhash64(*cols, F.monotonically_increasing_id()), F.lit(1 << 30)) / F.lit(float(1 << 30))
        picked = picked.filter(share < sample_rows / total)
    picked = materialize(picked, "sample")
    found = {}
    for c in cols:
        place = F.percent_rank().over(Window.partitionBy(F.lit(0)).orderBy(c))
        step = F.least(F.floor(place * ranges), F.lit(ranges - 1))
        lows = picked.filter(F.col(c).isNotNull()).select(c, step.alias("_step")).groupBy("_step").agg(F.min(c).alias("low"))
        # a row per range at most
        found[c] = [r["low"] for r in lows.select("low").distinct().orderBy("low").collect()][1:]
    return found


def range_rank(column: Column, edges: list) -> Column:
    """How many of the ascending ``edges`` a value has reached, by halving; NULL reaches none."""
    if not edges:
        return F.lit(0)
    known, steps = F.lit(edges), [1 << i for i in reversed(range(len(edges).bit_length()))]

    def further(at, step):
        return F.when(F.get(known, at + step - 1) <= column, at + step).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), further)


def zorder(df: DataFrame, cols, bits: int = 8, partitions: int | None = None) -> DataFrame:
    """The same rows, clustered on several columns by interleaved range ranks.

    Ranges hold about equally many rows of a sample; their edges are whole values of any type
    that Spark can sort. Rows that share all ranks are ordered by the columns themselves, so a
    frequent combination is cut further.
    """
    cols = list(cols)
    edges = boundaries(df, cols, 2 ** bits)
    names = [f"_r_{c}" for c in cols]
    ranked = df
    for name, c in zip(names, cols):
        # few ranges are spread over all bits, so that every column weighs the same
        rank = range_rank(F.col(c), edges[c])
        ranked = ranked.withColumn(name, F.floor(rank * F.lit(2 ** bits) / F.lit(len(edges[c]) + 1)).cast("int"))
    ranked = ranked.withColumn("_z", interleave(names, bits))
    by = ["_z", *cols]
    spread = ranked.repartitionByRange(partitions, *by) if partitions else ranked.repartitionByRange(*by)
    return spread.sortWithinPartitions(*by).drop("_z", *names)


def _folder_bytes(spark, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(place).getLength()


def files_for(spark, path: str, target_bytes: int = 256 << 20) -> int:
    """How many files of ``target_bytes`` hold what lies under ``path``."""
    return max(1, math.ceil(_folder_bytes(spark, path) / target_bytes))


# with this many splits for each file, coalesced files differ by a split at most
SPLITS_PER_FILE = 2


def compact(spark, src: str, dst: str, target_bytes: int = 256 << 20) -> int:
    """Rewrite the Parquet files under ``src`` as about equal ones at ``dst``; gives their number.

    A task reads the splits that make up its file, about ``target_bytes`` of Parquet; rows, several times
    as large outside their files, are shuffled only where the input comes in too few splits to be dealt out.
    """
    n = files_for(spark, src, target_bytes)
    rows = spark.read.parquet(src)
    rows = rows.coalesce(n) if n == 1 or rows.rdd.getNumPartitions() >= SPLITS_PER_FILE * n else rows.repartition(n)
    rows.write.mode("errorifexists").parquet(dst)
    return n
