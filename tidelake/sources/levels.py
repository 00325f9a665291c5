"""A change log as a folder of runs that are merged level by level.

Batch n adds the run ``run=n-n`` with the newest change of each of its keys. When a level has
``fanout`` runs in a row they are merged into one run of the next level, which replaces none of
them: a run of batches a to b holds what those batches left of each key. So every change is
rewritten once per level, the newest state is read from a few runs, and the state as of
an early version from the few runs that end there; no other folder is listed. Runs are made beside
the log and named in one step, so a batch that is run again adds nothing and readers see whole runs.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.sources import places


def newest(changes: DataFrame, keys, seq: str) -> DataFrame:
    """The change with the highest sequence of every key; of equal sequences the one that sorts last by all columns.

    Combines inside every task before the shuffle.
    """
    rest = [c.name for c in changes.schema if c.name != seq and not isinstance(c.dataType, T.MapType)]
    order = F.struct(F.col(seq), *[F.col(c) for c in rest])
    return changes.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("_c")).select("_c.*")


@dataclass(frozen=True)
class Log:
    """The log at ``path`` of changes to rows named by ``keys`` and ordered by ``seq``."""

    path: str
    keys: tuple
    seq: str
    fanout: int = 4

    def place(self, first: int, last: int) -> str:
        return f"{self.path}/run={first}-{last}"

    def runs(self, spark) -> set:
        """(first, last) batch of every run."""
        names = (re.search(r"run=(\d+)-(\d+)$", p) for p in places.found(spark, f"{self.path}/run=*"))
        return {(int(m[1]), int(m[2])) for m in names if m}

    def _write(self, rows: DataFrame, first: int, last: int):
        spark, beside = rows.sparkSession, f"{self.path}-staging/{uuid.uuid4().hex}"
        newest(rows, self.keys, self.seq).sortWithinPartitions(*self.keys).write.parquet(beside)
        if not places.move_new(spark, beside, self.place(first, last)):
            places.delete(spark, beside)

    def add(self, changes: DataFrame, batch: int):
        """Add the changes of a batch, numbered from 0 without gaps, and merge the runs that it completes."""
        spark = changes.sparkSession
        there = self.runs(spark)
        if (batch, batch) not in there:
            self._write(changes, batch, batch)
        size = self.fanout
        while (batch + 1) % size == 0:
            first = batch + 1 - size
            if (first, batch) not in there:
                parts = [(at, at + size // self.fanout - 1) for at in range(first, batch + 1, size // self.fanout)]
                self._write(spark.read.parquet(*(self.place(*p) for p in parts)), first, batch)
            size *= self.fanout

    def cover(self, spark, last: int | None = None) -> list:
        """The fewest runs that make up batches 0 to ``last`` (all batches without it)."""
        there = self.runs(spark)
        last = max((b for _, b in there), default=-1) if last is None else last
        chosen, at = [], 0
        while at <= last:
            ends = [b for a, b in there if a == at and b <= last]
            if not ends:
                raise ValueError(f"batch {at} is not in the log {self.path}")
            chosen.append((at, max(ends)))
            at = chosen[-1][1] + 1
        return chosen

    def read(self, spark, last: int | None = None) -> DataFrame:
        """The newest change of every key as of batch ``last``."""
        chosen = self.cover(spark, last)
        if not chosen:
            raise ValueError(f"no batch in the log {self.path}")
        return newest(spark.read.parquet(*(self.place(*run) for run in chosen)), self.keys, self.seq)

    def batches(self, spark) -> DataFrame:
        """What every batch left of its keys, with its number as ``batch``."""
        single = sorted(a for a, b in self.runs(spark) if a == b)
        rows = spark.read.parquet(*(self.place(n, n) for n in single)).select("*", F.col("_metadata.file_path").alias("_file"))
        return rows.withColumn("batch", F.regexp_extract("_file", r"run=(\d+)-\d+/", 1).cast("long")).drop("_file")

    def forget(self, spark, before: int):
        """Drop the runs that only serve versions before batch ``before``, which must end a run from batch 0 on."""
        kept = set(self.cover(spark, before))
        for a, b in self.runs(spark):
            if b <= before and (a, b) not in kept:
                places.delete(spark, self.place(a, b))
