"""Stream wiring: topic to topic, topic to table, progress, restart."""

from __future__ import annotations

import sys
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelake.operators.changes import apply_changes
from tidelake.sources.levels import Log, newest
from tidelake.sources.topics import read_topic, write_topic

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def topic_job(spark, src: str, dst: str, backend, checkpoint: str, fn=None, on_batch=None) -> StreamingQuery:
    """Start a stateless job that sends every message of ``src`` through ``fn`` into ``dst``."""
    messages = read_topic(spark, src, backend)
    changed = messages.transform(fn) if fn else messages
    return write_topic(changed.select("key", "value", "timestamp"), dst, backend, checkpoint, on_batch)


def map_elements(df: DataFrame, fn, schema, column: str | None = None) -> DataFrame:
    """Apply a Python function to each element of a one-column frame (or of ``column``).

    Use a built-in function instead where one exists.
    """
    column = column or df.columns[0]
    name = schema.fieldNames()[0] if hasattr(schema, "fieldNames") else schema.split()[0]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({name: [fn(x) for x in batch[column]]})

    return df.select(column).mapInPandas(apply, schema)


def stream_to_table(df: DataFrame, path: str, checkpoint: str, partition_by=None,
                    continuous: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet table; each committed batch is visible to batch queries.

    Runs until the input is used up, or for good with ``continuous`` (an interval
    such as "60 seconds"). A restart with the same checkpoint goes on where the
    last run stopped.
    """
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start(path)


def write_results(df: DataFrame, path: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Write each batch of an update or complete query to ``path/batch=n``, replacing it on replay."""

    def save(frame, number):
        frame.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def start_exactly_once(df: DataFrame, path: str, checkpoint: str, mode: str = "file") -> StreamingQuery:
    """A sink that neither a restart nor a repeated batch can fill twice.

    ``file`` relies on the sink's commit log, ``batch`` on one folder per batch number.
    """
    if mode == "file":
        return stream_to_table(df, path, checkpoint)
    if mode == "batch":
        return write_results(df, path, checkpoint, "append")
    raise ValueError(f"unknown mode {mode!r}")


def apply_changes_stream(changes: DataFrame, log: str, checkpoint: str, keys, seq: str) -> StreamingQuery:
    """Log the newest change of every key whenever it changes, as a levelled log.

    The highest sequence seen is kept in Spark's state, deletes included, so a change
    that arrives late loses. ``with_changes`` reads the table; no batch rewrites it.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    state = newest(changes, keys, seq)
    levels = Log(log, tuple(keys), seq)
    return (state.writeStream.outputMode("update").foreachBatch(levels.add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def with_changes(target: DataFrame, log: str, keys, seq: str, op: str, batch: int | None = None) -> DataFrame:
    """``target`` after all changes that ``apply_changes_stream`` has logged, or those up to a batch."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return apply_changes(target, Log(log, tuple(keys), seq).read(target.sparkSession, batch), keys, seq, op)


class ConsumerProgress(StreamingQueryListener):
    """Counts polls (batches) and messages; calls ``report`` every ``every`` polls and at the end."""

    def __init__(self, every: int = 10, report=print):
        self.every, self.report = every, report
        self.polls = self.messages = 0
        self._ended = threading.Event()

    def wait(self, seconds: float = 60.0) -> bool:
        """Wait until the end of a query has been reported."""
        return self._ended.wait(seconds)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.polls += 1
        self.messages += event.progress.numInputRows
        if self.polls % self.every == 0:
            self.report(f"poll {self.polls}, messages {self.messages}")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.report(f"total messages {self.messages}")
        self._ended.set()


def to_console(df: DataFrame, checkpoint: str, rows: int = 20) -> StreamingQuery:
    """Print the elements of a stream."""
    return (df.writeStream.format("console").option("numRows", rows).option("truncate", "false")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
