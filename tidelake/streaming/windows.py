"""Event-time operators that serve batch and stream frames alike."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.operators import skew


def with_event_time(df: DataFrame, ts_col: str, delay: str | None) -> DataFrame:
    """``ts_col`` as a zoned timestamp, with a watermark when the frame streams."""
    timed = df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return timed.withWatermark(ts_col, delay) if delay and timed.isStreaming else timed


def window_agg(df: DataFrame, ts_col: str, keys, aggs, size: str | None = None, slide: str | None = None,
               gap: str | None = None, delay: str | None = None, min_rows=None) -> DataFrame:
    """Aggregate per key and tumbling (``size``), hopping (``size``, ``slide``) or session
    (``gap``) window. Gives window_start, window_end (zone-less), the keys and the aggregates.

    An event exactly ``gap`` after the one before belongs to the same session.
    """
    if (size is None) == (gap is None):
        raise ValueError("give either size or gap")
    timed = with_event_time(df, ts_col, delay)
    if gap and not timed.isStreaming:
        return _batch_sessions(timed, ts_col, keys, aggs, gap, min_rows)
    span = F.session_window(ts_col, gap) if gap else F.window(ts_col, size, slide or size)
    grouped = timed.groupBy(span.alias("w"), *keys).agg(*aggs)
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                          F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                          *keys, *[c for c in grouped.columns if c not in ("w", *keys)])


def pane_agg(df: DataFrame, ts_col: str, keys, parts: dict, size: str, slide: str, delay: str | None = None, finals: dict | None = None) -> DataFrame:
    """Aggregate per key and hopping window from panes of ``slide``; no row is copied to the windows it lies in.

    ``parts`` maps a name to (aggregate of rows, function of the pane column that adds panes up), such as
    ``(F.count("*"), F.sum)``; ``finals`` to columns over these. Every event enters one pane, and a window adds
    up its panes: state and shuffle hold a row per pane instead of one per window. ``size`` is a whole number of slides.
    """
    if pd.Timedelta(size).value % pd.Timedelta(slide).value:
        raise ValueError("a window is a whole number of panes")
    timed = with_event_time(df, ts_col, delay)
    panes = timed.groupBy(F.window(ts_col, slide).alias("_pane"), *keys).agg(*[rows.alias(name) for name, (rows, _) in parts.items()])
    grouped = panes.groupBy(F.window("_pane", size, slide).alias("w"), *keys).agg(*[add(F.col(name)).alias(name) for name, (_, add) in parts.items()])
    rest = [c.alias(name) for name, c in (finals or {}).items()]
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                          F.col("w.end").cast("timestamp_ntz").alias("window_end"), *keys,
                          *[F.col(name) for name in parts if name not in (finals or {})], *rest)


def _batch_sessions(df, ts_col, keys, aggs, gap, min_rows):
    """Sessions numbered along each key's rows, then grouped: a hot key is no hot task."""
    keys, reach = list(keys), F.expr(f"INTERVAL {gap}")
    df = df.filter(F.col(ts_col).isNotNull())  # as session_window does
    seen = skew.scan(df, keys, [ts_col], prev={"_before": F.col(ts_col)}, min_rows=min_rows)
    joins = F.coalesce(F.col(ts_col) <= F.col("_before") + reach, F.lit(False)).cast("int")
    # at equal times the row that opens the session comes first
    numbered = skew.scan(seen.withColumn("_joins", joins), keys, [ts_col, "_joins"],
                         sums={"_session": 1 - F.col("_joins")}, min_rows=min_rows)
    grouped = numbered.groupBy(*keys, "_session").agg(
        F.min(ts_col).alias("_first"), F.max(ts_col).alias("_last"), *aggs)
    return grouped.select(F.col("_first").cast("timestamp_ntz").alias("window_start"),
                          (F.col("_last") + reach).cast("timestamp_ntz").alias("window_end"),
                          *keys, *[c for c in grouped.columns if c not in ("_session", "_first", "_last", *keys)])


def dedup(df: DataFrame, keys, ts_col: str, within: str, min_rows=None) -> DataFrame:
    """One row per key and time: a copy no later than ``within`` after the copy before it is dropped.

    Batch frames look at each key's rows in time order; rows without a time are copies of one
    another. In a stream every Arrow batch
    drops its own copies before the shuffle, so a message repeated very often does not
    send all its copies to one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not df.isStreaming:
        rows = df.withColumn("_tie", F.xxhash64(*df.columns))
        seen = skew.scan(rows, keys, [ts_col, "_tie"], prev={"_before": F.struct(ts_col)}, min_rows=min_rows)
        before = F.col("_before")[ts_col]
        late = F.col(ts_col) > before + F.expr(f"INTERVAL {within}")
        first = F.col("_before").isNull() | (before.isNull() & F.col(ts_col).isNotNull()) | late
        return seen.filter(F.coalesce(first, F.lit(False))).drop("_tie", "_before")

    def local(batches):
        for batch in batches:
            yield batch.filter(pa.array(~batch.select(keys).to_pandas().duplicated().to_numpy()))

    timed = df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    thinned = timed.mapInArrow(local, timed.schema)
    return thinned.withWatermark(ts_col, within).dropDuplicatesWithinWatermark(keys)


def running_count(df: DataFrame, key: str, value: str, ts_col: str) -> DataFrame:
    """Per key the number of rows and the newest value (of equal times the largest), kept as state.

    The state is a count and one value, combined inside each task before the shuffle.
    """
    return df.groupBy(key).agg(F.count("*").alias("n"), F.max_by(F.col(value), F.struct(ts_col, value)).alias("last_value"))


def late_rows(df: DataFrame, ts_col: str, newest, delay: str) -> DataFrame:
    """Rows behind the watermark of ``newest`` (the greatest event time already seen)."""
    return df.filter(F.col(ts_col).cast("timestamp") < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}"))


def keep_late(stream: DataFrame, ts_col: str, delay: str, path: str, checkpoint: str, size: str | None = None):
    """Start a query that keeps the rows which come behind the watermark, with the watermark they missed.

    The mark of a batch is the one that Spark has written to the query's offset log, so a batch that runs again
    keeps the same rows. With ``size`` a row is late when its tumbling window is closed, as for ``window_agg``.
    Rows land in ``path/batch=n``; a batch without late rows writes an empty part.
    """
    timed = with_event_time(stream, ts_col, delay)
    due = F.window(ts_col, size)["end"] if size else F.col(ts_col)

    def save(frame, number):
        spark = frame.sparkSession
        lines = spark.read.text(f"{checkpoint}/offsets/{number}").select(
            F.get_json_object("value", "$.batchWatermarkMs").cast("long").alias("ms"))
        mark = F.timestamp_millis(F.lit(lines.agg(F.max("ms")).first()[0] or 0))
        late = due <= mark if size else due < mark
        frame.filter(late).withColumn("watermark", mark).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (timed.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# a dimension up to this many bytes is sent to every task
SMALL_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> int:
    """Bytes of all rows of a frame as JSON text."""
    size = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    return df.select(size.alias("b")).agg(F.sum("b")).first()[0] or 0


@dataclass(frozen=True)
class HotKeys:
    """The frequent values of a column, from sketches of the batches seen so far below ``path``.

    Each batch adds a sketch of at most ``tracked`` values, made inside every task and merged; a value counts as
    hot from ``share`` of all rows on. Nothing is collected but the few hot values.
    """

    path: str
    key: str
    share: float = 0.02
    tracked: int = 10_000

    def learn(self, frame: DataFrame, batch: int = 0):
        """Add a batch; the same number replaces itself."""
        # grouped by a constant, for a task without rows has no sketch
        rows = frame.filter(F.col(self.key).isNotNull()).select(F.col(self.key).alias("k")).groupBy(F.lit(0).alias("all"))
        sketch = F.expr(f"approx_top_k_accumulate(k, {self.tracked})")
        rows.agg(sketch.alias("sketch"), F.count("*").alias("n")).drop("all").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def watch(self, stream: DataFrame, checkpoint: str):
        """Start a query that learns from every batch of a stream."""
        return (stream.select(self.key).writeStream.foreachBatch(self.learn).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())

    def values(self, spark) -> list:
        """The hot values, most frequent first."""
        most = max(1, int(1 / self.share))
        seen = spark.read.parquet(self.path).groupBy(F.lit(0).alias("all"))
        top = F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch), {most})")
        found = seen.agg(top.alias("top"), F.sum("n").alias("n")).select(
            F.explode("top").alias("t"), "n").filter(F.col("t.count") >= F.col("n") * self.share)
        return [r["item"] for r in found.select("t.item", "t.count").orderBy(F.desc("count")).collect()]


def enrich(stream: DataFrame, dimension: DataFrame, key: str, dimension_key: str, how: str = "left",
           small_bytes: int = SMALL_BYTES, hot=(), salts: int = 32) -> DataFrame:
    """Join a stream with a static table on one key, ``inner`` or ``left``.

    Gives the stream's columns, then the dimension's; a dimension key of the same name
    is left out, other equal names raise. A dimension of at most ``small_bytes`` is
    broadcast. A larger one is shuffled by key; the dimension rows of the values in ``hot``, a list or what
    ``HotKeys`` has learnt when the query starts, are repeated ``salts`` times and the stream's rows of these
    values spread over the copies, because a running query cannot split the task of a hot key. Rows
    without a key match nothing and are spread as well.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"a stream is joined 'inner' or 'left', not {how!r}")
    extra = [c for c in dimension.columns if not (c == dimension_key == key)]
    if set(extra) & set(stream.columns):
        raise ValueError(f"columns on both sides: {sorted(set(extra) & set(stream.columns))}")
    side = dimension.select(F.col(dimension_key).alias("_key"), *[F.col(c).alias(f"_d_{c}") for c in extra])
    given = [*stream.columns, *[F.col(f"_d_{c}").alias(c) for c in extra]]
    if row_bytes(dimension) <= small_bytes:
        return stream.join(F.broadcast(side), F.col(key) == F.col("_key"), how).select(*given)
    hot = hot.values(stream.sparkSession) if isinstance(hot, HotKeys) else list(hot)
    spread_, copy = F.pmod(F.xxhash64(*stream.columns), F.lit(salts)).cast("int"), F.lit(0)
    salt = F.when(F.col(key).isNull(), spread_).otherwise(0)
    if hot:
        salt = F.when(F.col(key).isNull() | F.col(key).isin(hot), spread_).otherwise(0)
        copy = F.explode(F.when(F.col("_key").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    spread, copies = stream.withColumn("_salt", salt), side.withColumn("_copy", copy)
    joined = spread.join(copies, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_copy")), how)
    return joined.select(*given)


def alerts(windowed: DataFrame, column: str, threshold) -> DataFrame:
    """Windows whose aggregate is above a threshold."""
    return windowed.filter(F.col(column) > threshold)


def stream_sql(df: DataFrame, view: str, text: str, **args) -> DataFrame:
    """SQL text over a stream (or any frame) registered as ``view``."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(text, args=args or None)
