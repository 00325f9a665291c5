"""Rows of a stream in event-time order, kept in Spark's state by bucket of keys and slice of time.

Two stateful steps follow each other. The first groups rows by (bucket, slice): a key that a third of
all events have is cut by time, so a task holds the rows of one slice. When the watermark passes rows
of a slice, their step is computed inside the slice; what needs the past or the future of a key
beyond it is flagged. The second step groups by (bucket, lane): it keeps a small memory per key,
completes the flagged rows and lets all others through in lanes of their own.

Rows may arrive out of order by the watermark's delay; later ones are left out, as by windows.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 32
LANES = 8


def tuples(rows: pd.DataFrame) -> list:
    """Rows as plain values, with None for what is missing."""
    columns = [rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in rows.columns]
    return list(zip(*columns))


class Slices(StatefulProcessor):
    """Holds the rows of a (bucket, slice) until the watermark passes them, then gives ``step(rows)``.

    ``rows`` are a pandas frame in the order of key, time and tie; the state is a list of
    rows, a timer stands at the first of them.
    """

    def __init__(self, schema: str, step):
        self.schema, self.step = schema, step
        self.names = [field.strip().split()[0] for field in schema.split(",")]

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)

    def wait(self, rows: pd.DataFrame):
        self.handle.registerTimer(int(rows["us"].min()) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            frame = frame.loc[frame["us"] > mark, self.names]
            if len(frame):
                self.waiting.appendList(tuples(frame))
                self.wait(frame)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.names)
        ready = (rows["us"] <= mark).to_numpy(dtype=bool)
        if not ready.any():
            return
        if ready.all():
            self.waiting.clear()
        else:
            self.waiting.put(tuples(rows[~ready]))
            self.wait(rows[~ready])
        done = rows[ready].sort_values(["k", "us", "tie"], kind="stable", na_position="first").reset_index(drop=True)
        out = self.step(done)
        yield out.assign(bucket=np.int32(key[0]), slice=np.int64(key[1]))

    def close(self):
        pass


def sliced(df: DataFrame, key: str, ts_col: str, tie: str, delay: str, width: str, buckets: int, extra: dict,
           step, added: str) -> DataFrame:
    """The output of the first step: bucket, slice, k, us, tie, ``extra``, payload and what ``step`` adds.

    All columns of ``df`` travel as one JSON text; times as microseconds.
    """
    timed = df.filter(F.col(ts_col).isNotNull()).withColumn("_at", F.col(ts_col).cast("timestamp")).withWatermark("_at", delay)
    us = F.unix_micros("_at")
    rows = timed.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), us.alias("us"), "_at",
        F.col(key).cast("string").alias("k"), F.col(tie).alias("tie"), *[e.alias(c) for c, e in extra.items()],
        F.to_json(F.struct(*[F.unix_micros(F.col(c.name).cast("timestamp")).alias(c.name) if is_time(c) else F.col(c.name)
                             for c in df.schema])).alias("payload"))
    rows = rows.withColumn("slice", F.floor(F.col("us") / F.lit(micros(width))).cast("long"))
    held = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ["k", "us", "tie", *extra, "payload"])
    return rows.groupBy("bucket", "slice").transformWithStateInPandas(
        Slices(held, step), f"bucket int, slice long, {held}, {added}", "Append", "EventTime")


def is_time(field) -> bool:
    return isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType))


def micros(width: str) -> int:
    return int(pd.Timedelta(width).value // 1000)


def unpacked(rows: DataFrame, schema: T.StructType, added: list) -> DataFrame:
    """The columns of ``schema`` from the payload, and ``added``."""
    stored = T.StructType([T.StructField(f.name, T.LongType() if is_time(f) else f.dataType) for f in schema])
    parsed = rows.withColumn("_row", F.from_json("payload", stored))
    back = [F.timestamp_micros(F.col("_row")[f.name]).cast(f.dataType).alias(f.name) if is_time(f) else F.col("_row")[f.name].alias(f.name)
            for f in schema]
    return parsed.select(*back, *added)


def run_numbers(rows: pd.DataFrame):
    """(place of each row among the rows of its key, rows of its key), for rows in key order."""
    k = rows["k"].fillna("").to_numpy(dtype=object)
    missing = rows["k"].isna().to_numpy()
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (missing[1:] != missing[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(rows)))
    return np.arange(len(rows)) - np.repeat(starts, sizes), np.repeat(sizes, sizes), starts


def previous_stats(values: np.ndarray, n: int):
    """(mean, sample deviation, count) of the values among the ``n`` entries before each; the first n entries are the past."""
    return window_stats(np.lib.stride_tricks.sliding_window_view(values[:-1], n))


def window_stats(seen: np.ndarray):
    """(mean, sample deviation, count) of the values in each row of a matrix."""
    count = (~np.isnan(seen)).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.nansum(seen, axis=1) / count
        sd = np.sqrt(np.nansum((seen - mean[:, None]) ** 2, axis=1) / (count - 1))
    return np.where(count > 0, mean, np.nan), np.where(count > 1, sd, np.nan), count


STATS = "flags int, mean double, sd double, n int"


# keys of a bucket are remembered in this many parts, each one entry of the state
PARTS = 256

# windows that are computed at once
WINDOWS = 50_000


class Memory(StatefulProcessor):
    """Completes the first rows of each slice with the last ``n`` values before it.

    They are kept for a part of the keys in one entry of a map, so a batch asks the state once for
    each part and not for each key; a part's entry holds its keys' values one after the other.
    """

    def __init__(self, n: int):
        self.n = n

    def init(self, handle):
        self.last = handle.getMapState("last", "part int", "k array<string>, v array<double>")

    def held(self, part: int) -> dict:
        if not self.last.containsKey((part,)):
            return {}
        keys, values = self.last.getValue((part,))
        return dict(zip(keys, np.array(values, dtype=float).reshape(len(keys), self.n)))

    def handleInputRows(self, key, rows, timerValues):
        flagged = []
        for frame in rows:
            plain = frame["flags"] == 0
            if plain.any():
                yield frame[plain].drop(columns=["lane"])
            if not plain.all():
                flagged.append(frame[~plain])
        if not flagged:
            return
        n = self.n
        rows = pd.concat(flagged, ignore_index=True).sort_values(["k", "us", "tie"], kind="stable", na_position="first").reset_index(drop=True)
        _, sizes, starts = run_numbers(rows)
        names = [k if isinstance(k, str) else None for k in rows["k"].iloc[starts]]
        parts = [zlib.crc32((name or "").encode()) % PARTS for name in names]
        known = {part: self.held(part) for part in set(parts)}
        # the past of each key stands before its rows
        first = starts + n * np.arange(len(starts))
        at = np.arange(len(rows)) + n * np.repeat(np.arange(1, len(starts) + 1), sizes[starts])
        line = np.full(len(rows) + n * len(starts), np.nan)
        line[at] = rows["v"].to_numpy(dtype=float)
        for low, part, name in zip(first.tolist(), parts, names):
            if name in known[part]:
                line[low:low + n] = known[part][name]
        mean, sd, count = (rows[c].to_numpy(dtype=float, copy=True) for c in ("mean", "sd", "n"))
        heads = np.flatnonzero((rows["flags"] & 1).to_numpy() == 1)
        for low in range(0, len(heads), WINDOWS):
            some = heads[low:low + WINDOWS]
            mean[some], sd[some], count[some] = window_stats(line[at[some][:, None] + np.arange(-n, 0)])
        for end, part, name in zip((first + n + sizes[starts]).tolist(), parts, names):
            known[part][name] = line[end - n:end]
        for part, kept in known.items():
            values = np.concatenate(list(kept.values()))
            self.last.updateValue((part,), (list(kept), [None if np.isnan(x) else x for x in values.tolist()]))
        yield rows.assign(mean=mean, sd=sd, n=count.astype(np.int32)).drop(columns=["lane"])

    def close(self):
        pass


def anomaly_stream(df: DataFrame, key: str, ts_col: str, value: str, n: int, k: float, tie: str, delay: str,
                   width: str = "1 day", buckets: int = BUCKETS, lanes: int = LANES) -> DataFrame:
    """Flag anomalies in a stream as the batch operator does, once the watermark has passed a row.

    A row's ``n`` predecessors lie inside its slice but for the first ``n`` rows of a key there; for those the
    second step keeps the last ``n`` values of each key. It is sent the first and last ``n`` rows of a key and slice
    only, so a hot key is neither one task's rows nor one task's state.
    """
    def step(rows):
        place, sizes, starts = run_numbers(rows)
        values = rows["v"].to_numpy(dtype=float)
        head, tail = place < n, place >= sizes - n
        mean, sd, count = np.full(len(rows), np.nan), np.full(len(rows), np.nan), np.zeros(len(rows), dtype=np.int32)
        for low in starts[sizes[starts] > n].tolist():
            high = low + int(sizes[low])
            m, s, c = previous_stats(values[low:high], n)
            mean[low + n:high], sd[low + n:high], count[low + n:high] = m, s, c
        return rows.assign(flags=(head + 2 * tail).astype(np.int32), mean=mean, sd=sd, n=count)

    rows = sliced(df, key, ts_col, tie, delay, width, buckets, {"v": F.col(value).cast("double")}, step, STATS)
    lane = F.when(F.col("flags") > 0, F.lit(-1)).otherwise(F.pmod("slice", F.lit(lanes))).cast("int")
    rows = rows.withColumn("lane", lane).drop("slice")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "lane")
    done = rows.groupBy("bucket", "lane").transformWithStateInPandas(Memory(n), schema, "Append", "None")
    mean, sd = (F.when(F.col("n") > least, F.col(c)) for c, least in (("mean", 0), ("sd", 1)))
    far = (F.col("n") > 1) & (F.abs(F.col("v") - F.col("mean")) > F.lit(float(k)) * F.col("sd"))
    return unpacked(done, df.schema, [mean.alias("mean_before"), sd.alias("sd_before"), F.coalesce(far, F.lit(False)).alias("is_anomaly")])


PAIRS = "flags int, next_us long, next_tie {tie}"


class OpenFirsts(StatefulProcessor):
    """Keeps the first steps that have found no second one in their slice, until one comes or their time is over."""

    def __init__(self, schema: str, reach: int):
        self.schema, self.reach = schema, reach
        self.names = [field.strip().split()[0] for field in schema.split(",")]

    def init(self, handle):
        self.open = handle.getListState("open", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        firsts, seconds = [], []
        for frame in rows:
            plain = frame["flags"] == 0
            if plain.any():
                yield frame[plain].drop(columns=["lane"])
            firsts.append(frame.loc[frame["flags"] == 1, self.names])
            seconds.append(frame.loc[frame["flags"] == 2, ["k", "us", "tie"]])
        second = pd.concat(seconds, ignore_index=True).sort_values(["k", "us", "tie"], kind="stable")
        first = pd.concat([f for f in (pd.DataFrame(list(self.open.get()), columns=self.names), *firsts) if len(f)] or firsts[:1], ignore_index=True)
        if not len(first):
            return
        newest = max([int(f["us"].max()) for f in (first, second) if len(f)])
        first = first.sort_values(["us"], kind="stable").astype({"us": "int64"})
        if len(second):
            found = pd.merge_asof(first.assign(at=first["us"]), second.sort_values("us", kind="stable").astype({"us": "int64"}).rename(
                columns={"us": "next", "tie": "other"}), left_on="at", right_on="next", by="k", direction="forward", allow_exact_matches=False)
        else:
            found = first.assign(next=np.nan, other=None)
        matched = found["next"].notna()
        near = matched & (found["next"] - found["us"] <= self.reach)
        if near.any():
            pairs = found[near]
            yield pairs[self.names].assign(bucket=np.int32(key[0]), flags=np.int32(0), next_us=pairs["next"].astype("int64"), next_tie=pairs["other"])
        rest = found.loc[~matched & (found["us"] + self.reach >= newest), self.names]
        if len(rest):
            self.open.put(tuples(rest))
        else:
            self.open.clear()

    def close(self):
        pass


def match_stream(df: DataFrame, key: str, ts_col: str, type_col: str, a: str, b: str, within: str, tie: str, delay: str,
                 width: str = "1 day", buckets: int = BUCKETS, lanes: int = LANES) -> DataFrame:
    """Match a two-step sequence in a stream as the batch operator does, once the watermark has passed the second step.

    Pairs inside a slice are found there. First steps without a second one go on to the second step, spread
    over lanes; the first of the second steps of each key and slice goes to every lane.
    """
    reach = micros(within)
    kind = next(f.dataType.simpleString() for f in df.schema if f.name == tie)

    def step(rows):
        # at equal times the second step comes first, so an a meets later ones only
        rows = rows.sort_values(["k", "us", "b", "tie"], ascending=[True, True, False, True], kind="stable").reset_index(drop=True)
        second = rows["b"].to_numpy(dtype=bool)
        place, sizes, starts = run_numbers(rows)
        at = np.arange(len(rows))
        following = np.minimum.accumulate(np.where(second, at, len(rows))[::-1])[::-1]
        end = np.repeat(starts, sizes[starts]) + sizes
        inside = ~second & (following < end)
        next_ = np.where(inside, following, 0)
        us, ties = rows["us"].to_numpy(dtype=np.int64), rows["tie"].to_numpy()
        earlier = np.maximum.accumulate(np.where(second, at, -1))
        first_b = second & (np.concatenate([[-1], earlier[:-1]]) < end - sizes)
        near = inside & (us[next_] - us <= reach)
        flags = np.where(first_b, 2, np.where(~second & ~inside, 1, 0)).astype(np.int32)
        out = rows.assign(flags=flags, next_us=np.where(near, us[next_], 0), next_tie=ties[next_])
        return out[(flags > 0) | near]

    both = df.filter(F.col(type_col).isin(a, b) & F.col(key).isNotNull())
    rows = sliced(both, key, ts_col, tie, delay, width, buckets, {"b": (F.col(type_col) == b)}, step, PAIRS.format(tie=kind))
    own = F.when(F.col("flags") == 1, F.pmod(F.xxhash64("us", "tie"), F.lit(lanes))).otherwise(F.pmod("slice", F.lit(lanes)))
    all_lanes = F.sequence(F.lit(0), F.lit(lanes - 1))
    rows = rows.withColumn("lane", F.explode(F.when(F.col("flags") == 2, all_lanes).otherwise(F.array(own.cast("int"))))).drop("slice", "b")
    held = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("k", "us", "tie", "payload"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "lane")
    done = rows.groupBy("bucket", "lane").transformWithStateInPandas(OpenFirsts(held, reach), schema, "Append", "None")
    next_ts = F.timestamp_micros("next_us").cast(next(f.dataType for f in df.schema if f.name == ts_col))
    return unpacked(done, df.schema, [next_ts.alias("next_ts"), F.col("next_tie").alias("next_id")])
