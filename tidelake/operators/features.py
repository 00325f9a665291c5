"""Feature tables: as-of joins, rolling aggregates, patterns, anomalies, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.exact import whole_units
from tidelake.functions.times import micros
from tidelake.operators import skew


def point_in_time_join(labels: DataFrame, features: DataFrame, key: str, label_ts: str, feature_ts: str,
                       feature_cols, tie: str, min_rows=None) -> DataFrame:
    """Every label with the latest feature row at or before its time, per key.

    Equal times go to the highest ``tie`` of the features. One union and one walk
    per key; labels without an earlier feature get NULLs, as do labels without key or
    time. Features without key or time match nothing.
    """
    features = features.filter(F.col(key).isNotNull() & F.col(feature_ts).isNotNull())
    packed = F.struct(*feature_cols)
    left = labels.select(
        F.col(key).alias("_key"), F.col(label_ts).alias("_ts"), F.lit(1).alias("_side"),
        F.lit(None).cast(features.schema[tie].dataType).alias("_tie"), F.struct(*labels.columns).alias("_label"),
        F.lit(None).cast(features.select(packed).schema[0].dataType).alias("_feature"))
    right = features.select(
        F.col(key).alias("_key"), F.col(feature_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"),
        F.lit(None).cast(labels.select(F.struct(*labels.columns)).schema[0].dataType).alias("_label"),
        packed.alias("_feature"))
    walked = skew.scan(left.unionByName(right), ["_key"], ["_ts", "_side", "_tie"],
                       last={"_seen": F.col("_feature")}, min_rows=min_rows)
    return walked.filter(F.col("_side") == 1).select(
        "_label.*", *[F.col(f"_seen.{c}").alias(c if c not in labels.columns else f"feature_{c}")
                      for c in feature_cols])


def rolling_features(df: DataFrame, key: str, ts_col: str, value: str, horizons: dict, tie: str,
                     scale: int = 6, min_rows=None) -> DataFrame:
    """Count and sum over the trailing horizon up to each row, and seconds since the last row.

    ``horizons`` maps a name to seconds; a row exactly one horizon old still
    counts, and so do rows of the same time, before or after in the order. Every row is added to a running total at its time and taken out again
    after the horizon, so the work is linear however many rows a horizon holds.
    Values are counted in units of ``10 ** -scale`` as whole numbers, so totals are
    exact; one with more places, or one that does not fit a long, raises. Rows without a time
    come first and see each other only.
    """
    unit = 10 ** scale
    if isinstance(df.schema[value].dataType, T.DecimalType):
        if df.schema[value].dataType.scale > scale:
            raise ValueError(f"{value} has more than {scale} decimal places")
        amount = (F.col(value).cast(f"decimal(38,{scale})") * unit).cast("long")
    else:
        amount = whole_units(value, scale)
    amount = F.coalesce(amount, F.lit(0).cast("long"))
    base = df.select("*", micros(ts_col).alias("_at"))
    enter = base.select(
        "*", F.lit(0).alias("_kind"), F.col(tie).alias("_tie"),
        *[c for name in horizons for c in (F.lit(1).cast("long").alias(f"_n_{name}"),
                                           amount.alias(f"_v_{name}"))])
    leaves = []
    for name, seconds in horizons.items():
        # leaves just after the horizon has passed, before the rows of that microsecond
        gone = base.select(
            F.col(key), (F.col("_at") + int(seconds * 1_000_000) + 1).alias("_at"), F.lit(-1).alias("_kind"),
            F.col(tie).alias("_tie"),
            *[c for other in horizons for c in (
                F.lit(-1 if other == name else 0).cast("long").alias(f"_n_{other}"),
                (-amount if other == name else F.lit(0).cast("long")).alias(f"_v_{other}"))])
        leaves.append(gone)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [enter, *leaves])
    sums = {f"{kind}_{name}": F.col(f"_{short}_{name}") for name in horizons
            for kind, short in (("count", "n"), ("sum", "v"))}
    walked = skew.scan(rows, [key], ["_at", "_kind", "_tie"], sums=sums,
                       prev={"_last": F.when(F.col("_kind") == 0, F.col("_at"))}, min_rows=min_rows)
    kept = walked.filter(F.col("_kind") == 0)
    # the totals of the last row of a time hold for all rows of that time
    peers = Window.partitionBy(key, "_at")
    kept = kept.withColumns({name: F.max_by(name, "_tie").over(peers) for name in sums})
    return kept.select(
        *df.columns,
        *[c for name in horizons for c in (F.col(f"count_{name}"), (F.col(f"sum_{name}") / unit).alias(
            f"sum_{name}"))],
        ((F.col("_at") - F.col("_last")) / F.lit(1e6)).alias("seconds_since_previous"))


def latest_per_key(df: DataFrame, key: str, ts_col: str, tie: str) -> DataFrame:
    """The newest row of every key, ties by the highest ``tie``."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(ts_col, tie)).alias("_r")).select("_r.*")


def followed(df: DataFrame, key: str, ts_col: str, type_col: str, a: str, b: str, tie: str,
             min_rows=None) -> DataFrame:
    """Each ``a`` with the first strictly later ``b`` of its key as ``next_ts`` and ``next_id``, or NULL.

    Rows without key or time are followed by nothing and follow nothing.
    """
    rows = df.filter((F.col(type_col) == a) | ((F.col(type_col) == b) & F.col(key).isNotNull() & F.col(ts_col).isNotNull()))
    # at equal times b comes first, so that the walk from an a meets only later ones
    rows = rows.withColumn("_side", (F.col(type_col) == a).cast("int"))
    found = skew.scan(
        rows, [key], [ts_col, "_side", tie],
        following={"_b": F.when(F.col(type_col) == b, F.struct(F.col(ts_col).alias("ts"), F.col(tie).alias("id")))},
        min_rows=min_rows)
    timed = F.col(ts_col).isNotNull()
    return found.filter(F.col(type_col) == a).select(
        *df.columns, F.when(timed, F.col("_b.ts")).alias("next_ts"), F.when(timed, F.col("_b.id")).alias("next_id"))


def match_sequence(df: DataFrame, key: str, ts_col: str, type_col: str, a: str, b: str, within: str, tie: str,
                   min_rows=None) -> DataFrame:
    """Each ``a`` with the first strictly later ``b`` of its key, when at most ``within`` apart.

    Gives the rows of type ``a`` with ``next_ts`` and ``next_id`` of that ``b``.
    """
    pairs = followed(df, key, ts_col, type_col, a, b, tie, min_rows)
    return pairs.filter(F.col("next_ts") <= F.col(ts_col) + F.expr(f"INTERVAL {within}"))


def flag_anomalies(df: DataFrame, key: str, ts_col: str, value: str, n: int, k: float, tie: str,
                   min_rows=None) -> DataFrame:
    """Rows with mean and deviation of the ``n`` rows before them and the flag ``is_anomaly``:
    more than ``k`` sample deviations away. With fewer than 2 earlier values it is false."""
    seen = skew.over_previous(
        df, [key], [ts_col, tie], n,
        {"mean_before": lambda w: F.avg(value).over(w), "sd_before": lambda w: F.stddev_samp(value).over(w),
         "_n": lambda w: F.count(value).over(w)}, min_rows=min_rows)
    far = F.abs(F.col(value) - F.col("mean_before")) > F.lit(float(k)) * F.col("sd_before")
    return seen.withColumn("is_anomaly", F.coalesce((F.col("_n") >= 2) & far, F.lit(False))).drop("_n")


def training_split(df: DataFrame, id_col: str, weights: dict, factor: int = 31) -> DataFrame:
    """Adds ``split`` by the id alone: the same id always lands in the same part.

    ``weights`` maps part names to percentages that add up to 100; ``factor`` must
    share no divisor with 100.
    """
    if sum(weights.values()) != 100:
        raise ValueError("weights must add up to 100")
    bucket = F.pmod(F.pmod(F.col(id_col), F.lit(100)) * F.lit(factor), F.lit(100))
    names = list(weights)
    part, edge = F.lit(names[-1]), 100
    for name in reversed(names[:-1]):
        edge -= weights[names[names.index(name) + 1]]
        part = F.when(bucket < edge, F.lit(name)).otherwise(part)
    return df.withColumn("split", part)
