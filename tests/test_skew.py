"""Slicing hot keys must not change any result."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelake.operators import features, retrieval, skew


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


@pytest.fixture(scope="module")
def events(spark, small):
    # one user holds a third of all rows
    rows = spark.read.parquet(f"{small}/events.parquet").drop("props")
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id"))
    return rows.withColumn("user_id", hot.cast("long")).cache()


def test_hot_groups_are_found(events):
    found = skew.hot_groups(events, ["user_id"], 200)
    assert [r["user_id"] for r in found.collect()] == [7]


def test_thousands_of_heavy_keys_are_all_cut(spark):
    rows = spark.range(60_000).select((F.col("id") % 5000).alias("k"), F.col("id").alias("t"))
    cut = skew.slice_groups(rows, ["k"], "t", min_rows=10)
    assert cut.hot and cut.df.filter("NOT _hot").isEmpty()
    # slices are ranges of about as many rows, whoever they belong to
    assert cut.df.groupBy("_slice").count().agg(F.max("count")).first()[0] < 60
    out = skew.scan(rows, ["k"], ["t"], sums={"n": F.lit(1)}, min_rows=10)
    assert out.filter(F.col("n") != F.floor(F.col("t") / 5000) + 1).isEmpty()


@pytest.mark.parametrize("descending", [(), ("v",)])
def test_ranking_with_nan(spark, descending):
    rows = spark.range(2000).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 400 == 0, F.lit(float("nan"))).when(
        F.col("id") % 401 == 0, None).otherwise((F.col("id") % 90).cast("double")).alias("v"))

    def run(min_rows):
        return skew.ranking(rows, ["k"], ["v", "id"], descending, ntile=5, min_rows=min_rows)

    assert same(run(None), run(100))


@pytest.mark.parametrize("limit", [None, 3])
def test_rows_of_one_time_see_each_other(spark, limit):
    rows = spark.createDataFrame([(1, 0, 1.0, 1), (1, 0, 2.0, 2), (1, 5, 4.0, 3), (2, 0, 8.0, 4), (1, 5, None, 5)],
                                 "k int, s int, v double, id int").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    frame = Window.partitionBy("k").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_000_000, 0)
    want = rows.select("id", F.count("*").over(frame).alias("count_h"), F.coalesce(F.sum("v").over(frame), F.lit(0.0)).alias("sum_h"))
    got = features.rolling_features(rows, "k", "ts", "v", {"h": 3}, "id", min_rows=limit)
    assert same(want, got)


def test_digits_are_not_dropped(spark):
    rows = spark.createDataFrame([(1, 1.23456789)], "k int, v double").withColumn("ts", F.current_timestamp())
    with pytest.raises(Exception, match="decimal places"):
        features.rolling_features(rows, "k", "ts", "v", {"h": 3}, "v").collect()
    fits = rows.withColumn("v", F.lit(0.1) + F.lit(0.2))
    assert features.rolling_features(fits, "k", "ts", "v", {"h": 3}, "v").first()["sum_h"] == 0.3


@pytest.mark.parametrize("limit", [None, 2])
def test_null_keys_and_times_match_nothing(spark, limit):
    times = {None: None, 0: "2024-01-01", 1: "2024-01-02"}
    def frame(rows):
        return spark.createDataFrame([(k, times[t], kind, i) for k, t, kind, i in rows], "k int, t string, kind string, i int").withColumn(
            "ts", F.col("t").cast("timestamp_ntz")).drop("t")
    labels = frame([(None, 1, "l", 1), (1, 1, "l", 2), (2, 1, "l", 3), (1, None, "l", 4)])
    found = frame([(None, 0, "f", 10), (1, 0, "f", 11), (2, None, "f", 12)])
    got = features.point_in_time_join(labels, found, "k", "ts", "ts", ["i"], "i", min_rows=limit).collect()
    assert {r["i"]: r["feature_i"] for r in got} == {1: None, 2: 11, 3: None, 4: None}
    steps = frame([(None, 0, "a", 1), (None, 1, "b", 2), (1, None, "a", 3), (1, 1, "b", 4), (1, 0, "a", 5), (2, 0, "a", 6), (2, None, "b", 7)])
    got = features.followed(steps, "k", "ts", "kind", "a", "b", "i", min_rows=limit).collect()
    assert {r["i"]: r["next_id"] for r in got} == {1: None, 3: None, 5: 4, 6: None}


@pytest.mark.parametrize("key", ["user_id", "event_type"])
@pytest.mark.parametrize("limit", [40, 250])
def test_scan(events, key, limit):
    def run(min_rows):
        return skew.scan(
            events, [key], ["ts", "event_id"], sums={"s": F.col("value").cast("decimal(28,6)")},
            last={"l": F.when(F.col("value") < 9, F.struct("value"))}, prev={"p": F.struct("value")},
            following={"f": F.when(F.col("event_type") == "view", F.col("event_id"))}, min_rows=min_rows)

    assert same(run(None), run(limit))


def test_scan_without_keys(events):
    def run(min_rows):
        return skew.scan(events, [], ["ts", "event_id"], sums={"n": F.lit(1)}, min_rows=min_rows)

    assert same(run(None), run(100))


@pytest.mark.parametrize("n", [1, 5, 60])
def test_over_previous(events, n):
    def run(min_rows):
        return skew.over_previous(events, ["user_id"], ["ts", "event_id"], n, {
            "ids": lambda w: F.collect_list("event_id").over(w)}, min_rows=min_rows)

    assert same(run(None), run(30))


@pytest.mark.parametrize("descending", [(), ("v",)])
def test_ranking(events, descending):
    # few distinct values, some NULL: ties must stay together
    rows = events.withColumn("v", F.when(F.col("value") < 200, F.floor("value")))

    def run(min_rows):
        return skew.ranking(rows, ["user_id"], ["v", "event_id"], descending, ntile=7, min_rows=min_rows)

    assert same(run(None), run(40))


def test_a_null_key_can_be_hot(events):
    rows = events.withColumn("user_id", F.when(F.col("user_id") != 7, F.col("user_id")))

    def run(min_rows):
        return skew.scan(rows, ["user_id"], ["ts", "event_id"], sums={"n": F.lit(1)}, min_rows=min_rows)

    assert same(run(None), run(50))


def test_the_plain_window_is_used_when_nothing_is_hot(events):
    plan = skew.scan(events, ["user_id"], ["ts", "event_id"], sums={"n": F.lit(1)})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "_slice" not in text and "Join" not in text


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20)), min_size=1, max_size=60))
def test_running_sum_of_any_rows(spark, rows):
    data = [(k, t, i) for i, (k, t) in enumerate(rows)]
    frame = spark.createDataFrame(data, "k int, t int, i int")
    out = skew.scan(frame, ["k"], ["t", "i"], sums={"s": F.col("i")}, min_rows=4).collect()
    for row in out:
        want = sum(i for k, t, i in data if k == row["k"] and (t, i) <= (row["t"], row["i"]))
        assert row["s"] == want


@pytest.mark.parametrize("limit", [40])
def test_operators_over_hot_keys(events, limit):
    labels = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts", "value")

    def pit(m):
        return features.point_in_time_join(labels, clicks, "user_id", "ts", "ts", ["value"], "event_id", min_rows=m)

    def rolled(m):
        return features.rolling_features(events, "user_id", "ts", "value", {"h": 3600, "d": 86400}, "event_id",
                                         min_rows=m)

    def matched(m):
        return features.match_sequence(events, "user_id", "ts", "event_type", "view", "purchase", "6 HOURS",
                                       "event_id", min_rows=m)

    def flagged(m):
        rows = features.flag_anomalies(events, "user_id", "ts", "value", 20, 2.0, "event_id", min_rows=m)
        return rows.select("event_id", F.round("mean_before", 6).alias("m"), "is_anomaly")

    for run in (pit, rolled, matched, flagged):
        assert same(run(None), run(limit)), run.__name__


def test_history_of_a_hot_conversation(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    one = rows.select(F.lit(1).alias("conv_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("turn"), "role", "text")

    def run(min_rows):
        return retrieval.history(one, "conv_id", "turn", "role", "text", 4, min_rows=min_rows)

    assert same(run(None), run(10))


KINDS = {"text": "concat('https://host.example/', lpad(CAST(id % 83 AS STRING), 5, '0'))", "binary": "CAST(concat('k', id % 83) AS BINARY)",
         "decimal": "CAST(id % 83 AS DECIMAL(20, 4)) / 7", "date": "date_add(DATE'2024-01-01', CAST(id % 83 AS INT))", "boolean": "id % 2 = 0"}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("descending", [(), ("v",)])
def test_ranking_by_a_column_of_any_type(spark, kind, descending):
    value = F.when(F.col("id") % 97 == 0, None).otherwise(F.expr(KINDS[kind]))
    rows = spark.range(1500).select((F.col("id") % 2).alias("k"), "id", value.alias("v"))

    def run(min_rows):
        return skew.ranking(rows, ["k"], ["v", "id"], descending, ntile=4, min_rows=min_rows)

    assert same(run(None), run(100))


@pytest.mark.parametrize("kind", ["text", "decimal"])
def test_walks_in_the_order_of_any_type(spark, kind):
    rows = spark.range(900).select((F.col("id") % 2).alias("k"), "id", F.expr(KINDS[kind]).alias("v"), (F.col("id") * 7 % 11).alias("x"))

    def scanned(limit):
        return skew.scan(rows, ["k"], ["v", "id"], sums={"s": F.col("x")}, last={"l": F.when(F.col("x") > 5, F.col("x"))},
                         prev={"p": F.col("x")}, following={"f": F.col("x")}, min_rows=limit)

    def before(limit):
        return skew.over_previous(rows, ["k"], ["v", "id"], 7, {"m": lambda w: F.sum("x").over(w)}, min_rows=limit)

    assert same(scanned(None), scanned(60)) and same(before(None), before(60))
