from __future__ import annotations

import datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.times import parse_event_time
from tidelake.operators import features
from tidelake.plans import streams
from tidelake.session import run_dir
from tidelake.sources import places, topics
from tidelake.streaming import jobs, stateful, windows

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def backend(spark):
    return topics.FolderTopics(run_dir(spark, "topics"))


def raw(spark, values):
    rows = [(k.encode() if k else None, v.encode() if v is not None else None) for k, v in values]
    return spark.createDataFrame(rows, "key binary, value binary").withColumn(
        "timestamp", F.lit("2024-01-01").cast("timestamp"))


def test_a_missing_topic_is_an_error(spark):
    for streaming in (True, False):
        with pytest.raises(topics.TopicNotFound):
            topics.read_topic(spark, "nowhere", backend(spark), streaming=streaming)


def test_kafka_topics_need_their_connector(spark):
    with pytest.raises(PySparkException, match="kafka"):
        topics.read_topic(spark, "t", topics.KafkaTopics("host:9092"), streaming=False)


@pytest.mark.parametrize("value", ["{broken", None, "[1, 2]"])
def test_one_bad_message_fails_the_reader(spark, value):
    frame = raw(spark, [("k", '{"id": 1, "v": "a"}'), ("k", value)])
    place = backend(spark)
    topics.write_topic(frame, "t", place)
    with pytest.raises((PySparkException, Py4JJavaError)):
        topics.decode(topics.read_topic(spark, "t", place, streaming=False), SCHEMA).collect()


def test_quarantine_splits_and_null_keys_stay(spark):
    frame = raw(spark, [("a", '{"id": 1, "v": "x"}'), (None, '{"id": 2}'), ("b", "no json"), ("c", None)])
    place = backend(spark)
    topics.write_topic(frame, "t", place)
    good, bad = topics.decode(topics.read_topic(spark, "t", place, streaming=False), SCHEMA, "quarantine")
    assert sorted((r["key"] or "", r["id"], r["v"]) for r in good.collect()) == [("", 2, None), ("a", 1, "x")]
    assert sorted((r["key"], bytes(r["value"]) if r["value"] else None) for r in bad.collect()) == [
        ("b", b"no json"), ("c", None)]


def test_writers_append_and_only_a_replay_replaces_itself(spark):
    place, frame = backend(spark), raw(spark, [(f"k{i}", f'{{"id": {i}}}') for i in range(20)])
    for _ in range(2):
        topics.write_topic(frame, "t", place)
    topics.write_topic(frame.limit(5), "in", place)
    jobs.topic_job(spark, "in", "t", place, run_dir(spark, "state")).awaitTermination()
    assert topics.read_topic(spark, "t", place, streaming=False).count() == 45
    for _ in range(2):
        topics.append(frame, "t", place, "stream-7")
    assert topics.read_topic(spark, "t", place, streaming=False).count() == 65


def test_a_batch_that_runs_again_adds_nothing_downstream(spark):
    place, first, second, out = backend(spark), run_dir(spark, "first"), run_dir(spark, "second"), run_dir(spark, "out")
    read = T.StructType([T.StructField("id", T.LongType())])

    def run():
        jobs.topic_job(spark, "in", "middle", place, first).awaitTermination()
        live = topics.decode(topics.read_topic(spark, "middle", place), read)
        jobs.stream_to_table(live.select("id"), out, second).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    for step in range(3):
        topics.write_topic(raw(spark, [(f"k{i}", f'{{"id": {i}}}') for i in range(5 * step, 5 * step + 5)]), "in", place)
        want = list(range(5 * step + 5))
        assert run() == want
        # as after a failure between the write and the commit: the batch is run again
        places.delete(spark, f"{first}/commits/{step}")
        assert run() == want
    assert topics.read_topic(spark, "middle", place, streaming=False).count() == 15


def test_a_write_that_did_not_end_is_not_seen(spark):
    place = backend(spark)
    frame = raw(spark, [("k", '{"id": 1}')])
    topics.write_topic(frame, "t", place)
    frame.write.parquet(f"{place.staging()}/write=x-1")  # a driver that was lost before it named its write
    assert topics.read_topic(spark, "t", place, streaming=False).count() == 1
    path = topics.append(frame, "t", place, "x-1")
    assert path == topics.append(frame, "t", place, "x-1") and path.endswith("seq=1/write=x-1")
    assert topics.read_topic(spark, "t", place, streaming=False).count() == 2


def test_a_taken_place_in_the_sequence_is_left_alone(spark):
    place = backend(spark)
    one = topics.append(raw(spark, [("k", '{"id": 1}')]), "t", place)
    other = place.staging()
    raw(spark, [("k", '{"id": 2}')]).write.parquet(f"{other}/write=b")
    assert not places.move_new(spark, other, one.rpartition("/write=")[0])
    assert places.exists(spark, f"{other}/write=b") and len(places.found(spark, f"{place.path('t')}/seq=*")) == 1


def test_partitions_and_offsets(spark):
    place = topics.FolderTopics(run_dir(spark, "topics"), partitions=3, lanes=2)
    rows = [(f"k{i % 7}", f'{{"id": {i}}}') for i in range(60)] + [("hot", f'{{"id": {i}}}') for i in range(60, 160)] + [(None, None)]
    for _ in range(2):
        topics.write_topic(raw(spark, rows), "t", place)
    got = topics.read_topic(spark, "t", place, streaming=False).collect()
    assert len({(r["partition"], r["offset"]) for r in got}) == len(got) == 322
    assert all(0 <= r["partition"] < 3 for r in got)
    of = {}
    for r in got:
        of.setdefault(r["key"], set()).add(r["partition"])
    assert all(len(p) == 1 for p in of.values())
    live = topics.read_topic(spark, "t", place)
    jobs.stream_to_table(live, run_dir(spark, "o") + "/x", run_dir(spark, "os")).awaitTermination()
    # from given offsets on: the second write only
    later = topics.read_topic(spark, "t", place, starting={p: 1 << topics.PLACE_BITS for p in range(3)}, streaming=False)
    assert later.count() == 161
    one = topics.read_topic(spark, "t", place, starting={0: 1 << 62}, streaming=False)
    assert {r["partition"] for r in one.select("partition").distinct().collect()} == {r["partition"] for r in got} - {0}


def test_every_message_is_reported(spark):
    place, reports = backend(spark), []
    topics.write_topic(raw(spark, [("a", '{"id": 1}'), ("b", '{"id": 2, "v": "' + "x" * 100 + '"}'), (None, None)]), "in", place)
    messages = topics.read_topic(spark, "in", place).select("key", "value", "timestamp")
    topics.write_topic(messages, "out", place, run_dir(spark, "state"),
                       lambda report, number: reports.extend(report.collect()), max_bytes=50).awaitTermination()
    told = {r["key"] and bytes(r["key"]).decode(): r for r in reports}
    assert len(reports) == 3 and "50 bytes" in told["b"]["error"] and told["b"]["offset"] is None
    sent = topics.read_topic(spark, "out", place, streaming=False).collect()
    assert {(r["partition"], r["offset"]) for r in sent} == {(r["partition"], r["offset"]) for r in reports if not r["error"]}
    assert len(sent) == 2 and topics.delivery_report(spark.createDataFrame(reports)).first()["messages"] == 2


def test_topic_job_changes_messages_and_reports_delivery(spark):
    place, reports = backend(spark), []
    topics.write_topic(raw(spark, [("k", '{"id": 1}'), ("k", '{"id": 2}')]), "in", place)

    def upper(df):
        return df.withColumn("value", F.upper(F.col("value").cast("string")).cast("binary"))

    def keep(written, number):
        reports.extend(topics.delivery_report(written).collect())

    jobs.topic_job(spark, "in", "out", place, run_dir(spark, "state"), upper, on_batch=keep).awaitTermination()
    out = topics.read_topic(spark, "out", place, streaming=False)
    assert sorted(bytes(r["value"]) for r in out.collect()) == [b'{"ID": 1}', b'{"ID": 2}']
    assert [(r["topic"], r["messages"]) for r in reports] == [("out", 2)]


def test_generators(spark):
    made = topics.sensor_messages(spark.range(25), "2025-01-01 00:00:00").orderBy("id").collect()
    assert len(made) == 25 and made[13]["key"] == "key-13" and made[13]["message"] == "Messaggio numero 13"
    assert (made[13]["data"]["temperature"], made[23]["data"]["humidity"]) == (23, 53)
    assert made[1]["timestamp"] == "2025-01-01T00:00:01.000000"
    row = topics.value_events(spark.range(5), 100.5, "here").orderBy("id").collect()[3]
    assert tuple(row) == (3, 103.5, 6, "here")


def test_both_time_encodings(spark):
    frame = spark.createDataFrame([("2024-01-01T00:00:01.5",), ("1704067201.5",), ("soon",)], "t string")
    got = [r[0] for r in frame.select(parse_event_time("t").cast("timestamp_ntz")).collect()]
    assert got == [datetime.datetime(2024, 1, 1, 0, 0, 1, 500000)] * 2 + [None]


def test_session_gap_boundary(spark):
    base = datetime.datetime(2024, 1, 1)
    offsets = [0, 60_000_000, 120_000_001]  # exactly one gap, then a microsecond more
    rows = [(base + datetime.timedelta(microseconds=o), 1) for o in offsets]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, k int")
    out = windows.window_agg(frame, "ts", ["k"], [F.count("*").alias("n")], gap="1 minute")
    assert sorted(r["n"] for r in out.collect()) == [1, 2]


@pytest.mark.parametrize("shape", [{"size": "1 day"}, {"size": "2 days", "slide": "1 day"}, {"gap": "2 hours"}])
def test_stream_equals_batch(spark, small, shape):
    events = spark.read.parquet(f"{small}/events.parquet")
    measures = [F.count("*").alias("n"), F.min("value").alias("lo")]
    batch = windows.window_agg(events, "ts", ["event_type"], measures, **shape)
    newest = events.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=1)
    closed = batch.filter(F.col("window_end") <= F.lit(newest).cast("timestamp_ntz"))
    stream = streams.landed(windows.window_agg(streams.event_stream(spark, small), "ts", ["event_type"], measures,
                                               delay="1 hour", **shape), "same")
    assert closed.exceptAll(stream).isEmpty() and stream.exceptAll(closed).isEmpty() and not stream.isEmpty()


def test_batch_sessions_of_a_hot_key(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").drop("props")
    # equal times, and one user with most rows
    rows = events.unionByName(events.filter("event_type = 'click'")).withColumn("user_id", F.col("user_id") % 2)
    measures = [F.count("*").alias("n"), F.min("value").alias("lo")]
    native = rows.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(
        F.session_window("ts", "20 minutes").alias("w"), "user_id").agg(*measures).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), "user_id", "n", "lo")
    for limit in (None, 100):
        ours = windows.window_agg(rows, "ts", ["user_id"], measures, gap="20 minutes", min_rows=limit)
        assert native.exceptAll(ours).isEmpty() and ours.exceptAll(native).isEmpty() and native.count() > 100


BASE = datetime.datetime(2024, 1, 1)


def event_rows(spark, *items):
    return spark.createDataFrame([(i, k, BASE + datetime.timedelta(hours=h), kind, v) for i, k, h, kind, v in items],
                                 "event_id long, user_id long, ts timestamp_ntz, event_type string, value double")


def run_steps(spark, steps, make):
    place, path, mark = backend(spark), run_dir(spark, "out"), run_dir(spark, "mark")
    for step in steps:
        topics.write_topic(streams.messages(step), "events", place)
        live = streams.decoded(topics.read_topic(spark, "events", place))
        jobs.stream_to_table(make(live), path, mark).awaitTermination()
    return spark.read.parquet(path).collect()


def test_patterns_wait_for_rows_out_of_order(spark):
    def make(live):
        return stateful.match_stream(live, "user_id", "ts", "event_type", "view", "purchase", "6 hours", "event_id", "3 hours")

    steps = [event_rows(spark, (1, 1, 0, "view", 1.0), (4, 1, 6.5, "purchase", 1.0), (7, None, 1, "view", 1.0)),
             # comes later but lies between the two; then a row far behind the watermark
             event_rows(spark, (2, 1, 4, "view", 1.0), (5, 1, 7, "view", 1.0), (8, None, 2, "purchase", 1.0)),
             event_rows(spark, (6, 1, 20, "click", 1.0), (9, 1, 20, "view", 1.0)),
             event_rows(spark, (10, 1, 7.5, "purchase", 1.0), (11, 1, 40, "view", 1.0))]
    # the view at 0 h is too far from the purchase at 6.5 h; the purchase at 7.5 h is too late
    assert {(r["event_id"], r["next_id"]) for r in run_steps(spark, steps, make)} == {(2, 4)}


def test_anomalies_wait_for_rows_out_of_order(spark):
    def make(live):
        return stateful.anomaly_stream(live.select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value", 3, 2.0,
                                   "event_id", "3 hours")

    values = [1.0, 2.0, None, 1.5, 50.0, 1.0, 2.0]
    rows = [(i, 1, float(i), "x", v) for i, v in enumerate(values)]
    steps = [event_rows(spark, *rows[1:3]), event_rows(spark, rows[0], rows[4], rows[3]), event_rows(spark, *rows[5:]),
             event_rows(spark, (99, 2, 30.0, "x", 1.0))]
    got = {r["event_id"]: (r["mean_before"], r["is_anomaly"]) for r in run_steps(spark, steps, make)}
    assert got == {0: (None, False), 1: (1.0, False), 2: (1.5, False), 3: (1.5, False), 4: (1.75, True), 5: (25.75, False),
                   6: (17.5, False)}


def test_a_hot_key_is_cut_by_time_and_given_once(spark):
    """One key has most rows and equal times; slices of an hour; compared with the batch operators."""
    rows = [(i, 7 if i % 4 else i % 3, (i * 37 % 500) / 20, "view" if i % 3 else "purchase", float(i * 7919 % 101)) for i in range(600)]
    events = event_rows(spark, *rows, (900, None, 3.0, "view", 1.0), (901, None, 3.0, "purchase", None), (999, 1, 100.0, "view", 1.0))
    live = streams.replayed(spark, [events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")])
    flagged = streams.landed(stateful.anomaly_stream(
        live.select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value", 5, 1.5, "event_id", "30 hours", width="1 hour",
        buckets=3), "hot")
    want = features.flag_anomalies(events.filter("event_id < 999").select("event_id", "user_id", "ts", "value"), "user_id", "ts",
                                   "value", 5, 1.5, "event_id")
    both = [{r["event_id"]: (None if r["mean_before"] is None else round(r["mean_before"], 6), r["is_anomaly"]) for r in f.collect()}
            for f in (flagged, want)]
    assert both[0] == both[1] and len(both[0]) == 602 and sum(r[1] for r in both[0].values()) > 10
    live = streams.replayed(spark, [events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")])
    pairs = streams.landed(stateful.match_stream(live, "user_id", "ts", "event_type", "view", "purchase", "6 hours", "event_id", "30 hours",
                                                 width="1 hour", buckets=3, lanes=2), "pairs")
    batch = features.match_sequence(events, "user_id", "ts", "event_type", "view", "purchase", "6 HOURS", "event_id")
    have, want = ([(r["event_id"], r["next_id"]) for r in f.collect()] for f in (pairs, batch))
    assert sorted(have) == sorted(want) and len(have) > 200


def test_the_highest_sequence_wins_across_batches(spark):
    target = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "k int, v double")
    schema = "k int, v double, seq long, op string"
    place, log, mark = backend(spark), run_dir(spark, "log"), run_dir(spark, "mark")
    wanted = [{1: 50.0, 3: 0.0}, {1: 50.0, 3: 0.0}, {1: 50.0, 2: 9.0, 3: 0.0, 4: 1.0}]
    for step, want in zip([[(1, 50.0, 5, "upsert"), (2, None, 6, "delete")], [(1, 30.0, 3, "upsert"), (2, 7.0, 4, "upsert")],
                           [(2, 9.0, 8, "upsert"), (4, 1.0, 1, "upsert")]], wanted):
        frame = spark.createDataFrame(step, schema)
        topics.write_topic(topics.encode(frame, "k"), "changes", place)
        live = topics.decode(topics.read_topic(spark, "changes", place), frame.schema).select(*frame.columns)
        jobs.apply_changes_stream(live, log, mark, "k", "seq").awaitTermination()
        table = jobs.with_changes(target, log, "k", "seq", "op")
        assert {r["k"]: r["v"] for r in table.collect()} == want


def test_late_rows_are_reported(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    seen, rest = streams.days(events, 3), streams.days(events, 1, 2)
    newest = seen.agg(F.max("ts")).first()[0]
    assert windows.late_rows(rest, "ts", newest, "1 HOUR").count() == rest.count() > 0


def test_panes_add_up_to_windows_and_copy_no_row(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    parts = {"n": (F.count("*"), F.sum), "lo": (F.min("value"), F.min), "hi": (F.max("value"), F.max)}
    panes = windows.pane_agg(events, "ts", ["event_type"], parts, "6 hours", "2 hours")
    plain = windows.window_agg(events, "ts", ["event_type"], [F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")],
                               "6 hours", "2 hours")
    assert plain.exceptAll(panes).isEmpty() and panes.exceptAll(plain).isEmpty() and not panes.isEmpty()
    # rows become several only above the first aggregation
    plan = panes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("Aggregate", plan.index("Aggregate") + 1) if "Expand" in plan else "Generate" not in plan
    live = streams.landed(windows.pane_agg(streams.event_stream(spark, small), "ts", ["event_type"], parts, "6 hours", "2 hours", "1 hour"), "panes")
    newest = events.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=1)
    closed = plain.filter(F.col("window_end") <= F.lit(newest).cast("timestamp_ntz"))
    assert closed.exceptAll(live).isEmpty() and live.exceptAll(closed).isEmpty()
    with pytest.raises(ValueError):
        windows.pane_agg(events, "ts", [], parts, "5 hours", "2 hours")


def test_late_rows_are_kept_once(spark):
    place, path, mark = backend(spark), run_dir(spark, "late"), run_dir(spark, "late-state")
    for n, step in enumerate([event_rows(spark, (1, 1, 10, "a", 1.0), (2, 1, 0, "a", 1.0)), event_rows(spark, (3, 1, 8.5, "a", 1.0), (4, 1, 9.5, "a", 1.0)),
                              event_rows(spark, (5, 1, 30, "a", 1.0)), event_rows(spark, (6, 1, 10, "a", 1.0))]):
        topics.write_topic(streams.messages(step), "events", place)
        for _ in range(2):
            live = streams.decoded(topics.read_topic(spark, "events", place))
            windows.keep_late(live, "ts", "1 hour", path, mark).awaitTermination()
            if _ == 0:
                places.delete(spark, f"{mark}/commits/{n}")
    # nothing is late before there is a mark: 9 h after the first step, 29 h after the third
    assert sorted(r["event_id"] for r in spark.read.parquet(path).collect()) == [3, 6]


def test_dedup_in_batch_and_stream(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").drop("props")
    # one message arrives very often
    many = events.limit(1).withColumn("_x", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("_x")
    both = events.unionByName(many)
    assert windows.dedup(both, "event_id", "ts", "1 day").count() == events.count()
    place = backend(spark)
    topics.write_topic(streams.messages(both), "events", place)
    live = streams.decoded(topics.read_topic(spark, "events", place))
    assert streams.landed(windows.dedup(live, "event_id", "ts", "1 day"), "dedup").count() == events.count()


def test_dedup_looks_at_the_time_between_copies(spark):
    rows = [("a", 0), ("a", 5), ("a", 30), ("b", 0), ("b", 23), ("b", 47), ("c", None), ("c", None), (None, 1), (None, 2)]
    frame = spark.createDataFrame([(k, None if h is None else BASE + datetime.timedelta(hours=h), i) for i, (k, h) in enumerate(rows)],
                                  "k string, ts timestamp_ntz, i int")
    for limit in (None, 1):
        kept = windows.dedup(frame, "k", "ts", "1 day", min_rows=limit).groupBy("k").count().collect()
        # 30 h is 25 h after the copy before it; 23 h and 47 h are within a day of theirs
        assert {r["k"]: r["count"] for r in kept} == {"a": 2, "b": 1, "c": 1, None: 1}


def test_sessions_leave_out_rows_without_time(spark):
    frame = spark.createDataFrame([(BASE, 1), (None, 1), (None, 1)], "ts timestamp_ntz, k int")
    out = windows.window_agg(frame, "ts", ["k"], [F.count("*").alias("n")], gap="1 minute").collect()
    assert [r["n"] for r in out] == [1]


def test_the_newest_of_equal_times_is_the_largest(spark):
    frame = spark.createDataFrame([("a", 3.0, BASE), ("a", 9.0, BASE), ("a", 5.0, BASE)], "k string, v double, ts timestamp_ntz")
    assert windows.running_count(frame, "k", "v", "ts").first()["last_value"] == 9.0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_enrich_gives_one_answer_however_large_the_dimension(spark, small, how):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "user_id")
    customers = spark.read.parquet(f"{small}/customer.parquet").select("c_custkey", "c_mktsegment").filter("c_custkey % 2 = 0")
    same = customers.withColumnRenamed("c_custkey", "user_id")
    for side, key in ((customers, "c_custkey"), (same, "user_id")):
        plain = windows.enrich(events, side, "user_id", key, how)
        for hot in ((), (2, 4, 6)):
            wide = windows.enrich(events, side, "user_id", key, how, small_bytes=0, hot=hot, salts=4)
            assert wide.columns == plain.columns
            assert wide.exceptAll(plain).isEmpty() and plain.exceptAll(wide).isEmpty() and not plain.isEmpty()


def test_hot_keys_are_learnt_from_batches(spark, small):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 2000).alias("k"), "id")
    hot = windows.HotKeys(run_dir(spark, "hot"), "k", share=0.1)
    for n in (0, 1, 1):
        hot.learn(rows.filter(F.col("id") % 2 == n), n)
    hot.learn(rows.limit(0), 2)
    assert hot.values(spark) == [5]
    side = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    spread_ = windows.enrich(rows, side, "k", "key", small_bytes=0, hot=hot)
    plain = windows.enrich(rows, side, "k", "key")
    assert spread_.exceptAll(plain).isEmpty() and spread_.count() == plain.count() == 9000
    assert "_salt" in spread_._jdf.queryExecution().optimizedPlan().toString()


def test_enrich_in_a_stream_and_what_it_refuses(spark, small):
    customers = spark.read.parquet(f"{small}/customer.parquet").select("c_custkey", "c_mktsegment")
    stream = streams.event_stream(spark, small)
    wide = streams.landed(windows.enrich(stream, customers, "user_id", "c_custkey", small_bytes=0, hot=[7]), "salted")
    narrow = streams.landed(windows.enrich(stream, customers, "user_id", "c_custkey"), "plain")
    assert wide.exceptAll(narrow).isEmpty() and wide.count() == narrow.count() == 1000
    with pytest.raises(ValueError, match="right"):
        windows.enrich(stream, customers, "user_id", "c_custkey", "right")
    with pytest.raises(ValueError, match="value"):
        windows.enrich(stream, customers.withColumn("value", F.lit(1)), "user_id", "c_custkey")


@pytest.mark.parametrize("mode", ["file", "batch"])
def test_restart_adds_no_duplicates_and_goes_on(spark, small, mode):
    events = spark.read.parquet(f"{small}/events.parquet")
    place, path, state = backend(spark), run_dir(spark, "out"), run_dir(spark, "state")

    def run():
        live = streams.decoded(topics.read_topic(spark, "events", place))
        jobs.start_exactly_once(live, path, state, mode).awaitTermination()
        return spark.read.parquet(path).count()

    first = streams.days(events, 1, 10)
    topics.write_topic(streams.messages(first), "events", place)
    assert run() == run() == first.count()
    topics.write_topic(streams.messages(streams.days(events, 11)), "events", place)
    assert run() == events.count()


def test_progress_is_reported_every_few_polls(spark, small):
    said, place = [], backend(spark)
    events = spark.read.parquet(f"{small}/events.parquet")
    for a, b in [(1, 10), (11, 20), (21, None)]:
        topics.write_topic(streams.messages(streams.days(events, a, b).coalesce(1)), "events", place)
    progress = jobs.ConsumerProgress(every=2, report=said.append)
    spark.streams.addListener(progress)
    try:
        live = topics.read_topic(spark, "events", place, max_files=1).select("key")
        jobs.stream_to_table(live, run_dir(spark, "p"), run_dir(spark, "ps")).awaitTermination()
        assert progress.wait()
    finally:
        spark.streams.removeListener(progress)
    assert progress.messages == 1000 and said[0].startswith("poll 2") and said[-1] == "total messages 1000"


def test_console_sink(spark, small):
    printed = jobs.to_console(streams.event_stream(spark, small).select("event_id"), run_dir(spark, "console"))
    printed.awaitTermination()
    assert "Console" in printed.lastProgress.sink.description
    assert sum(p.numInputRows for p in printed.recentProgress) == 1000


def test_sql_with_bound_values_over_a_batch_frame(spark):
    frame = spark.createDataFrame([(1,), (20,)], "value int")
    assert windows.stream_sql(frame, "v_rows", "SELECT * FROM v_rows WHERE value > :least", least=10).count() == 1


def test_map_elements_runs_any_function(spark):
    words = spark.createDataFrame([(w,) for w in ("Hello", "World", "Straße")], "w string")
    out = jobs.map_elements(words, str.upper, "w string").collect()
    assert {r["w"] for r in out} == {"HELLO", "WORLD", "STRASSE"}
