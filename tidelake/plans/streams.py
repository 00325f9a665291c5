"""Topics and event-time queries over the ``events`` table replayed as messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.exact import exact_sum, whole_units
from tidelake.functions.times import parse_event_time
from tidelake.plans.lake import LOG
from tidelake.plans.registry import query, table
from tidelake.session import run_dir
from tidelake.sources import topics
from tidelake.streaming import jobs, stateful, windows

PAYLOAD = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.StringType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType())])
FIELDS = PAYLOAD.fieldNames()
NUMBERED = "(date_diff('day', (SELECT min(ts) FROM events), ts) + 1)"
SAME = "SELECT event_id, ts, user_id, event_type, value FROM events"

def messages(events: DataFrame) -> DataFrame:
    return topics.encode(events, "user_id", FIELDS, "ts")


def events_topic(spark, sf) -> topics.FolderTopics:
    """The events as topic ``events``."""
    backend = topics.FolderTopics(run_dir(spark, "topics"))
    topics.write_topic(messages(table(spark, sf, "events")), "events", backend)
    return backend


def decoded(df: DataFrame, zone_less: bool = False) -> DataFrame:
    """The payload columns with ``ts`` as a time."""
    ts = parse_event_time("ts")
    rows = topics.decode(df, PAYLOAD).withColumn("ts", ts.cast("timestamp_ntz") if zone_less else ts)
    return rows.select(*FIELDS)


def event_stream(spark, sf) -> DataFrame:
    return decoded(topics.read_topic(spark, "events", events_topic(spark, sf)))


def landed(df: DataFrame, name: str) -> DataFrame:
    """Run an append query to the end of its input and read what it wrote."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    jobs.stream_to_table(df, path, run_dir(spark, name + "-state")).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def last_result(df: DataFrame, name: str) -> DataFrame:
    """Run a complete-mode query to the end of its input and read its last result."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    jobs.write_results(df, path, run_dir(spark, name + "-state"), "complete").awaitTermination()
    written = spark.read.parquet(path)
    newest = written.agg(F.max("batch").alias("b")).scalar()
    return written.filter(F.col("batch") == newest).drop("batch")


def staged(spark, steps, run) -> None:
    """Feed a topic step by step; ``run(backend)`` starts the query on what has arrived.

    One checkpoint across the steps makes every step a batch of its own.
    """
    backend = topics.FolderTopics(run_dir(spark, "staged"))
    for step in steps:
        topics.write_topic(messages(step), "events", backend)
        run(backend).awaitTermination()


def replayed(spark, steps) -> DataFrame:
    """The steps as one stream; each is a micro-batch of its own."""
    backend = topics.FolderTopics(run_dir(spark, "replayed"), partitions=1, lanes=1)
    for step in steps:
        topics.write_topic(messages(step), "events", backend)
    return decoded(topics.read_topic(spark, "events", backend, max_files=1))


def days(events: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Events of the days ``first`` to ``last``, counted from 1 at the day of the first event."""
    start = events.agg(F.to_date(F.min("ts"))).first()[0]
    day = F.date_diff(F.to_date("ts"), F.lit(start)) + 1
    return events.filter((day >= first) & (day <= last) if last else day >= first)


def mixed_up(events: DataFrame, hours: int = 12) -> list:
    """Four steps in time, where every second event comes up to ``hours`` too early."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    edge = events.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    share = (at - hours * 3_600_000_000 * (F.col("event_id") % 2) - edge["low"]) / (edge["high"] - edge["low"] + 1)
    step = F.greatest(F.floor(4 * share), F.lit(0))
    return [events.filter(step == k) for k in range(4)]


# -- topics -----------------------------------------------------------------

@query("""SELECT event_id AS id, 'key-' || event_id AS key, 'Messaggio numero ' || event_id AS message,
                 CAST(20 + event_id % 10 AS INTEGER) AS temperature, CAST(50 + event_id % 20 AS INTEGER) AS humidity
          FROM events""")
def sensor_messages(spark, sf):
    made = topics.sensor_messages(table(spark, sf, "events"), "2024-01-01 00:00:00", id_col="event_id")
    return made.select("id", "key", "message", "data.temperature", "data.humidity")


@query("SELECT event_id AS id, event_id * 2 AS value, 'demo' AS source FROM events")
def value_events(spark, sf):
    return topics.value_events(table(spark, sf, "events"), 1704067200.0, "demo", id_col="event_id").drop("timestamp")


@query("""SELECT event_id, user_id, CAST(user_id AS VARCHAR) AS key, 'events' AS topic, ts AS sent_at FROM events""")
def topic_read(spark, sf):
    raw = topics.read_topic(spark, "events", events_topic(spark, sf), streaming=False)
    rows = topics.decode(raw, PAYLOAD)
    return rows.select("event_id", "user_id", "key", "topic", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"))


@query("""SELECT event_type, 2 * count(*) AS n, count(DISTINCT user_id) AS n_keys FROM events GROUP BY event_type""")
def topic_write(spark, sf):
    # two writers and then a stream append to one topic; nobody replaces anything
    backend, events = events_topic(spark, sf), table(spark, sf, "events")
    half = F.col("event_type") == "click"
    for part in (events.filter(half), events.filter(~half)):
        topics.write_topic(messages(part), "all", backend)
    jobs.topic_job(spark, "events", "all", backend, run_dir(spark, "job")).awaitTermination()
    rows = topics.decode(topics.read_topic(spark, "all", backend, streaming=False), PAYLOAD)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"))


@query(SAME)
def decode_messages(spark, sf):
    raw = topics.read_topic(spark, "events", events_topic(spark, sf), streaming=False)
    return decoded(raw, zone_less=True)


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 10")
def first_messages(spark, sf):
    raw = topics.read_topic(spark, "events", events_topic(spark, sf), streaming=False)
    return decoded(raw, zone_less=True).select("event_id", "ts").orderBy("ts", "event_id").limit(10)


PARTITION = "CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 4 AS INTEGER)"


@query(f"""SELECT {PARTITION} AS "partition", count(*) AS messages, count(*) AS offsets, count(DISTINCT user_id) AS n_keys,
                  count(*) FILTER (event_id % 2 = 0) AS from_first_half
           FROM events GROUP BY 1""")
def message_offsets(spark, sf):
    # two writes; offsets of a partition are all different, and those of the second write come later
    backend, events = topics.FolderTopics(run_dir(spark, "offsets")), table(spark, sf, "events")
    even = F.col("event_id") % 2 == 0
    for part in (events.filter(even), events.filter(~even)):
        topics.write_topic(messages(part), "events", backend)
    rows = topics.read_topic(spark, "events", backend, streaming=False)
    first = rows.select("partition", "key", (F.col("offset") < (1 << topics.PLACE_BITS)).cast("int").alias("early"), "offset")
    return first.groupBy("partition").agg(
        F.count("*").alias("messages"), F.count_distinct("offset").alias("offsets"), F.count_distinct("key").alias("n_keys"),
        F.sum("early").alias("from_first_half"))


@query(f"""SELECT user_id, {PARTITION} AS "partition", count(*) AS n FROM events GROUP BY 1, 2""")
def delivered_messages(spark, sf):
    # the report of every message, batch by batch
    backend, reports = events_topic(spark, sf), run_dir(spark, "reports")

    def keep(report, number):
        report.write.mode("overwrite").parquet(f"{reports}/batch={number}")

    jobs.topic_job(spark, "events", "sent", backend, run_dir(spark, "job"), on_batch=keep).awaitTermination()
    rows = spark.read.parquet(reports).filter("error IS NULL").dropDuplicates(["partition", "offset"])
    return rows.groupBy(F.col("key").cast("string").cast("long").alias("user_id"), "partition").agg(F.count("*").alias("n"))


@query(SAME)
def topic_chain(spark, sf):
    # two jobs in a row, started anew for every part of the month
    events, path = table(spark, sf, "events"), run_dir(spark, "chained")
    first, second, state = run_dir(spark, "first"), run_dir(spark, "second"), run_dir(spark, "chained-state")

    def run(backend):
        jobs.topic_job(spark, "events", "middle", backend, first).awaitTermination()
        jobs.topic_job(spark, "middle", "last", backend, second).awaitTermination()
        return jobs.stream_to_table(decoded(topics.read_topic(spark, "last", backend)), path, state)

    staged(spark, [days(events, 1, 15), days(events, 16)], run)
    return spark.read.parquet(path).select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if c == "ts" else c for c in FIELDS])


@query(SAME)
def topic_passthrough(spark, sf):
    backend = events_topic(spark, sf)
    jobs.topic_job(spark, "events", "passed", backend, run_dir(spark, "job")).awaitTermination()
    return decoded(topics.read_topic(spark, "passed", backend, streaming=False), zone_less=True)


@query("SELECT 'sent' AS topic, count(*) AS messages, min(ts) AS first_sent, max(ts) AS last_sent FROM events")
def delivery_report(spark, sf):
    backend, reports = events_topic(spark, sf), run_dir(spark, "reports")

    def report(delivered, number):
        topics.delivery_report(delivered).write.mode("overwrite").parquet(f"{reports}/batch={number}")

    jobs.topic_job(spark, "events", "sent", backend, run_dir(spark, "job"), on_batch=report).awaitTermination()
    return spark.read.parquet(reports).groupBy("topic").agg(
        F.sum("messages").alias("messages"), F.min("first_sent").cast("timestamp_ntz").alias("first_sent"),
        F.max("last_sent").cast("timestamp_ntz").alias("last_sent"))


@query("""SELECT event_type, CASE WHEN event_type = 'error' THEN 0 ELSE count(*) END AS n_good,
                 CASE WHEN event_type = 'error' THEN count(*) ELSE 0 END AS n_bad FROM events GROUP BY event_type""")
def bad_messages(spark, sf):
    # values of type error lose their second half on the way
    events = table(spark, sf, "events")
    text = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    sent = events.select(
        F.col("event_type").cast("binary").alias("key"),
        F.when(F.col("event_type") == "error", F.substring(text, F.lit(1), F.length(text) / 2)).otherwise(text)
        .cast("binary").alias("value"), F.col("ts").cast("timestamp").alias("timestamp"))
    backend = topics.FolderTopics(run_dir(spark, "bad"))
    topics.write_topic(sent, "mixed", backend)
    schema = T.StructType([f for f in PAYLOAD.fields if f.name != "ts"])
    good, bad = topics.decode(topics.read_topic(spark, "mixed", backend, streaming=False), schema, "quarantine")
    marked = good.select("key", F.lit(1).alias("g")).unionByName(bad.select("key", F.lit(0).alias("g")))
    return marked.groupBy(F.col("key").alias("event_type")).agg(
        F.sum("g").alias("n_good"), F.sum(1 - F.col("g")).alias("n_bad"))


# -- stateless streams --------------------------------------------------------

@query("SELECT upper(p_name) AS name FROM part")
def literal_map_output(spark, sf):
    names = table(spark, sf, "part").select(F.lit(None).cast("string").alias("key"), F.col("p_name").alias("name"))
    backend = topics.FolderTopics(run_dir(spark, "elements"))
    topics.write_topic(topics.encode(names, "key", ["name"]), "elements", backend)
    sent = topics.decode(topics.read_topic(spark, "elements", backend),
                         T.StructType([T.StructField("name", T.StringType())]))
    return landed(sent.select(F.upper("name").alias("name")), "upper")


@query("SELECT upper(p_name) AS name FROM part")
def map_elements(spark, sf):
    return jobs.map_elements(table(spark, sf, "part").select("p_name"), str.upper, "name string")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_to_table(spark, sf):
    rows = landed(event_stream(spark, sf), "events")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""SELECT 1 AS step, count(*) AS n FROM events WHERE {NUMBERED} <= 10
          UNION ALL SELECT 2, count(*) FROM events WHERE {NUMBERED} <= 20
          UNION ALL SELECT 3, count(*) FROM events""")
def fresh_table_query(spark, sf):
    # batch SQL after every committed batch sees what has arrived so far
    events, path, state = table(spark, sf, "events"), run_dir(spark, "fresh"), run_dir(spark, "fresh-state")
    seen = []

    def run(backend):
        started = jobs.stream_to_table(decoded(topics.read_topic(spark, "events", backend)), path, state)
        started.awaitTermination()
        seen.append(spark.read.parquet(path).count())
        return started

    staged(spark, [days(events, 1, 10), days(events, 11, 20), days(events, 21)], run)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(seen)], "step int, n bigint")


@query("""SELECT c_mktsegment, count(*) AS n, round(sum(value), 2) AS total
          FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment""")
def stream_static_join(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = windows.enrich(event_stream(spark, sf), customers, "user_id", "c_custkey")
    return last_result(joined.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), "segments")


@query("""SELECT c_mktsegment, count(*) AS n, round(sum(value), 2) AS total
          FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS u, value FROM events) LEFT JOIN customer ON u = c_custkey
          GROUP BY c_mktsegment""")
def learnt_hot_join(spark, sf):
    # one key has a third of all events; the first query learns that, the second spreads it
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    user = F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")).cast("long")
    backend = events_topic(spark, sf)
    live = decoded(topics.read_topic(spark, "events", backend)).withColumn("user_id", user)
    hot = windows.HotKeys(run_dir(spark, "hot-keys"), "user_id")
    hot.watch(live, run_dir(spark, "hot-keys-state")).awaitTermination()
    joined = windows.enrich(live, customers, "user_id", "c_custkey", small_bytes=0, hot=hot)
    return last_result(joined.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), "segments")


@query(SAME)
def exactly_once_sink(spark, sf):
    # both sinks are started twice on the same checkpoints
    path, state = run_dir(spark, "file"), run_dir(spark, "file-state")
    other, other_state = run_dir(spark, "batch"), run_dir(spark, "batch-state")
    live = event_stream(spark, sf)
    for _ in range(2):
        jobs.start_exactly_once(live, path, state).awaitTermination()
        jobs.start_exactly_once(live, other, other_state, "batch").awaitTermination()
    one, two = spark.read.parquet(path), spark.read.parquet(other).select(*FIELDS)
    same = one.join(two.select("event_id").withColumnRenamed("event_id", "_id"), F.col("event_id") == F.col("_id"))
    return same.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c == "ts" else c for c in FIELDS])


@query(SAME)
def resume_from_checkpoint(spark, sf):
    events, path, state = table(spark, sf, "events"), run_dir(spark, "resumed"), run_dir(spark, "resumed-state")

    def run(backend):
        return jobs.stream_to_table(decoded(topics.read_topic(spark, "events", backend)), path, state)

    staged(spark, [days(events, 1, 15), days(events, 16)], run)
    return spark.read.parquet(path).select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if c == "ts" else c for c in FIELDS])


# -- event time ---------------------------------------------------------------

def _measures():
    total = exact_sum("value")
    return [F.count("*").alias("n"), total.alias("total"), (total / F.count("*")).alias("mean")]


TOTAL = "CAST(sum(CAST(value AS DECIMAL(28, 10))) AS DOUBLE)"
MEASURES = f"count(*) AS n, {TOTAL} AS total, {TOTAL} / count(*) AS mean"
DAY = "(SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d FROM events)"
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(SAME)
def dedup_messages(spark, sf):
    events = table(spark, sf, "events")
    twice = events.unionByName(events.filter("event_type = 'click'"))
    backend = topics.FolderTopics(run_dir(spark, "twice"))
    topics.write_topic(messages(twice), "events", backend)
    once = windows.dedup(decoded(topics.read_topic(spark, "events", backend)), "event_id", "ts", "1 day")
    return landed(once, "dedup").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""SELECT d AS window_start, d + INTERVAL 1 DAY AS window_end, event_type, {MEASURES}
           FROM {DAY} WHERE d + INTERVAL 1 DAY <= {CLOSED} GROUP BY d, event_type""")
def tumbling_agg(spark, sf):
    return landed(windows.window_agg(event_stream(spark, sf), "ts", ["event_type"], _measures(), size="1 day",
                                     delay="1 hour"), "tumbling")


@query(f"""SELECT d AS window_start, d + INTERVAL 2 DAY AS window_end, event_type, {MEASURES}
           FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY * unnest([0, 1]) AS d FROM events)
           WHERE d + INTERVAL 2 DAY <= {CLOSED} GROUP BY d, event_type""")
def sliding_agg(spark, sf):
    cents = F.sum(whole_units("value", 2))
    parts = {"n": (F.count("*"), F.sum), "total": (cents, F.sum)}
    total = F.col("total") / F.lit(100)
    return landed(windows.pane_agg(event_stream(spark, sf), "ts", ["event_type"], parts, "2 days", "1 day", "1 hour",
                                   {"total": total, "mean": total / F.col("n")}), "sliding")


@query(f"""WITH gaps AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE,
                                            true) AS starts FROM events),
                marked AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM gaps)
           SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, {MEASURES}
           FROM marked GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""")
def session_agg(spark, sf):
    return landed(windows.window_agg(event_stream(spark, sf), "ts", ["user_id"], _measures(), gap="30 minutes",
                                     delay="1 hour"), "sessions")


@query(f"""SELECT d AS window_start, d + INTERVAL 1 DAY AS window_end, event_type, {MEASURES}
           FROM {DAY} WHERE d + INTERVAL 1 DAY <= {CLOSED} AND {NUMBERED} >= 3 GROUP BY d, event_type""")
def late_data(spark, sf):
    # days 1 and 2 arrive last, far behind the watermark
    events, path, state = table(spark, sf, "events"), run_dir(spark, "late"), run_dir(spark, "late-state")

    def counted(backend):
        return windows.window_agg(decoded(topics.read_topic(spark, "events", backend)), "ts", ["event_type"],
                                  _measures(), size="1 day", delay="1 hour")

    staged(spark, [days(events, 3, 15), days(events, 16), days(events, 1, 2)],
           lambda backend: jobs.stream_to_table(counted(backend), path, state))
    return spark.read.parquet(path)


@query(f"SELECT event_type, count(*) AS n, min(ts) AS first_ts FROM events WHERE {NUMBERED} <= 2 GROUP BY event_type")
def late_rows_kept(spark, sf):
    # the rows that late_data leaves out
    events, path, state = table(spark, sf, "events"), run_dir(spark, "kept-late"), run_dir(spark, "kept-late-state")
    staged(spark, [days(events, 3, 15), days(events, 16), days(events, 1, 2)],
           lambda backend: windows.keep_late(decoded(topics.read_topic(spark, "events", backend)), "ts", "1 hour", path, state, "1 day"))
    kept = spark.read.parquet(path).groupBy("event_type")
    return kept.agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_ts"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def message_count(spark, sf):
    return last_result(event_stream(spark, sf).groupBy("event_type").agg(F.count("*").alias("n")), "counts")


@query("""SELECT user_id, count(*) AS n, arg_max(value, (ts, value)) AS last_value FROM events GROUP BY user_id""")
def stateful_counter(spark, sf):
    # the state of the first half of the month carries over into the second
    events, path, state = table(spark, sf, "events"), run_dir(spark, "counter"), run_dir(spark, "counter-state")

    def run(backend):
        rows = decoded(topics.read_topic(spark, "events", backend))
        return jobs.write_results(windows.running_count(rows, "user_id", "value", "ts"), path, state, "update")

    staged(spark, [days(events, 1, 15), days(events, 16)], run)
    newest = F.max_by(F.struct("n", "last_value"), "batch").alias("s")
    return spark.read.parquet(path).groupBy("user_id").agg(newest).select("user_id", "s.*")


@query(f"""SELECT d AS window_start, d + INTERVAL 1 DAY AS window_end, event_type, {TOTAL} AS total
           FROM {DAY} WHERE d + INTERVAL 1 DAY <= {CLOSED} GROUP BY d, event_type
           HAVING {TOTAL} > 0.35 * (SELECT count(*) FROM events)""")
def threshold_alerts(spark, sf):
    limit = 0.35 * table(spark, sf, "events").count()
    daily = windows.window_agg(event_stream(spark, sf), "ts", ["event_type"],
                               _measures()[1:2], size="1 day", delay="1 hour")
    return landed(windows.alerts(daily, "total", limit), "alerts")


@query("SELECT count(*) AS messages FROM events")
def consumer_progress(spark, sf):
    seen = jobs.ConsumerProgress(every=10, report=lambda text: None)
    spark.streams.addListener(seen)
    try:
        landed(event_stream(spark, sf), "consumed")
        seen.wait()
    finally:
        spark.streams.removeListener(seen)
    # the listener's total next to a count of the topic itself: equal, or no row
    sent = topics.read_topic(spark, "events", events_topic(spark, sf), streaming=False)
    return sent.agg(F.count("*").alias("messages")).filter(F.col("messages") == seen.messages)


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY event_type")
def stream_sql(spark, sf):
    text = "SELECT event_type, count(*) AS n FROM live_events WHERE value > :least GROUP BY event_type"
    return last_result(windows.stream_sql(event_stream(spark, sf), "live_events", text, least=10), "sql")


@query("""WITH sent AS (SELECT event_id, TIMESTAMP '2024-01-01' + INTERVAL 10 SECOND * event_id AS sent_at FROM events)
          SELECT time_bucket(INTERVAL 10 MINUTE, sent_at) AS window_start,
                 time_bucket(INTERVAL 10 MINUTE, sent_at) + INTERVAL 10 MINUTE AS window_end, count(*) AS n,
                 round(avg(20 + event_id % 10), 6) AS temperature, round(avg(50 + event_id % 20), 6) AS humidity
          FROM sent WHERE time_bucket(INTERVAL 10 MINUTE, sent_at) + INTERVAL 10 MINUTE
                          <= (SELECT max(sent_at) FROM sent) - INTERVAL 1 MINUTE GROUP BY 1""")
def sensor_stats(spark, sf):
    made = topics.sensor_messages(table(spark, sf, "events"), "2024-01-01 00:00:00", 10, "event_id")
    backend = topics.FolderTopics(run_dir(spark, "sensors"))
    topics.write_topic(topics.encode(made, "key", ["id", "timestamp", "message", "data"]), "sensors", backend)
    rows = topics.decode(topics.read_topic(spark, "sensors", backend), topics.SENSOR)
    timed = rows.select(parse_event_time("timestamp").alias("at"), "data.*")
    return landed(windows.window_agg(
        timed, "at", [], [F.count("*").alias("n"), F.round(F.avg("temperature"), 6).alias("temperature"),
                          F.round(F.avg("humidity"), 6).alias("humidity")], size="10 minutes", delay="1 minute"), "sensors")


# -- state per key ---------------------------------------------------------------

CLOSED_DAY = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query(f"""WITH last AS (SELECT * FROM {LOG} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
           SELECT user_id, value FROM last WHERE op <> 'delete'
           UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last)""")
def apply_changes_stream(spark, sf):
    # the second half of the month arrives first: its sequences still win
    events, log, mark = table(spark, sf, "events"), run_dir(spark, "applied"), run_dir(spark, "applied-state")
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")

    def run(backend):
        changes = decoded(topics.read_topic(spark, "events", backend)).withColumn("op", op)
        return jobs.apply_changes_stream(changes, log, mark, "user_id", "event_id")

    staged(spark, [days(events, 16), days(events, 1, 15)], run)
    return jobs.with_changes(target, log, "user_id", "event_id", "op")


@query(f"""SELECT event_id, user_id, round(m, 6) AS mean_before, round(s, 6) AS sd_before,
                 coalesce(n >= 2 AND abs(value - m) > 2.5 * s, false) AS is_anomaly
          FROM (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(value) OVER w AS n FROM events
                WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
          WHERE ts <= date_trunc('millisecond', {CLOSED_DAY})""")
def anomaly_stream(spark, sf):
    rows = replayed(spark, mixed_up(table(spark, sf, "events"))).select("event_id", "user_id", "ts", "value")
    found = landed(stateful.anomaly_stream(rows, "user_id", "ts", "value", 20, 2.5, "event_id", "1 day"), "flagged")
    return found.select("event_id", "user_id", F.round("mean_before", 6).alias("mean_before"),
                        F.round("sd_before", 6).alias("sd_before"), "is_anomaly")


@query(f"""SELECT a.user_id, a.event_id, min(b.ts) AS next_ts, arg_min(b.event_id, (b.ts, b.event_id)) AS next_id
          FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
          WHERE a.event_type = 'view' AND b.event_type = 'purchase'
            AND b.ts <= date_trunc('millisecond', {CLOSED_DAY}) GROUP BY 1, 2""")
def pattern_stream(spark, sf):
    rows = replayed(spark, mixed_up(table(spark, sf, "events"))).select("event_id", "user_id", "ts", "event_type")
    found = landed(stateful.match_stream(rows, "user_id", "ts", "event_type", "view", "purchase", "6 hours", "event_id", "1 day"),
                   "matched")
    return found.select("user_id", "event_id", F.col("next_ts").cast("timestamp_ntz").alias("next_ts"), "next_id")
