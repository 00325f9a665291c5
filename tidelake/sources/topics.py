"""Keyed JSON message topics, on Kafka or as a folder of Parquet files.

Both backends share columns of Spark's Kafka source, partition and offset included, so
only the place of a topic differs.

A folder topic is a sequence of writes. A write is made beside the topic and then named
``seq=n/write=id`` in one step, so readers see all of it or nothing, two writers cannot
take the same place, and the batch of a stream that is run again finds itself there and adds
nothing. (The commit log of Spark's file sink is honoured only by readers of that one
sink's folder; a topic has any number of writers.) An offset is the write's place in the sequence
and the row's place in it, so offsets grow and have gaps, as in a compacted Kafka topic.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.times import iso_text
from tidelake.sources import places

ENVELOPE = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType())])
# columns of the files and of their folders
STORED = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("topic", T.StringType()),
    T.StructField("timestamp", T.TimestampType()), T.StructField("partition", T.IntegerType()), T.StructField("place", T.LongType()),
    T.StructField("seq", T.LongType()), T.StructField("write", T.StringType())])
# bits of an offset that count the rows of one write in one partition; the rest count writes
PLACE_BITS = 33


class TopicNotFound(Exception):
    """The topic does not exist."""


@dataclass(frozen=True)
class FolderTopics:
    """Topics below ``root``. A key always goes to the same one of ``partitions``; each
    partition is written by ``lanes`` tasks, so that a hot key is no hot task."""

    root: str
    partitions: int = 4
    lanes: int = 2

    def path(self, topic: str) -> str:
        return f"{self.root}/{topic}"

    def staging(self) -> str:
        return f"{self.root}/_staging/{uuid.uuid4().hex}"


@dataclass(frozen=True)
class KafkaTopics:
    servers: str
    options: tuple = ()


def read_topic(spark, topic: str, backend, starting="earliest", streaming: bool = True,
               max_files: int | None = None) -> DataFrame:
    """All messages from the first offset on, with the envelope columns.

    ``starting`` may be a dictionary of partition and first offset; partitions that it
    does not name are read from their first offset. ``max_files`` bounds a micro-batch.
    """
    given = isinstance(starting, dict)
    if isinstance(backend, KafkaTopics):
        reader = spark.readStream if streaming else spark.read
        offsets = json.dumps({topic: {str(p): o for p, o in starting.items()}}) if given else starting
        loaded = (reader.format("kafka").option("kafka.bootstrap.servers", backend.servers)
                  .option("subscribe", topic).option("startingOffsets", offsets)
                  .option("failOnDataLoss", "true").options(**dict(backend.options)).load())
        return loaded.select(*ENVELOPE.fieldNames())
    if not given and starting != "earliest":
        raise ValueError("a folder topic is read from its first offset or from given ones")
    reader = (spark.readStream if streaming else spark.read).schema(STORED)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    try:
        stored = reader.parquet(backend.path(topic))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            raise TopicNotFound(topic) from error
        raise
    messages = stored.withColumn("offset", F.shiftleft("seq", PLACE_BITS) + F.col("place")).select(*ENVELOPE.fieldNames())
    if given:
        behind = F.lit(False)
        for partition, first in starting.items():
            behind = behind | ((F.col("partition") == int(partition)) & (F.col("offset") < int(first)))
        messages = messages.filter(~behind)
    return messages


def encode(df: DataFrame, key_col, value_cols=None, ts_col=None) -> DataFrame:
    """Key and JSON value of every row, as bytes; a NULL key stays NULL.

    Time columns become ISO text with microseconds.
    """
    names = value_cols or df.columns
    fields = [iso_text(F.col(c)).alias(c) if isinstance(
        df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(c) for c in names]
    stamp = F.col(ts_col).cast("timestamp") if ts_col else F.current_timestamp()
    key = key_col if isinstance(key_col, Column) else F.col(key_col)
    return df.select(key.cast("string").cast("binary").alias("key"),
                     F.to_json(F.struct(*fields)).cast("binary").alias("value"),
                     stamp.alias("timestamp"))


def partition_of(partitions: int) -> Column:
    """The partition of a message: of its key, or of its value where it has no key."""
    text = F.md5(F.coalesce("key", "value", F.lit("").cast("binary")))
    return (F.conv(F.substring(text, 1, 8), 16, 10).cast("long") % partitions).cast("int")


def sequence(path: str) -> int:
    """The place of a write in its topic."""
    return int(path.rpartition("/seq=")[2].partition("/")[0])


def append(messages: DataFrame, topic: str, backend: FolderTopics, write: str | None = None, known: bool = True):
    """Add encoded messages to a folder topic, once for all for each ``write``. Gives the path of the write.

    ``known`` False says that ``write`` cannot be there yet and saves looking for it.
    """
    spark, path = messages.sparkSession, backend.path(topic)
    if write and known:
        there = places.found(spark, f"{path}/seq=*/write={write}")
        if there:
            return f"{path}/seq={sequence(there[0])}/write={write}"
    write, staging = write or uuid.uuid4().hex, backend.staging()
    lane = F.pmod(F.monotonically_increasing_id(), F.lit(backend.lanes))
    rows = messages.select("key", "value", F.lit(topic).alias("topic"), "timestamp").withColumn(
        "partition", partition_of(backend.partitions))
    rows = rows.withColumn("_task", (F.col("partition") * backend.lanes + lane).cast("int"))
    rows = rows.repartitionById(backend.partitions * backend.lanes, "_task")
    # rows of a task are counted from 0; lanes take turns
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    rows = rows.withColumn("place", row * backend.lanes + F.col("_task") % backend.lanes).drop("_task")
    rows.write.parquet(f"{staging}/write={write}")
    place = max(map(sequence, places.found(spark, f"{path}/seq=*")), default=-1) + 1
    while not places.move_new(spark, staging, f"{path}/seq={place}"):
        place += 1
    return f"{path}/seq={place}/write={write}"


def written(spark, path: str) -> DataFrame:
    """The messages of one write, with the envelope columns."""
    root = path.rpartition("/seq=")[0]
    stored = spark.read.schema(STORED).option("basePath", root).parquet(path)
    return stored.withColumn("offset", F.shiftleft("seq", PLACE_BITS) + F.col("place")).select(*ENVELOPE.fieldNames())


def write_topic(messages: DataFrame, topic: str, backend, checkpoint: str | None = None, on_batch=None,
                max_bytes: int | None = None):
    """Append ``messages`` (key, value, timestamp) to a topic.

    A batch frame is written at once. A stream starts a query that needs a
    ``checkpoint``; ``on_batch(report, number)`` sees what became of each message of a batch, see
    ``deliveries``. Messages of more than ``max_bytes`` are not sent. A batch that is run again
    after a failure adds nothing to what it has sent.
    """
    small = messages.filter(~too_large(max_bytes)) if max_bytes else messages
    if isinstance(backend, KafkaTopics):
        out = small.select("key", "value", F.lit(topic).alias("topic"))
        writer = (out.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
                  if messages.isStreaming else out.write)
        writer = writer.format("kafka").option("kafka.bootstrap.servers", backend.servers).options(
            **dict(backend.options))
        return writer.start() if messages.isStreaming else writer.save()
    if not messages.isStreaming:
        append(small, topic, backend)
        return None
    writer_name = hashlib.md5(checkpoint.encode()).hexdigest()
    first = []  # only the first batch after a start can have been run before

    def deliver(frame, number):
        sent = frame.filter(~too_large(max_bytes)) if max_bytes else frame
        path = append(sent, topic, backend, f"{writer_name}-{number}", known=not first)
        first.append(number)
        if on_batch:
            on_batch(deliveries(written(frame.sparkSession, path), frame, topic, max_bytes), number)

    return (messages.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def too_large(max_bytes: int) -> Column:
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    return size > max_bytes


def deliveries(sent: DataFrame, given: DataFrame | None = None, topic: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Per message its key, timestamp, topic, partition and offset, or the error for which it was not sent."""
    report = sent.select("key", "timestamp", "topic", "partition", "offset", F.lit(None).cast("string").alias("error"))
    if max_bytes is None:
        return report
    none = [F.lit(None).cast("int").alias("partition"), F.lit(None).cast("long").alias("offset")]
    refused = given.filter(too_large(max_bytes)).select(
        "key", "timestamp", F.lit(topic).alias("topic"), *none, F.lit(f"message of more than {max_bytes} bytes").alias("error"))
    return report.unionByName(refused)


def delivery_report(report: DataFrame) -> DataFrame:
    """Per topic the messages that were delivered, with their first and last time."""
    return report.filter("offset IS NOT NULL").groupBy("topic").agg(
        F.count("*").alias("messages"), F.min("timestamp").alias("first_sent"), F.max("timestamp").alias("last_sent"))


class BadMessage(Exception):
    """A value that is no JSON object of the declared schema."""


def decode(df: DataFrame, schema: T.StructType, mode: str = "fail"):
    """Parse the JSON value into columns next to the envelope.

    ``fail`` raises on the first value that does not parse, a NULL value
    included. ``quarantine`` gives (good, bad); bad rows keep their bytes.
    """
    text = F.col("value").cast("string")
    envelope = [F.col("topic"), F.col("key").cast("string").alias("key"), F.col("timestamp").alias("sent_at")]
    if mode == "fail":
        whole = F.when(F.col("value").isNull(), F.raise_error(F.lit("message without a value")).cast("string"))
        parsed = F.from_json(whole.otherwise(text), schema, {"mode": "FAILFAST"})
        return df.select(*envelope, parsed.alias("_m")).select("topic", "key", "sent_at", "_m.*")
    if mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    watched = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = df.select(*envelope, "value", F.from_json(
        text, watched, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_m"))
    broken = F.col("_m").isNull() | F.col("_m._corrupt").isNotNull()
    good = parsed.filter(~broken).select("topic", "key", "sent_at", "_m.*").drop("_corrupt")
    bad = parsed.filter(broken).select("topic", "key", "sent_at", "value")
    return good, bad


# fixed values: payload shapes and texts of the demo producers
SENSOR = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("timestamp", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("temperature", T.IntegerType()), T.StructField("humidity", T.IntegerType())]))])
MESSAGE_TEXT = "Messaggio numero "
KEY_TEXT = "key-"
VALUE_EVENT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("timestamp", T.DoubleType()),
    T.StructField("value", T.LongType()), T.StructField("source", T.StringType())])


def sensor_messages(ids: DataFrame, base_ts, step_seconds: int = 1, id_col: str = "id") -> DataFrame:
    """A sensor message per id, one every ``step_seconds`` from ``base_ts`` on.

    ``ids`` is any frame of ids; ``spark.range(n)`` gives n messages.
    """
    i = F.col(id_col)
    base = F.unix_micros(F.lit(base_ts).cast("timestamp"))
    sent = F.timestamp_micros(base + i * F.lit(step_seconds * 1_000_000))
    data = F.struct((F.lit(20) + i % 10).cast("int").alias("temperature"),
                    (F.lit(50) + i % 20).cast("int").alias("humidity"))
    return ids.select(F.concat(F.lit(KEY_TEXT), i.cast("string")).alias("key"), i.cast("long").alias("id"),
                      iso_text(sent).alias("timestamp"),
                      F.concat(F.lit(MESSAGE_TEXT), i.cast("string")).alias("message"), data.alias("data"))


def value_events(ids: DataFrame, base_epoch: float, source: str, id_col: str = "id") -> DataFrame:
    """Per id an event of value ``2 * id``, one per second from ``base_epoch`` on."""
    i = F.col(id_col).cast("long")
    return ids.select(i.alias("id"), (F.lit(float(base_epoch)) + i).alias("timestamp"),
                      (i * 2).alias("value"), F.lit(source).alias("source"))
