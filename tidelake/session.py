"""Session building, run-time settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # long texts: an Arrow batch is bounded by bytes, not only by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    # sessions are merged inside each task first, so a hot key shuffles
    # sessions rather than events
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

DEFAULT_PARTITIONS = "200"
FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def object_store_conf(endpoint, access_key, secret_key, path_style=True, tls=False):
    """Spark settings that address an S3-compatible store at a custom endpoint."""
    prefix = "spark.hadoop.fs.s3a."
    return {
        prefix + "endpoint": endpoint,
        prefix + "access.key": access_key,
        prefix + "secret.key": secret_key,
        prefix + "path.style.access": str(path_style).lower(),
        prefix + "connection.ssl.enabled": str(tls).lower(),
        prefix + "impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
    }


def build_session(app="tidelake", master=None, conf=None):
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark):
    """Apply the run-time settings the operators rely on to any session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if spark.conf.get("spark.sql.shuffle.partitions") == DEFAULT_PARTITIONS:
        # nobody has chosen a number yet; stream state is cut into as many, for good
        cores = context.defaultParallelism
        spark.conf.set("spark.sql.shuffle.partitions", str(cores if one_process(spark) else max(200, 2 * cores)))
    if not one_process(spark) and spark.conf.get(FIRST_PARTITIONS, None) is None:
        # shuffles start with many partitions, adaptive execution joins small ones
        spark.conf.set(FIRST_PARTITIONS, str(max(2000, 8 * context.defaultParallelism)))
    return spark


def one_process(spark):
    """Driver and executor are one process (not so for ``local-cluster``)."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def shared_dir(spark):
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not one_process(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tidelake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_dir(spark, name):
    """A new folder name for one run of one operator."""
    return f"{shared_dir(spark)}/tidelake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_runs(spark):
    """Remove what this application has written to the shared folder between steps.

    Results that are still read from there must be written elsewhere before.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidelake/{spark.sparkContext.applicationId}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df, name):
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage of a result that is read more than once, and lets Spark know
    its size, so that a small one is broadcast and a large one is not.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df):
    """The planner's size estimate; far too large rather than too small when unknown."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


# an input estimated below this size may be shuffled just to use all cores
SPREAD_BYTES = 1 << 30


def spread(df):
    """Spread a small input over the cores before per-row Python work.

    A table of ordinary size comes in many splits and stays as it is.
    """
    if estimated_bytes(df) >= SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
