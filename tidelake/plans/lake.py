"""Table formats, layouts, row-level changes and versions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators import changes, layout
from tidelake.plans.registry import query, table
from tidelake.session import run_dir
from tidelake.sources import catalog, levels, tables


@query("SELECT * FROM part")
def parquet_io(spark, sf):
    path = run_dir(spark, "parquet")
    tables.write_table(table(spark, sf, "part"), path)
    return tables.read_files(spark, path)


@query("SELECT * FROM part")
def orc_io(spark, sf):
    path = run_dir(spark, "orc")
    tables.write_table(table(spark, sf, "part"), path, fmt="orc")
    return tables.read_files(spark, path, "orc")


@query("SELECT doc_id, text, lang FROM documents")
def csv_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    path = run_dir(spark, "csv")
    tables.write_table(docs, path, fmt="csv", **tables.CSV_TEXT)
    return tables.load_documents(spark, path, "csv", docs.schema)


@query("""SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def federated_query(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    as_orc, as_json = run_dir(spark, "nation"), run_dir(spark, "region")
    tables.write_table(nation, as_orc, fmt="orc")
    tables.write_table(region, as_json, fmt="json")
    places = tables.read_files(spark, as_orc, "orc").join(
        tables.read_files(spark, as_json, "json", region.schema), F.col("n_regionkey") == F.col("r_regionkey"))
    # counted per nation before the join: 25 rows meet 25 rows
    counts = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return counts.join(places, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(
        F.sum("n").alias("n"))


@query("""SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
                 CAST(o_totalprice AS DECIMAL(10, 2)) AS amount FROM orders
          UNION ALL VALUES (-1, 101, DATE '2025-01-15', CAST(99.99 AS DECIMAL(10, 2))),
                           (-2, 102, DATE '2025-01-16', CAST(149.50 AS DECIMAL(10, 2)))""")
def insert_values(spark, sf):
    name, path = f"orders_{uuid.uuid4().hex}", run_dir(spark, "insert")
    table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"), F.col("o_totalprice").cast("decimal(10,2)").alias("amount")
    ).write.option("path", path).saveAsTable(name)
    spark.sql(f"""INSERT INTO {name} VALUES (-1, 101, DATE '2025-01-15', 99.99), (-2, 102, DATE '2025-01-16', 149.50)""")
    return spark.table(name)


SOURCE_TWICE = """(SELECT o_orderkey, o_totalprice, 0 AS ord FROM orders
                   UNION ALL SELECT o_orderkey, o_totalprice + 1, 1 FROM orders)"""


def _absent(spark, sf):
    orders = table(spark, sf, "orders")
    rows = orders.select("o_orderkey", "o_totalprice", F.lit(0).alias("ord"))
    source = rows.unionByName(rows.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("ord", F.lit(1)))
    target = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return target, *changes.insert_if_absent(target, source, "o_orderkey", "ord")


@query("""SELECT o_orderkey, o_totalprice, 'old' AS origin FROM orders WHERE o_orderstatus = 'F'
          UNION ALL SELECT o_orderkey, o_totalprice, 'new' FROM orders WHERE o_orderstatus <> 'F'""")
def insert_if_absent(spark, sf):
    target, new_rows, _ = _absent(spark, sf)
    return target.withColumn("origin", F.lit("old")).unionByName(new_rows.withColumn("origin", F.lit("new")))


@query(f"""SELECT s.o_orderkey, s.ord, CASE WHEN s.ord = 0 AND o.o_orderstatus <> 'F' THEN 'inserted'
                                            ELSE 'skipped' END AS status
           FROM {SOURCE_TWICE} s JOIN orders o USING (o_orderkey)""")
def insert_report(spark, sf):
    return _absent(spark, sf)[2]


RANGE = ("2024-01-05 06:00:00", "2024-01-07 18:00:00")


@query("SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id FROM events")
def partitioned_write(spark, sf):
    path = run_dir(spark, "by_day")
    tables.write_by_time(table(spark, sf, "events").select("event_id", "ts", "user_id"), path, "ts", "day")
    return spark.read.parquet(path).select("event_id", "ts", "day", "user_id")


@query(f"SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '{RANGE[0]}' AND ts < TIMESTAMP '{RANGE[1]}'")
def hidden_partition(spark, sf):
    path = run_dir(spark, "hidden")
    tables.write_by_time(table(spark, sf, "events").select("event_id", "ts", "user_id"), path, "ts", "day")
    return tables.read_by_time(spark.read.parquet(path), "ts", "day", *RANGE).drop("day")


@query("SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def bucketed_write(spark, sf):
    orders_at = f"{sf}/orders.parquet"
    buckets = max(8, layout.files_for(spark, orders_at, 512 << 20))
    sides = []
    for name, key, other in (("customer", "c_custkey", "c_name"), ("orders", "o_custkey", "o_orderkey")):
        side = (f"{name}_{uuid.uuid4().hex}", run_dir(spark, f"{name}-buckets"))
        tables.write_bucketed(table(spark, sf, name).select(key, other), side[0], buckets, key, side[1])
        sides.append(side)
    joined = tables.join_bucketed(spark, *sides, "c_custkey", "o_custkey")
    return joined.groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def partition_evolve(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    change = F.lit("2024-01-16").cast("timestamp_ntz")
    by_month, by_day = run_dir(spark, "by_month"), run_dir(spark, "by_day")
    tables.write_by_time(events.filter(F.col("ts") < change), by_month, "ts", "month", unit="month")
    tables.write_by_time(events.filter(F.col("ts") >= change), by_day, "ts", "day")
    both = tables.read_layouts(spark, [by_month, by_day], drop=["month", "day"])
    return both.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


STATS = ("l_quantity", "l_discount", "l_returnflag")


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls,
               count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_value,
               CAST(max({c}) AS VARCHAR) AS max_value FROM lineitem""" for c in STATS))
def column_stats(spark, sf):
    return tables.profile(table(spark, sf, "lineitem"), STATS)


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, CAST(min({c}) AS VARCHAR) AS smallest,
               true AS distinct_close, true AS median_close FROM lineitem""" for c in ("l_quantity", "l_partkey", "l_returnflag")))
def merged_column_stats(spark, sf):
    # a table that grows by a part; each file is read once, estimates next to the exact values
    lines, path, stats = table(spark, sf, "lineitem").select("l_quantity", "l_partkey", "l_returnflag"), run_dir(spark, "grown"), run_dir(spark, "stats")
    for part in range(2):
        lines.filter(F.pmod("l_partkey", F.lit(2)) == part).write.mode("append").parquet(path)
        tables.add_stats(spark, path, stats, lines.columns)
    merged = tables.table_stats(spark, stats)
    exact = tables.profile(lines, lines.columns).select("column_name", F.col("n_distinct").alias("true_distinct"), "min_value")
    low, high = (F.lit(x) for x in (0.4, 0.6))
    middle = lines.agg(*[F.percentile(c, F.array(low, high)).alias(c) for c in ("l_quantity", "l_partkey")])
    middle = middle.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("range")) for c in middle.columns])).alias("m")).select("m.*")
    both = merged.join(exact, "column_name").join(middle, "column_name", "left")
    return both.select(
        "column_name", "n_rows", "n_nulls", F.col("min_value").alias("smallest"),
        (F.abs(F.col("n_distinct") / F.col("true_distinct") - 1) < 0.08).alias("distinct_close"),
        F.coalesce(F.col("quantile_0_5").between(F.col("range")[0], F.col("range")[1]), F.lit(True)).alias("median_close"))


@query("""SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_brand || ' ' || p_type END AS p_note FROM part""")
def schema_evolve(spark, sf):
    part = table(spark, sf, "part")
    old, new = run_dir(spark, "old"), run_dir(spark, "new")
    tables.write_table(part.filter("p_size <= 25").select("p_partkey", "p_name"), old)
    tables.write_table(part.filter("p_size > 25").select(
        "p_partkey", "p_name", F.concat_ws(" ", "p_brand", "p_type").alias("p_note")), new)
    return tables.union_evolved(spark.read.parquet(old), spark.read.parquet(new))


@query("SELECT * FROM lineitem")
def zorder_layout(spark, sf):
    return layout.zorder(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT * FROM orders")
def compact_files(spark, sf):
    many, few = run_dir(spark, "many"), run_dir(spark, "few")
    table(spark, sf, "orders").repartition(32).write.parquet(many)
    layout.compact(spark, many, few)
    return spark.read.parquet(few)


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 168 HOUR")
def retention(spark, sf):
    return tables.retain(table(spark, sf, "events").select("event_id", "ts"), "ts")


@query("""WITH src AS (
            SELECT c_custkey, c_name, c_nationkey, round(c_acctbal + 100, 2) AS c_acctbal, c_mktsegment
            FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
            UNION ALL SELECT -1 - s_suppkey, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier)
          SELECT t.c_custkey, t.c_name, t.c_nationkey,
                 CASE WHEN s.c_custkey IS NULL THEN t.c_acctbal ELSE s.c_acctbal END AS c_acctbal, t.c_mktsegment
          FROM customer t LEFT JOIN src s ON s.c_custkey = t.c_custkey
          WHERE NOT coalesce(s.c_acctbal < 0, false)
          UNION ALL SELECT s.* FROM src s WHERE NOT EXISTS (SELECT 1 FROM customer t WHERE t.c_custkey = s.c_custkey)""")
def merge_into(spark, sf):
    target = table(spark, sf, "customer")
    raised = target.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).withColumn(
        "c_acctbal", F.round(F.col("c_acctbal") + 100, 2))
    added = table(spark, sf, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"))
    return changes.merge_into(target, raised.unionByName(added), "c_custkey", ["c_acctbal"], F.col("c_acctbal") < 0)


@query("""SELECT p_partkey, round(CASE WHEN p_size > 25 THEN p_retailprice * 1.1::DOUBLE ELSE p_retailprice END, 4)
                 AS p_retailprice FROM part""")
def update_where(spark, sf):
    part = changes.update_where(table(spark, sf, "part"), F.col("p_size") > 25,
                                {"p_retailprice": F.col("p_retailprice") * 1.1})
    return part.select("p_partkey", F.round("p_retailprice", 4).alias("p_retailprice"))


@query("SELECT * FROM part WHERE p_type <> 'ECONOMY'")
def delete_where(spark, sf):
    return changes.delete_where(table(spark, sf, "part"), F.col("p_type") == "ECONOMY")


LOG = """(SELECT user_id, event_id, value, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op
          FROM events)"""


def _log(spark, sf):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return table(spark, sf, "events").select("user_id", "event_id", "value", op.alias("op"))


@query(f"""WITH last AS (SELECT * FROM {LOG} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
           SELECT user_id, value FROM last WHERE op <> 'delete'
           UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last)""")
def apply_changes(spark, sf):
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    return changes.apply_changes(target, _log(spark, sf), "user_id", "event_id", "op")


@query(f"""SELECT user_id, event_id, value FROM (
             SELECT * FROM {LOG} WHERE event_id <= (SELECT max(event_id) // 2 FROM events)
             QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE op <> 'delete'""")
def as_of_version(spark, sf):
    log = _log(spark, sf)
    half = log.agg(F.floor(F.max("event_id") / 2).alias("v")).scalar()
    return changes.as_of(log, "user_id", "event_id", "op", half).select("user_id", "event_id", "value")


def _levels(spark, sf, batches):
    """The log cut by id into numbered batches, added one after the other."""
    rows, log = _log(spark, sf), levels.Log(run_dir(spark, "levels"), ("user_id",), "event_id", fanout=2)
    size = rows.agg(F.max("event_id")).first()[0] // batches + 1
    for n in range(batches):
        log.add(rows.filter((F.col("event_id") >= n * size) & (F.col("event_id") < (n + 1) * size)), n)
    return log


BATCH = "event_id // (SELECT max(event_id) // 5 + 1 FROM events)"


@query(f"""SELECT version, user_id, event_id, value FROM (
             SELECT v AS version, l.* FROM {LOG} l JOIN (SELECT unnest([1, 4]) AS v) ON {BATCH} <= v
             QUALIFY row_number() OVER (PARTITION BY v, user_id ORDER BY event_id DESC) = 1) WHERE op <> 'delete'""")
def as_of_batch(spark, sf):
    # an early and the newest version of a levelled log
    log = _levels(spark, sf, 5)
    versions = [changes.as_of_batch(log, spark, "op", v).withColumn("version", F.lit(v)) for v in (1, 4)]
    return versions[0].unionByName(versions[1]).select("version", "user_id", "event_id", "value")


@query(f"""WITH last AS (SELECT {BATCH} AS version, * FROM {LOG}
                         QUALIFY row_number() OVER (PARTITION BY {BATCH}, user_id ORDER BY event_id DESC) = 1),
           seen AS (SELECT version, op, coalesce(lag(op) OVER (PARTITION BY user_id ORDER BY version) = 'upsert', false) AS live FROM last),
           counts AS (
             SELECT version, count(*) FILTER (op = 'upsert' AND NOT live) AS inserts,
                    count(*) FILTER (op = 'upsert' AND live) AS updates,
                    count(*) FILTER (op = 'delete' AND live) AS deletes FROM seen GROUP BY version)
           SELECT *, CAST(sum(inserts - deletes) OVER (ORDER BY version) AS BIGINT) AS live_rows FROM counts""")
def batch_snapshots(spark, sf):
    rows = _levels(spark, sf, 5).batches(spark).withColumnRenamed("batch", "version")
    return changes.list_snapshots(rows, "user_id", "version", "op")


@query(f"""WITH seen AS (
             SELECT event_id // 1000 AS version, op,
                    coalesce(lag(op) OVER (PARTITION BY user_id ORDER BY event_id) = 'upsert', false) AS live
             FROM {LOG}),
           counts AS (
             SELECT version, count(*) FILTER (op = 'upsert' AND NOT live) AS inserts,
                    count(*) FILTER (op = 'upsert' AND live) AS updates,
                    count(*) FILTER (op = 'delete' AND live) AS deletes FROM seen GROUP BY version)
           SELECT *, CAST(sum(inserts - deletes) OVER (ORDER BY version) AS BIGINT) AS live_rows FROM counts""")
def list_snapshots(spark, sf):
    log = _log(spark, sf).withColumn("version", F.floor(F.col("event_id") / 1000))
    return changes.list_snapshots(log, "user_id", "version", "op", order_col="event_id")


@query("SELECT * FROM orders")
def external_table_write(spark, sf):
    schema, path = f"hive.ext_{uuid.uuid4().hex}", run_dir(spark, "external")
    catalog.create_schema(spark, schema, location=run_dir(spark, "schema"))
    orders = table(spark, sf, "orders")
    catalog.create_table(spark, f"{schema}.orders", orders.schema.toDDL(), location=path)
    orders.write.insertInto(catalog.table_name(spark, f"{schema}.orders"))
    return spark.read.parquet(path)


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, user_id, ts AS event_time,
                 MAP(['action'], [event_type])['action'] AS action FROM events""")
def create_table(spark, sf):
    name = f"iceberg.analytics_{uuid.uuid4().hex}"
    catalog.create_schema(spark, name, if_not_exists=True, location=run_dir(spark, "schema"))
    catalog.create_table(spark, f"{name}.user_events", "event_id BIGINT, user_id BIGINT, event_time TIMESTAMP_NTZ, "
                         "properties MAP<STRING, STRING>", if_not_exists=True)
    properties = F.map_from_arrays(F.array(F.lit("action")), F.array("event_type"))
    rows = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").alias("event_time"),
                                             properties.alias("properties"))
    full = catalog.table_name(spark, f"{name}.user_events")
    rows.write.insertInto(full)
    before = spark.catalog.currentDatabase()
    catalog.use(spark, name)
    try:
        found = spark.table("user_events")
    finally:
        spark.catalog.setCurrentDatabase(before)
    return found.select("event_id", "user_id", "event_time",
                        F.try_element_at("properties", F.lit("action")).alias("action"))


@query("SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part")
def schema_enforce(spark, sf):
    rows = table(spark, sf, "part").select("p_size", "p_name", "p_partkey")
    want = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
                         T.StructField("p_size", T.LongType())])
    return tables.enforce(rows, want)
