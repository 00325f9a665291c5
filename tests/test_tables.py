from __future__ import annotations

import glob
import uuid

import pyarrow.parquet as pq
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake import session
from tidelake.session import run_dir
from tidelake.operators import features, layout
from tidelake.sources import catalog, payloads, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_avro_without_its_connector_says_so(spark, tmp_path):
    with pytest.raises(tables.FormatUnavailable, match="avro"):
        tables.write_table(spark.range(3), str(tmp_path / "a"), fmt="avro")
    with pytest.raises(tables.FormatUnavailable, match="avro"):
        tables.read_files(spark, str(tmp_path), "avro")


def test_object_store_settings():
    conf = session.object_store_conf("http://store:9000", "user", "secret")
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000"
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"


def test_the_shared_folder_is_the_configured_one(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.run_dir(spark, "x") != session.run_dir(spark, "x")


def test_catalog_statements(spark, tmp_path):
    assert {r[0] for r in catalog.show_catalogs(spark).collect()} >= {"spark_catalog"}
    catalog.create_schema(spark, "iceberg.ic_test")
    with pytest.raises(AnalysisException):
        catalog.create_schema(spark, "iceberg.ic_test")
    catalog.create_schema(spark, "iceberg.ic_test", if_not_exists=True)
    assert "ic_test" in {r[0] for r in catalog.show_schemas(spark, "iceberg").collect()}
    assert catalog.show_schemas(spark).count() >= 2
    columns = "order_id INT, customer_id INT, order_date DATE, amount DECIMAL(10,2)"
    for _ in range(2):
        catalog.create_table(spark, "iceberg.ic_test.ic_orders", columns, if_not_exists=True)
    with pytest.raises(AnalysisException):
        catalog.create_table(spark, "iceberg.ic_test.ic_orders", columns)
    catalog.use(spark, "iceberg.ic_test")
    try:
        spark.sql("INSERT INTO ic_orders VALUES (1, 101, DATE '2025-01-15', 99.99), (2, 102, DATE '2025-01-16', 149.50)")
        assert [str(r["amount"]) for r in spark.table("ic_orders").orderBy("order_id").collect()] == ["99.99", "149.50"]
        catalog.add_columns(spark, "iceberg.ic_test.ic_orders", "note STRING")
        assert spark.table("ic_orders").filter("note IS NULL").count() == 2
        tables.analyze(spark, "ic_orders")
        # out of range for DECIMAL(10,2)
        with pytest.raises(PySparkException):
            spark.sql("INSERT INTO ic_orders VALUES (3, 1, DATE '2025-01-15', 123456789012.00, 'x')")
    finally:
        spark.catalog.setCurrentDatabase("default")
    place = str(tmp_path / "outside")
    catalog.create_table(spark, "iceberg.ic_test.outside", "id INT", location=place)
    spark.range(3).select(F.col("id").cast("int")).write.insertInto(catalog.table_name(spark, "iceberg.ic_test.outside"))
    assert spark.read.parquet(place).count() == 3


def test_collections_and_current_time_can_be_inserted(spark):
    catalog.create_schema(spark, "lance.ln_test", if_not_exists=True)
    catalog.create_table(spark, "lance.ln_test.embeddings",
                         "id INT, embedding ARRAY<DOUBLE>, metadata MAP<STRING, STRING>, created_at TIMESTAMP_NTZ")
    name = catalog.table_name(spark, "lance.ln_test.embeddings")
    spark.sql(f"""INSERT INTO {name} VALUES (1, ARRAY(0.1D, 0.2D),
                  map_from_arrays(ARRAY('category', 'language'), ARRAY('tech', 'en')), CURRENT_TIMESTAMP)""")
    row = tables.read_table(spark, name).first()
    assert row["embedding"] == [0.1, 0.2] and row["metadata"]["category"] == "tech" and row["created_at"]


def test_enforce(spark):
    want = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert tables.enforce(spark.createDataFrame([("x", 1)], "b string, a int"), want).first() == (1, "x")
    for bad, text in (("a int", "missing b"), ("a int, b string, c int", "extra c"), ("a array<int>, b string", "a")):
        with pytest.raises(tables.SchemaMismatch, match=text):
            tables.enforce(spark.createDataFrame([], bad), want)


def test_partition_folders_are_pruned(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts")
    tables.write_by_time(events, str(tmp_path / "t"), "ts", "day")
    read = tables.read_by_time(spark.read.parquet(str(tmp_path / "t")), "ts", "day", "2024-01-05 06:00:00",
                               "2024-01-07 18:00:00")
    text = plan(read)
    filters = text[text.index("PartitionFilters"):].split("]")[0]
    assert "day" in filters
    scanned = {f for f in read.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert {f.split("day=")[1][:10] for f in scanned} == {"2024-01-05", "2024-01-06", "2024-01-07"}


def test_bucketed_tables_join_without_a_shuffle(spark, small, tmp_path):
    orders = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_custkey")
    customers = spark.read.parquet(f"{small}/customer.parquet").select("c_custkey", "c_name")
    # one customer places a third of all orders
    orders = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(5)).otherwise(F.col("o_custkey")))
    left, right = ("cust_b", str(tmp_path / "c")), ("ord_b", str(tmp_path / "o"))
    tables.write_bucketed(customers, left[0], 4, "c_custkey", left[1])
    tables.write_bucketed(orders, right[0], 4, "o_custkey", right[1])
    want = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = tables.join_bucketed(spark, left, right, "c_custkey", "o_custkey")
        assert "Exchange" not in plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    apart = tables.join_bucketed(spark, left, right, "c_custkey", "o_custkey", min_rows=100)
    assert joined.exceptAll(want).isEmpty() and want.exceptAll(joined).isEmpty()
    assert apart.exceptAll(want).isEmpty() and want.exceptAll(apart).isEmpty()


def test_zorder_narrows_row_groups(spark, small, tmp_path):
    lines = spark.read.parquet(f"{small}/lineitem.parquet").select("l_partkey", "l_suppkey")
    frame = spark.range(1).select(F.lit(2).alias("a"), F.lit(1).alias("b"))
    # a = 10, b = 01 in bits: taken in turn 1 0 0 1
    assert frame.select(layout.interleave(["a", "b"], 2).alias("z")).first()["z"] == 0b1001

    def spans(df, name):
        df.write.parquet(str(tmp_path / name))
        total = [0, 0]
        for path in glob.glob(str(tmp_path / name / "*.parquet")):
            meta = pq.ParquetFile(path).metadata
            for group in range(meta.num_row_groups):
                for column in (0, 1):
                    stats = meta.row_group(group).column(column).statistics
                    total[column] += stats.max - stats.min
        return total

    plain, clustered = spans(lines.repartition(16), "plain"), spans(layout.zorder(lines, lines.columns, 6, 16), "z")
    assert clustered[0] < 0.6 * plain[0] and clustered[1] < 0.6 * plain[1]


def test_compact(spark, tmp_path):
    src, dst = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(1000).repartition(20).write.parquet(src)
    assert layout.compact(spark, src, dst, 1 << 20) == 1
    assert len(glob.glob(dst + "/*.parquet")) == 1
    assert sorted(r[0] for r in spark.read.parquet(dst).collect()) == list(range(1000))


def test_compact_shuffles_no_rows(spark, tmp_path, monkeypatch):
    src, dst = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(200_000).repartition(16).write.parquet(src)
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda *args: pytest.fail("rows are shuffled"))
    target = layout._folder_bytes(spark, src) // 2 + 1
    assert layout.compact(spark, src, dst, target) == 2 == len(glob.glob(dst + "/*.parquet"))
    assert spark.read.parquet(dst).selectExpr("count(*)", "sum(id)").first() == (200_000, 199_999 * 100_000)


def test_malformed_documents_raise(spark, tmp_path):
    (tmp_path / "d.csv").write_text('doc_id,text\n1,"a\nb ""quoted"" "\nx,y\n')
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    docs = tables.load_documents(spark, str(tmp_path / "d.csv"), "csv", schema)
    with pytest.raises((PySparkException, Py4JJavaError)):
        docs.collect()
    (tmp_path / "e.csv").write_text('doc_id,text\n1,"a\nb ""quoted"" "\n')
    assert tables.load_documents(spark, str(tmp_path / "e.csv"), "csv", schema).first()["text"] == 'a\nb "quoted" '


def test_split_weights(spark):
    ids = spark.range(1000).select((F.col("id") - 500).alias("id"))
    parts = features.training_split(ids, "id", {"train": 70, "valid": 20, "test": 10})
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == {
        "train": 700, "valid": 200, "test": 100}
    with pytest.raises(ValueError):
        features.training_split(ids, "id", {"train": 50})


def test_profile_counts_nulls(spark):
    frame = spark.createDataFrame([(1, "a"), (None, "a"), (3, None)], "x int, y string")
    rows = {r["column_name"]: r for r in tables.profile(frame).collect()}
    assert (rows["x"]["n_rows"], rows["x"]["n_nulls"], rows["x"]["n_distinct"], rows["x"]["max_value"]) == (3, 1, 2, "3")
    assert rows["y"]["n_distinct"] == 1


@pytest.mark.parametrize("unit", ["day", "month"])
def test_ranges_of_time_over_both_layouts(spark, small, unit):
    events, path = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts"), run_dir(spark, "layout")
    tables.write_by_time(events, path, "ts", "part", unit)
    lo, hi = "2024-01-05 06:00:00", "2024-01-20 18:00:00"
    found = tables.read_by_time(spark.read.parquet(path), "ts", "part", lo, hi, unit)
    want = events.filter(f"ts >= TIMESTAMP_NTZ '{lo}' AND ts < TIMESTAMP_NTZ '{hi}'")
    assert found.count() == want.count() > 0
    assert "PartitionFilters: [" in found._jdf.queryExecution().executedPlan().toString()


def test_ranges_of_time_over_mixed_layouts(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts")
    parts = [run_dir(spark, "month"), run_dir(spark, "day"), run_dir(spark, "plain")]
    tables.write_by_time(events.filter("event_id % 3 = 0"), parts[0], "ts", "part", "month")
    tables.write_by_time(events.filter("event_id % 3 = 1"), parts[1], "ts", "part", "day")
    tables.write_table(events.filter("event_id % 3 = 2"), parts[2])
    both = tables.read_layouts(spark, parts)
    lo, hi = "2024-01-05 06:00:00", "2024-01-20 18:00:00"
    want = events.filter(f"ts >= TIMESTAMP_NTZ '{lo}' AND ts < TIMESTAMP_NTZ '{hi}'")
    assert tables.read_by_time(both, "ts", "part", lo, hi, "month").count() == want.count() > 0


def test_nested_fields_are_compared(spark):
    have = spark.createDataFrame([((1, 2), [(3, 4)])], "s struct<a:int,b:int>, l array<struct<x:int,y:int>>")
    for want in ("s struct<a:int,c:int>, l array<struct<x:int,y:int>>", "s struct<a:int,b:int>, l array<struct<x:int>>"):
        with pytest.raises(tables.SchemaMismatch):
            tables.enforce(have, spark.createDataFrame([], want).schema)
    assert tables.enforce(have, spark.createDataFrame([], "l array<struct<y:long,x:int>>, s struct<b:int,a:int>").schema).count() == 1


def test_a_bucket_is_one_file(spark):
    name, path = f"b_{uuid.uuid4().hex}", run_dir(spark, "bucketed")
    tables.write_bucketed(spark.range(5000, numPartitions=16).selectExpr("id % 50 AS k", "id"), name, 32, "k", path)
    files = len(spark.read.parquet(path).inputFiles())
    assert files <= 32


def test_hot_keys_of_either_side_are_joined_apart(spark):
    sides = []
    for key, rows in (("a", [1] * 50 + [2, 3, None]), ("b", [1, 2, 2] + [3] * 40 + [None])):
        side = (f"j_{uuid.uuid4().hex}", run_dir(spark, "bucketed"))
        tables.write_bucketed(spark.createDataFrame([(k, i) for i, k in enumerate(rows)], f"{key} int, i_{key} int"), side[0], 4, key, side[1])
        sides.append(side)
    for limit in (None, 10):
        assert tables.join_bucketed(spark, *sides, "a", "b", min_rows=limit).count() == 50 + 2 + 40


def test_zorder_on_text(spark):
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(["b", "", None, "ä", "abcdefgh", "abcdefgz", "a"] * 30)], "w string, i int")
    out = layout.zorder(rows, ["w", "i"], 4, 4)
    assert out.exceptAll(rows).isEmpty() and out.count() == rows.count()


def test_zorder_cuts_texts_behind_a_common_prefix(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("https://www.example.org/pages/"), F.lpad((F.col("id") * 7919 % 4000).cast("string"), 6, "0"))
                                    .alias("url"), (F.col("id") * 104729 % 4000).alias("n"))
    edges = layout.boundaries(rows, ["url", "n"], 16)
    assert len(edges["url"]) == len(edges["n"]) == 15 and edges["url"] == sorted(edges["url"])
    share = rows.select(layout.range_rank(F.col("url"), edges["url"]).alias("r")).groupBy("r").count().collect()
    assert len(share) == 16 and max(r["count"] for r in share) < 300
    path = str(tmp_path / "z")
    layout.zorder(rows, ["url", "n"], 4, 16).write.parquet(path)

    def read(condition):
        """Files that the statistics of their columns cannot rule out."""
        left = 0
        for file in glob.glob(path + "/*.parquet"):
            meta = pq.ParquetFile(file).metadata
            stats = [meta.row_group(0).column(c).statistics for c in (0, 1)]
            left += condition(stats)
        return left

    # a sixteenth of either column lies in few of the 16 files
    low, high = "https://www.example.org/pages/001000", "https://www.example.org/pages/001249"
    assert read(lambda s: s[0].min <= high and s[0].max >= low) <= 10
    assert read(lambda s: s[1].min <= 1249 and s[1].max >= 1000) <= 10


def test_boundaries_come_from_a_bounded_sample(spark):
    rows = spark.range(50_000).select((F.col("id") % 50_000).alias("n"))
    edges = layout.boundaries(rows, ["n"], 10, sample_rows=2000)["n"]
    assert len(edges) == 9 and all(abs(e - 5000 * (i + 1)) < 2500 for i, e in enumerate(edges))


def test_statistics_of_files_are_made_once_and_add_up(spark, tmp_path):
    path, stats = str(tmp_path / "t"), str(tmp_path / "s")
    rows = spark.range(30_000).select("id", (F.col("id") % 1000).cast("double").alias("v"), F.when(F.col("id") % 10 > 0, F.concat(
        F.lit("k"), (F.col("id") % 77).cast("string"))).alias("w"))
    rows.filter("id < 20000").repartition(3).write.parquet(path)
    assert tables.add_stats(spark, path, stats, rows.columns) == 3 and tables.add_stats(spark, path, stats, rows.columns) == 0
    rows.filter("id >= 20000").coalesce(1).write.mode("append").parquet(path)
    assert tables.add_stats(spark, path, stats, rows.columns) == 1
    got = {r["column_name"]: r for r in tables.table_stats(spark, stats, (0.1, 0.5)).collect()}
    assert {c: (r["n_rows"], r["n_nulls"]) for c, r in got.items()} == {"id": (30_000, 0), "v": (30_000, 0), "w": (30_000, 3000)}
    assert (got["id"]["min_number"], got["id"]["max_number"], got["w"]["min_text"], got["w"]["max_text"]) == (0, 29_999, "k0", "k9")
    for name, true in (("id", 30_000), ("v", 1000), ("w", 77)):
        assert abs(got[name]["n_distinct"] / true - 1) < 0.08
    assert abs(got["id"]["quantile_0_5"] - 15_000) < 1500 and abs(got["v"]["quantile_0_1"] - 100) < 60


def test_payloads_of_mixed_shape(spark):
    bodies = ['{"value": "1.5"}', '{"value": 2}', '{"value": 2.25}', '{"value": "many"}', '{"value": null}', '{"value": [1, 2]}',
              '{"value": {"a": 1}}', "{}", "no json", None, '{"value": true}']
    rows = payloads.parsed(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string"), "body")
    got = {r["i"]: r for r in rows.select("i", payloads.kind("payload", "$.value").alias("k"), payloads.number("payload", "$.value").alias("n"),
                                          payloads.text("payload", "$.value").alias("t")).collect()}
    assert [got[i]["k"] for i in range(11)] == ["text", "number", "number", "text", "null", "array", "object", None, None, None, "boolean"]
    assert [got[i]["n"] for i in range(11)] == [1.5, 2.0, 2.25] + [None] * 8
    assert got[5]["t"] == "[1,2]" and got[6]["t"] == '{"a":1}' and got[3]["t"] == "many"
    shape = payloads.shapes(rows.filter("i < 3"), "payload").first()
    assert (shape["n"], shape["n_bad"]) == (3, 0) and "value" in shape["shape"]


def test_catalogs_that_are_there(spark):
    names = {r["catalog"] for r in catalog.show_catalogs(spark).collect()}
    assert "spark_catalog" in names and "iceberg" not in names


def test_written_steps_can_be_cleared(spark):
    from tidelake.session import materialize, shared_dir

    other = spark.newSession()
    frame = materialize(other.range(3), "cleared")
    assert spark.sparkContext.applicationId in frame.inputFiles()[0] and frame.count() == 3
    assert frame.inputFiles()[0].split("://")[-1].lstrip("/").startswith(shared_dir(spark).split("://")[-1].lstrip("/"))
