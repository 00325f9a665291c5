"""Projections, filters, joins, aggregates, windows, sorts, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions.exact import exact_sum, whole_units
from tidelake.functions.times import iso_text, micros, parse_event_time
from tidelake.operators import features, skew
from tidelake.plans.registry import query, table, views
from tidelake.sources import payloads


@query("SELECT * FROM orders")
def table_scan(spark, sf):
    return table(spark, sf, "orders")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def project_columns(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_equals(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def alias_computed(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"))


@query("SELECT c_custkey, upper(c_name) AS name_upper FROM customer")
def map_upper(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.upper("c_name").alias("name_upper"))


@query("""SELECT doc_id, source FROM documents WHERE map_extract(MAP(['lang', 'source'], [lang, source]), 'lang')[1] = 'en'""")
def filter_metadata(spark, sf):
    metadata = F.map_from_arrays(F.array(F.lit("lang"), F.lit("source")), F.array("lang", "source"))
    docs = table(spark, sf, "documents").select("doc_id", metadata.alias("metadata"))
    return docs.filter(F.try_element_at("metadata", F.lit("lang")) == "en").select(
        "doc_id", F.try_element_at("metadata", F.lit("source")).alias("source"))


JOINS = {"inner": "INNER JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}


@query(" UNION ALL ".join(
    f"""SELECT '{kind}' AS join_type, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM (SELECT * FROM customer WHERE c_acctbal >= 0) c {text}
             (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON c_custkey = o_custkey
        GROUP BY c_mktsegment""" for kind, text in JOINS.items()))
def equi_joins(spark, sf):
    customers = table(spark, sf, "customer").filter("c_acctbal >= 0").select("c_custkey", "c_mktsegment")
    # orders are counted per customer before they are joined, so every join has
    # unique keys and a customer with very many orders is one row
    orders = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    parts = []
    for kind in JOINS:
        joined = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), kind)
        parts.append(joined.groupBy("c_mktsegment").agg(
            F.sum(F.coalesce("n", F.lit(1))).alias("n"), F.round(F.sum("total"), 2).alias("total"))
            .select(F.lit(kind).alias("join_type"), "c_mktsegment", "n", "total"))
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT c_custkey, c_name FROM customer
          WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def semi_join(spark, sf):
    dear = table(spark, sf, "orders").filter("o_totalprice > 400000").select("o_custkey").distinct()
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(
        dear, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("""SELECT o_orderkey, o_totalprice FROM orders s
          WHERE NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_orderstatus = 'F' AND t.o_orderkey = s.o_orderkey)""")
def anti_join_new_keys(spark, sf):
    orders = table(spark, sf, "orders")
    present = orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    return orders.select("o_orderkey", "o_totalprice").join(present, "o_orderkey", "left_anti")


@query("SELECT count(*) AS n FROM orders")
def count_star(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def count_where_key(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def ask(spark, text, args):
    """Run a fixed SQL question with bound arguments."""
    return spark.sql(text, args=args)


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def query_tool(spark, sf):
    views(spark, sf, "orders")
    return ask(spark, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = :status", {"status": "F"})


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
                 CAST(sum(CAST(l_extendedprice AS DECIMAL(28, 10))) AS DOUBLE) / count(*) AS avg_price, min(l_shipdate) AS first_ship,
                 max(l_discount) AS max_discount, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers
          FROM lineitem GROUP BY ALL HAVING count(*) > 100""")
def group_aggregates(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), (exact_sum("l_extendedprice") / F.count("*")).alias("avg_price"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_discount").alias("max_discount"),
        F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers")).filter("n > 100")


@query(" UNION ALL ".join(
    f"""SELECT '{form}' AS form, p_brand, p_type, CAST(GROUPING(p_brand, p_type) AS BIGINT) AS level,
               count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(28, 10))) AS DOUBLE) / count(*) AS avg_price FROM part GROUP BY {text}"""
    for form, text in (("rollup", "ROLLUP (p_brand, p_type)"), ("cube", "CUBE (p_brand, p_type)"),
                       ("sets", "GROUPING SETS ((p_brand), (p_type))"))))
def grouping_sets(spark, sf):
    part = table(spark, sf, "part")
    columns = [F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"),
               (exact_sum("p_retailprice") / F.count("*")).alias("avg_price")]
    brand, kind = F.col("p_brand"), F.col("p_type")
    forms = {"rollup": part.rollup(brand, kind), "cube": part.cube(brand, kind),
             "sets": part.groupingSets([[brand], [kind]], brand, kind)}
    return reduce(DataFrame.unionByName, [
        grouped.agg(*columns).select(F.lit(form).alias("form"), "p_brand", "p_type", "level", "n", "avg_price")
        for form, grouped in forms.items()])


@query("""SELECT o_orderkey, o_custkey, row_number() OVER w AS row_number,
                 rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rank,
                 dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS dense_rank,
                 ntile(4) OVER w AS ntile
          FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def window_ranking(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return skew.ranking(orders, ["o_custkey"], ["o_totalprice", "o_orderkey"], descending=["o_totalprice"],
                        ntile=4).drop("o_totalprice")


@query("""SELECT event_id, user_id, lag(value) OVER w AS value_before, lead(value) OVER w AS value_after,
                 first_value(value) OVER w AS first_value,
                 last_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_value
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_analytic(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    packed = F.struct("value")
    walked = skew.scan(events, ["user_id"], ["ts", "event_id"], prev={"_b": packed}, following={"_a": packed})
    order = F.struct("ts", "event_id")
    ends = events.groupBy("user_id").agg(F.min_by("value", order).alias("first_value"),
                                         F.max_by("value", order).alias("last_value"))
    return walked.join(ends, "user_id").select(
        "event_id", "user_id", F.col("_b.value").alias("value_before"), F.col("_a.value").alias("value_after"),
        "first_value", "last_value")


@query("""SELECT event_id, user_id,
                 round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                        ROWS UNBOUNDED PRECEDING), 2) AS running_sum,
                 round(sum(value) OVER (PARTITION BY user_id ORDER BY ts
                                        RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 2) AS hour_sum
          FROM events""")
def window_frames(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    walked = skew.scan(events, ["user_id"], ["ts", "event_id"], sums={"running_sum": whole_units("value", 2)})
    rolled = features.rolling_features(walked, "user_id", "ts", "value", {"hour": 3600}, "event_id")
    return rolled.select("event_id", "user_id", (F.col("running_sum") / 100).alias("running_sum"),
                         F.round("sum_hour", 2).alias("hour_sum"))


@query("SELECT * FROM orders ORDER BY o_orderkey")
def order_by_key(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def limit_rows(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderkey").select("o_orderkey", "o_totalprice").limit(10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_global(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey").limit(10)


SETS = {"union_all": "UNION ALL", "union": "UNION", "intersect_all": "INTERSECT ALL", "intersect": "INTERSECT",
        "except_all": "EXCEPT ALL", "except": "EXCEPT"}


@query(" UNION ALL ".join(
    f"""SELECT '{form}' AS form, o_custkey, count(*) AS n FROM (
          SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' {text}
          SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey""" for form, text in SETS.items()))
def set_ops(spark, sf):
    orders = table(spark, sf, "orders")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    done = orders.filter("o_orderstatus = 'F'").select("o_custkey")
    forms = {"union_all": urgent.unionAll(done), "union": urgent.union(done).distinct(),
             "intersect_all": urgent.intersectAll(done), "intersect": urgent.intersect(done),
             "except_all": urgent.exceptAll(done), "except": urgent.subtract(done)}
    return reduce(DataFrame.unionByName, [
        rows.groupBy("o_custkey").agg(F.count("*").alias("n")).select(F.lit(form).alias("form"), "o_custkey", "n")
        for form, rows in forms.items()])


SUBQUERIES = """
    WITH rich AS (
        SELECT c.c_custkey, c.c_nationkey FROM customer c
        WHERE c.c_acctbal > (SELECT avg(i.c_acctbal) FROM customer i WHERE i.c_nationkey = c.c_nationkey))
    SELECT n_name, count(*) AS n_rich FROM rich JOIN nation ON n_nationkey = c_nationkey
    WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)
      AND n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')
    GROUP BY n_name"""


@query(SUBQUERIES)
def subqueries_ctes(spark, sf):
    views(spark, sf, "customer", "nation", "supplier", "region")
    return spark.sql(SUBQUERIES)


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1),
                     lambda i: embedding[i]::DOUBLE * 2.0)), 6) AS total,
                 CAST(len(embedding) AS INTEGER) AS dims, round(embedding[1]::DOUBLE, 6) AS first_value,
                 round([embedding[1]::DOUBLE, embedding[2]::DOUBLE][2], 6) AS second_value
          FROM embeddings""")
def scalar_array_funcs(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    doubled = F.transform(F.sequence(F.lit(1), F.cardinality("v")), lambda i: F.element_at(F.col("v"), i) * 2.0)
    return vectors.select(
        "vec_id", F.round(F.reduce(doubled, F.lit(0.0), lambda s, x: s + x, lambda s: s), 6).alias("total"),
        F.cardinality("v").alias("dims"), F.round(F.element_at("v", 1), 6).alias("first_value"),
        F.round(F.element_at(F.array(F.element_at("v", 1), F.element_at("v", 2)), 2), 6).alias("second_value"))


@query("""SELECT doc_id, MAP(['lang', 'source'], [lang, source])['source'] AS source,
                 MAP(['lang', 'source'], [lang, source])['category'] AS category,
                 CAST(cardinality(MAP(['lang', 'source'], [lang, source])) AS INTEGER) AS entries FROM documents""")
def scalar_map(spark, sf):
    entry = F.map_from_arrays(F.array(F.lit("lang"), F.lit("source")), F.array("lang", "source"))
    return table(spark, sf, "documents").select("doc_id", entry.alias("m")).select(
        "doc_id", F.try_element_at("m", F.lit("source")).alias("source"),
        F.try_element_at("m", F.lit("category")).alias("category"), F.size("m").alias("entries"))


@query("""SELECT event_id, ts >= DATE '2024-01-15' AS second_half, CAST(ts AS DATE) AS day, ts AS from_text,
                 date_trunc('second', ts) AS from_epoch FROM events""")
def scalar_time(spark, sf):
    events = table(spark, sf, "events")
    seconds = F.floor(micros("ts") / 1_000_000).cast("string")
    return events.select(
        "event_id", (F.col("ts") >= F.expr("DATE '2024-01-15'")).alias("second_half"), F.to_date("ts").alias("day"),
        parse_event_time(iso_text("ts")).cast("timestamp_ntz").alias("from_text"),
        parse_event_time(seconds).cast("timestamp_ntz").alias("from_epoch"))


@query("""SELECT c_custkey, c_acctbal * 2 + 1 AS scaled, CAST(20 + c_custkey % 10 AS BIGINT) AS bounded,
                 'key-' || c_custkey AS label, upper(c_mktsegment) AS segment FROM customer""")
def scalar_text_math(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") * 2 + 1).alias("scaled"), (F.lit(20) + F.col("c_custkey") % 10).alias("bounded"),
        F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("label"),
        F.upper("c_mktsegment").alias("segment"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS key_text, user_id, value, event_type FROM events")
def scalar_json(spark, sf):
    events = table(spark, sf, "events")
    packed = events.select(
        "event_id", F.col("user_id").cast("string").cast("binary").alias("key"),
        F.to_json(F.struct("user_id", "value", "event_type")).cast("binary").alias("body"))
    parsed = F.from_json(F.col("body").cast("string"), "user_id BIGINT, value DOUBLE, event_type STRING")
    return packed.select("event_id", F.col("key").cast("string").alias("key_text"), parsed.alias("j")).select(
        "event_id", "key_text", "j.*")


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS sum_k
          FROM events GROUP BY event_type""")
def semi_structured_scan(spark, sf):
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN CAST(value * 100 AS BIGINT) END) AS BIGINT) AS cents,
                 count(*) FILTER (event_type = 'click') AS as_text, count(*) FILTER (event_type = 'view') AS as_number,
                 count(*) FILTER (event_type = 'error') AS as_object, count(*) FILTER (event_type = 'signup') AS absent,
                 max(CASE WHEN event_type = 'error' THEN event_id % 7 END) AS largest_code
          FROM events GROUP BY event_type""")
def mixed_payloads(spark, sf):
    # every kind of event sends its value in a shape of its own
    kind, value = F.col("event_type"), F.col("value").cast("string")
    inner = F.when(kind == "click", F.concat(F.lit('"value": "'), value, F.lit('"'))).when(
        kind == "view", F.concat(F.lit('"value": '), value)).when(
        kind == "error", F.concat(F.lit('"value": {"code": '), (F.col("event_id") % 7).cast("string"), F.lit("}"))).when(
        kind == "signup", F.lit('"other": 1')).otherwise(F.lit('"value": null'))
    sent = table(spark, sf, "events").select("event_type", F.concat(F.lit("{"), inner, F.lit("}")).alias("body"))
    rows = payloads.parsed(sent, "body")
    shape = payloads.kind("payload", "$.value")
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(F.rint(payloads.number("payload", "$.value") * 100).cast("long")).alias("cents"),
        F.count(F.when(shape == "text", 1)).alias("as_text"), F.count(F.when(shape == "number", 1)).alias("as_number"),
        F.count(F.when(shape == "object", 1)).alias("as_object"), F.count(F.when(shape.isNull(), 1)).alias("absent"),
        F.max(F.try_variant_get("payload", "$.value.code", "long")).alias("largest_code"))
