from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidelake.operators import changes
from tidelake.session import run_dir
from tidelake.sources import levels

ORDERS = "order_id int, customer_id int, order_date date, amount decimal(10,2)"
TWO = [(1, 101, datetime.date(2025, 1, 15), Decimal("99.99")), (2, 102, datetime.date(2025, 1, 16), Decimal("149.50"))]
RELAXED = dict(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))


def test_insert_if_absent_is_idempotent(spark):
    target = spark.createDataFrame([], ORDERS)
    source = spark.createDataFrame([(*row, i) for i, row in enumerate(TWO)], ORDERS + ", ord int")
    new_rows, report = changes.insert_if_absent(target, source, "order_id", "ord")
    assert new_rows.count() == 2 and {r["status"] for r in report.collect()} == {"inserted"}
    new_rows, report = changes.insert_if_absent(target.unionByName(new_rows), source, "order_id", "ord")
    assert new_rows.isEmpty() and [r["status"] for r in report.collect()] == ["skipped", "skipped"]


def test_insert_if_absent_keeps_maps_and_arrays(spark):
    schema = "id int, embedding array<double>, metadata map<string,string>"
    source = spark.createDataFrame([(1, [0.1], {"category": "tech"}, 0), (1, [0.2], {"category": "ai"}, 1)],
                                   schema + ", ord int")
    new_rows, _ = changes.insert_if_absent(spark.createDataFrame([], schema), source, "id", "ord")
    assert [(r["id"], r["embedding"], r["metadata"]) for r in new_rows.collect()] == [(1, [0.1], {"category": "tech"})]


def test_insert_if_absent_refuses_a_null_key(spark):
    source = spark.createDataFrame([(None, 1)], "k int, ord int")
    with pytest.raises(PySparkException, match="NULL in key column"):
        changes.insert_if_absent(spark.createDataFrame([], "k int"), source, "k", "ord")


KEYED = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 99)), max_size=12)


@settings(**RELAXED)
@given(KEYED, KEYED)
def test_insert_if_absent_model(spark, old, new):
    target = spark.createDataFrame(old, "k int, v int")
    source = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(new)], "k int, v int, ord int")
    want, have = {}, {k for k, _ in old}
    for k, v in new:
        if k not in have:
            want[k] = v
            have.add(k)
    new_rows, report = changes.insert_if_absent(target, source, "k", "ord")
    assert sorted((r["k"], r["v"]) for r in new_rows.collect()) == sorted(want.items())
    assert report.filter("status = 'inserted'").count() == len(want) and report.count() == len(new)


@settings(**RELAXED)
@given(KEYED, st.dictionaries(st.integers(0, 6), st.integers(-20, 20), max_size=7))
def test_merge_model(spark, old, new):
    target = spark.createDataFrame(old, "k int, v int")
    source = spark.createDataFrame(list(new.items()), "k int, v int")
    want = [(k, new.get(k, v)) for k, v in old if new.get(k, 0) >= 0]
    want += [(k, v) for k, v in new.items() if k not in {k for k, _ in old}]
    merged = changes.merge_into(target, source, "k", ["v"], F.col("v") < 0)
    assert sorted((r["k"], r["v"]) for r in merged.collect()) == sorted(want)


def test_merge_refuses_two_source_rows_for_one_target_row(spark):
    target = spark.createDataFrame([(1, 1)], "k int, v int")
    twice = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(PySparkException, match="more than one source row"):
        changes.merge_into(target, twice, "k", ["v"]).collect()
    # two rows of a key the target lacks are two inserts
    other = spark.createDataFrame([(5, 2), (5, 3)], "k int, v int")
    assert changes.merge_into(target, other, "k", ["v"]).count() == 3


def test_update_and_delete_treat_null_as_no_match(spark):
    frame = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "k int, v int")
    raised = changes.update_where(frame, F.col("v") > 10, {"v": F.col("v") + 1})
    assert sorted((r["k"], r["v"]) for r in raised.collect()) == [(1, 5), (2, None), (3, 51)]
    kept = changes.delete_where(frame, F.col("v") > 10)
    assert sorted(r["k"] for r in kept.collect()) == [1, 2]


LOG = st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["upsert", "delete"])), min_size=1, max_size=20)


@settings(**RELAXED)
@given(LOG, st.integers(0, 20))
def test_versions_model(spark, log, v):
    frame = spark.createDataFrame([(k, i, op, i * 10) for i, (k, op) in enumerate(log)],
                                  "k int, version int, op string, v int")
    state, counts = {}, []
    for i, (k, op) in enumerate(log):
        live = k in state
        counts.append((i, int(op == "upsert" and not live), int(op == "upsert" and live),
                       int(op == "delete" and live)))
        if op == "upsert":
            state[k] = i * 10
        else:
            state.pop(k, None)
        counts[-1] += (len(state),)
        if i == v:
            break
    want = dict(state) if v < len(log) else state
    found = changes.as_of(frame, "k", "version", "op", v)
    assert {r["k"]: r["v"] for r in found.collect()} == want
    listed = changes.list_snapshots(frame, "k", "version", "op", min_rows=5).orderBy("version").limit(len(counts))
    assert [tuple(r) for r in listed.collect()] == counts
    empty = spark.createDataFrame([], "k int, v int")
    applied = changes.apply_changes(empty, frame.filter(F.col("version") <= v), "k", "version", "op")
    assert {r["k"]: r["v"] for r in applied.collect()} == want


def test_one_of_equal_source_rows_is_reported_as_inserted(spark):
    target = spark.createDataFrame([(9, "x")], "k int, v string")
    source = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "a", 5), (2, "c", None), (9, "d", 1)], "k int, v string, o int")
    new, report = changes.insert_if_absent(target, source, "k", "o")
    assert sorted(tuple(r) for r in new.collect()) == [(1, "a"), (2, "c")]
    told = sorted((r["k"], r["status"]) for r in report.collect())
    assert told == [(1, "inserted"), (1, "skipped"), (1, "skipped"), (2, "inserted"), (9, "skipped")]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9), st.sampled_from(["upsert", "delete"])), max_size=4),
                min_size=1, max_size=7))
def test_levelled_log_model(spark, batches):
    log = levels.Log(run_dir(spark, "log"), ("k",), "seq", fanout=2)
    states, best = [], {}
    for n, batch in enumerate(batches):
        log.add(spark.createDataFrame(batch, "k int, seq int, op string").coalesce(1), n)
        for k, seq, op in batch:  # equal sequences: the one that sorts last
            best[k] = max(best.get(k, (-1, "")), (seq, op))
        states.append(dict(best))
    for n in {0, len(batches) // 2, len(batches) - 1}:
        assert {r["k"]: (r["seq"], r["op"]) for r in log.read(spark, n).collect()} == states[n]
        assert len(log.cover(spark, n)) <= (n + 1).bit_length()


def test_a_log_read_names_no_later_folder_and_a_repeated_batch_adds_nothing(spark):
    log = levels.Log(run_dir(spark, "log"), ("k",), "seq", fanout=3)
    frame = spark.range(20).select((F.col("id") % 5).alias("k"), F.col("id").alias("seq"), F.lit("upsert").alias("op"))
    for n in (0, 1, 2, 3, 3):
        log.add(frame.withColumn("seq", F.col("seq") + 100 * n), n)
    assert log.runs(spark) == {(0, 0), (1, 1), (2, 2), (0, 2), (3, 3)}
    files = {f.rpartition("/run=")[2].partition("/")[0] for f in log.read(spark, 1).inputFiles()}
    assert files == {"0-0", "1-1"}
    assert {f.rpartition("/run=")[2].partition("/")[0] for f in log.read(spark).inputFiles()} == {"0-2", "3-3"}
    assert {(r["batch"], r["count"]) for r in log.batches(spark).groupBy("batch").count().collect()} == {(n, 5) for n in range(4)}
    log.forget(spark, 2)
    assert log.runs(spark) == {(0, 2), (3, 3)} and log.read(spark).agg(F.min("seq")).first()[0] == 315
    with pytest.raises(ValueError, match="not in the log"):
        log.read(spark, 1)


def test_equal_sequences_have_one_winner(spark):
    frame = spark.createDataFrame([(1, 5, "a"), (1, 5, "c"), (1, 5, "b"), (2, 1, None)], "k int, seq int, op string")
    for parts in (1, 4):
        assert {r["op"] for r in levels.newest(frame.repartition(parts), ["k"], "seq").collect()} == {"c", None}
