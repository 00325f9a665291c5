"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline as C
import pytest

import __spark_entry__ as entry
from compare import compare, connect
from tidelake.llm import op10_forest
from tidelake.llm import queries as Q


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def count(items, *names):
    return Counter(tuple(r[n] for n in names) for r in items)


def stage_outputs(spark, docs, folder, tmp_path):
    for k, (_, stage) in enumerate(C.STAGES):
        path = str(tmp_path / f"stage{k}")
        stage(spark, docs, folder).write.parquet(path)
        out = spark.read.parquet(path)
        yield k, docs, out
        docs = out


def check(spark, docs, folder, tmp_path):
    for k, before, after in stage_outputs(spark, docs, folder, tmp_path):
        old, new = rows(before), rows(after)
        texts = [(r["doc_id"], r["text"]) for r in old]
        if k < 4:
            assert after.columns == C.COLUMNS
        if k == 0:
            kept = op10_forest.quality_rules(before, C.read(spark, folder, "labels")).where("kept").collect()
            assert Counter(r.doc_id for r in kept) == Counter(r["doc_id"] for r in new)
            assert not count(new, *C.COLUMNS) - count(old, *C.COLUMNS)
        if k == 1:
            assert Counter((i, h) for i, _, _, h in brute.lines(texts)) == Counter((r["doc_id"], brute.sha(r["text"] or "")) for r in new)
        if k == 2:
            links = brute.jaccard(texts, 5, 80)
            stay = {i for i, _, c in links if i is not None and c == i}
            ids = Counter(r["doc_id"] for r in new)
            assert {i for i in ids if i is not None} == stay and all(n == 1 for i, n in ids.items() if i is not None)
            assert ids[None] == sum(i is None for i, _ in texts)
            assert not count(new, *C.COLUMNS) - count(old, *C.COLUMNS)
        if k == 3:
            tests = [tuple(r) for r in C.read(spark, folder, "benchmark").select("item_id", "text").collect()]
            clean = [r for r, hit in zip(old, brute.contamination(texts, tests)) if not hit[-1]]
            assert count(clean, *C.COLUMNS) == count(new, *C.COLUMNS)
        if k == 4:
            assert Counter(r["doc_id"] for r in old) == Counter(r["doc_id"] for r in new)
            assert all(0 <= r["taken"] <= 3 * r["size"] for r in new)
            total = sum(r["size"] for r in old and new)
            assert abs(sum(r["taken"] for r in new) - total) <= 0.03 * total + 8


def test_stages_on_documents(spark, small, tmp_path):
    check(spark, spark.read.parquet(f"{small}/documents.parquet"), small, tmp_path)


def test_stages_on_odd_rows(spark, odd, small, tmp_path):
    check(spark, odd.select(*C.COLUMNS), small, tmp_path)


def test_stages_on_no_rows(spark, none, small, tmp_path):
    for _, _, out in stage_outputs(spark, none.select(*C.COLUMNS), small, tmp_path):
        assert out.count() == 0


def test_run_is_the_last_stage(spark, small):
    out = entry.queries()["pipeline"](spark, small)
    assert set(out.columns) >= {"doc_id", "size", "taken", "target"} and out.count() > 100


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, small, name):
    problem, _, _ = compare(spark, connect(small), small, Q.QUERIES[name], Q.SQL[name])
    assert problem is None


def test_all_ten_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in Q.QUERIES)
    assert numbers == list(range(1, 11)) and set(Q.QUERIES) <= set(entry.queries())
