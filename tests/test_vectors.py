from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelake.functions import kernels, vector
from tidelake.operators import vectors
from tidelake.session import run_dir

ROWS = [(1, "doc1.txt", [0.1, 0.2, 0.3, 0.4, 0.5]), (2, "doc2.txt", [0.2, 0.3, 0.1, 0.5, 0.4]),
        (3, "doc3.txt", [0.15, 0.25, 0.2, 0.45, 0.42])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id int, document_name string, embedding array<double>")


@pytest.fixture(scope="module")
def embeddings(spark, small):
    return spark.read.parquet(f"{small}/embeddings.parquet")


def test_dot_product_of_two_ids(spark, docs):
    pair = spark.createDataFrame([(1, 2)], "id_a int, id_b int")
    assert vectors.dot_of_pairs(pair, docs, "id", "embedding").first()["dot_product"] == pytest.approx(0.51)


def test_a_missing_id_gives_no_row(spark, docs):
    pair = spark.createDataFrame([(1, 9)], "id_a int, id_b int")
    assert vectors.dot_of_pairs(pair, docs, "id", "embedding").isEmpty()


def test_length_rules(spark):
    def dot(a, b):
        frame = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        return frame.select(vector.dot("a", "b").alias("d")).first()["d"]

    assert dot([1.0, 2.0], [3.0, 4.0, 100.0]) == 11.0
    assert dot([], []) == 0.0
    with pytest.raises(PySparkException, match="shorter"):
        dot([1.0, 2.0], [3.0])


def test_other_metrics(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])],
                                  "a array<double>, b array<double>")
    first, zero = frame.select(vector.cosine("a", "b").alias("c"), vector.l2("a", "b").alias("l")).collect()
    assert first["c"] == pytest.approx(0.96) and first["l"] == pytest.approx(2 ** 0.5)
    assert zero["c"] is None


def test_fixture_statistics(docs):
    assert [r["id"] for r in docs.filter(F.element_at("embedding", 1) > 0.15).collect()] == [2]
    stats = {r["dimension"]: r for r in vectors.dimension_stats(docs, "embedding").collect()}
    assert stats[1]["avg_value"] == pytest.approx(0.15) and stats[2]["avg_value"] == pytest.approx(0.25)
    assert stats[1]["n"] == 3


def brute(embeddings, metric, k):
    rows = embeddings.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, m = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    if metric == "l2":
        scores = -np.round(np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(-1)), 6)
    else:
        unit = m / np.linalg.norm(m, axis=1, keepdims=True) if metric == "cosine" else m
        scores = np.round(unit @ unit.T, 6)
    np.fill_diagonal(scores, -np.inf)
    return {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-scores[a, j], ids[j]))[:k]]
            for a, i in enumerate(ids)}


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
@pytest.mark.parametrize("block", [vectors.BLOCK_BYTES, 40_000])
def test_topk_equals_brute_force(embeddings, metric, block):
    queries = embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.topk(queries, embeddings.repartition(5), "vec_id", "embedding", 4, metric, exclude_self=True,
                         block_bytes=block)
    got: dict = {}
    for row in found.orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    assert got == brute(embeddings, metric, 4)


def test_results_of_many_tasks_are_merged_in_two_rounds(embeddings, monkeypatch):
    queries = embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    plain = vectors.topk(queries, embeddings.repartition(9), "vec_id", "embedding", 3)
    monkeypatch.setattr(vectors, "MERGE_BYTES", 0)
    monkeypatch.setattr(vectors, "MERGE_SALTS", 2)
    merged = vectors.topk(queries, embeddings.repartition(9), "vec_id", "embedding", 3)
    assert plain.exceptAll(merged).isEmpty() and merged.exceptAll(plain).isEmpty() and plain.count() == 1500


def test_scores_are_computed_in_bounded_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    questions, corpus = rng.normal(size=(7, 4)), rng.normal(size=(300, 4))
    ids = pd.Series(range(300))
    part = [(ids, corpus, np.linalg.norm(corpus, axis=1), lambda at: pd.DataFrame({"id": np.asarray(at)}))]
    whole = kernels.top_rows(part, questions, list(range(7)), 4, "dot", ["id"], False)
    monkeypatch.setattr(kernels, "SCORE_CELLS", 100)
    cut = kernels.top_rows(part, questions, list(range(7)), 4, "dot", ["id"], False)
    assert whole.reset_index(drop=True).equals(cut.reset_index(drop=True)) and len(cut) == 28


def test_carried_columns_are_fetched_once_per_row_of_the_best(spark):
    """1,000 equal rows: a batch hands on k of them, not one per question and row."""
    questions, corpus, fetched = np.ones((50, 4)), np.ones((1000, 4)), []
    columns = {"id": np.arange(1000)[::-1].copy(), "text": np.array([f"t{i}" for i in range(999, -1, -1)], dtype=object)}

    def take(at, names=("id", "text")):
        if "text" in names:
            fetched.extend(at)
        return pd.DataFrame({c: columns[c][at] for c in names})

    part = [(pd.Series(columns["id"]), corpus, np.full(1000, 2.0), lambda at, names=("id",): take(at, names))] * 2
    best = kernels.top_rows(part, questions, list(range(50)), 3, "cosine", ["id"], False, ["text"])
    assert len(fetched) <= 6 and len(best) == 150 and set(best["text"]) == {"t0", "t1"}
    rows = spark.createDataFrame([(i, f"t{i}", [1.0, 0.0]) for i in range(600)], "id int, text string, v array<double>")
    asked = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(300)], "query_id int, v array<double>")
    got = vectors.topk(asked, rows.coalesce(1), "id", "v", 2, "dot", carry=["text"]).collect()
    assert {(r["rank"], r["id"], r["text"]) for r in got} == {(1, 0, "t0"), (2, 1, "t1")} and len(got) == 600


def test_topk_with_fewer_rows_than_k_and_no_queries(spark, docs):
    queries = docs.select(F.col("id").alias("query_id"), "embedding")
    assert vectors.topk(queries, docs, "id", "embedding", 10).count() == 9
    assert vectors.topk(queries.limit(0), docs, "id", "embedding", 10).isEmpty()


def test_topk_where_and_carry(docs):
    queries = docs.filter("id = 1").select(F.col("id").alias("query_id"), "embedding")
    rows = vectors.topk(queries, docs, "id", "embedding", 1, where=F.col("id") > 1, carry=["document_name"]).collect()
    assert [(r["id"], r["document_name"]) for r in rows] == [(3, "doc3.txt")]


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "id int, v array<double>").repartition(6)
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, v array<double>")
    found = vectors.topk(query, rows, "id", "v", 3)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [0, 1, 2]


def test_index_holds_every_row_and_all_probes_are_exact(spark, embeddings):
    path = run_dir(spark, "index")
    assert vectors.build_index(embeddings, "vec_id", "embedding", path, cells=8) == 8
    assert spark.read.parquet(f"{path}/rows").select("vec_id").distinct().count() == embeddings.count()
    queries = embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vectors.topk(queries, embeddings, "vec_id", "embedding", 5, "l2").select("query_id", "vec_id", "score")
    full = vectors.ann_topk(queries, path, "vec_id", "embedding", 5, probes=8).select("query_id", "vec_id", "score")
    assert exact.select("query_id", "vec_id").exceptAll(full.select("query_id", "vec_id")).isEmpty()
    some = vectors.ann_topk(queries, path, "vec_id", "embedding", 5, probes=4).select("query_id", "vec_id")
    assert some.intersect(exact.select("query_id", "vec_id")).count() / exact.count() > 0.6


def test_only_probed_cells_are_read(spark, embeddings):
    path = run_dir(spark, "index")
    vectors.build_index(embeddings, "vec_id", "embedding", path, cells=10)
    query = embeddings.filter("vec_id = 3").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.ann_topk(query, path, "vec_id", "embedding", 3, probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and plan.count("cell#") and found.first()["vec_id"] == 3


def test_vectors_of_mixed_lengths(spark):
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, v array<double>")
    longer = spark.createDataFrame([(1, [1.0, 2.0, 99.0]), (2, [3.0, 4.0])], "id int, v array<double>")
    got = vectors.topk(queries, longer, "id", "v", 2, "dot").collect()
    assert [(r["id"], r["score"]) for r in got] == [(2, 7.0), (1, 3.0)]
    shorter = longer.union(spark.createDataFrame([(3, [5.0])], longer.schema))
    with pytest.raises(Exception, match="shorter"):
        vectors.topk(queries, shorter, "id", "v", 2, "dot").collect()
    ragged = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0])], "query_id int, v array<double>")
    with pytest.raises(Exception, match="lengths"):
        vectors.topk(ragged, longer, "id", "v", 2, "dot").collect()


def test_distances_of_long_vectors_do_not_cancel(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=64) * 5000
    rows = [(i, (base + (i * 1e-4) * (np.arange(64) == 0)).tolist()) for i in range(40)]
    corpus = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    queries = spark.createDataFrame([(1, base.tolist())], "query_id int, v array<double>")
    got = vectors.topk(queries, corpus, "id", "v", 5, "l2").orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3, 4]
    assert [r["score"] for r in got] == pytest.approx([i * 1e-4 for i in range(5)], abs=1.1e-6)


def test_carried_columns_keep_nulls_and_types(spark):
    corpus = spark.createDataFrame([(1, [1.0], 1 << 60), (2, [2.0], None)], "id int, v array<double>, extra long")
    queries = spark.createDataFrame([(1, [1.0])], "query_id int, v array<double>")
    got = vectors.topk(queries, corpus, "id", "v", 2, "dot", carry=["extra"]).orderBy("rank").collect()
    assert [r["extra"] for r in got] == [None, 1 << 60]


def test_approximate_search_fills_k_and_recalls(spark, small):
    rows, path = spark.read.parquet(f"{small}/embeddings.parquet"), run_dir(spark, "index")
    cells = vectors.build_index(rows, "vec_id", "embedding", path)
    asked = rows.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vectors.topk(asked, rows, "vec_id", "embedding", 10, "l2").select("query_id", "vec_id")
    near = vectors.ann_topk(asked, path, "vec_id", "embedding", 10, probes=-(-3 * cells // 4))
    assert near.join(exact, ["query_id", "vec_id"]).count() >= 0.9 * exact.count()
    few = vectors.ann_topk(asked, path, "vec_id", "embedding", 120, probes=1)
    assert few.groupBy("query_id").count().filter("count <> 120").isEmpty()


def test_centres_come_from_a_bounded_sample(spark):
    rng = np.random.default_rng(2)
    spots = rng.normal(size=(12, 6)) * 20
    rows = [(i, (spots[i % 12] + rng.normal(size=6)).tolist()) for i in range(6000)] + [(9000, None)]
    corpus = spark.createDataFrame(rows, "id int, v array<double>").repartition(4)
    centres = vectors.learn_centres(corpus, "v", 6001, cells=500, sample_rows=600)
    # of about 600 rows at most one centre for each 40
    assert 8 <= len(centres) <= 20 and sorted(centres["cell"]) == list(range(len(centres)))
    path = run_dir(spark, "index")
    cells = vectors.build_index(corpus, "id", "v", path, sample_rows=1500)
    held = spark.read.parquet(f"{path}/rows")
    assert held.count() == 6000 and spark.read.parquet(f"{path}/centres").agg(F.sum("n")).first()[0] == 6000
    probes = vectors.choose_probes(corpus.filter("v IS NOT NULL"), path, "id", "v", 5)
    assert probes < cells
    asked = corpus.filter("id % 100 = 0 AND v IS NOT NULL").select(F.col("id").alias("query_id"), "v")
    exact = vectors.topk(asked, corpus, "id", "v", 5, "l2")
    assert vectors.recall(vectors.ann_topk(asked, path, "id", "v", 5, probes), exact, "id") >= 0.9


def test_rows_go_to_the_nearest_centre_of_the_nearest_coarse_one():
    rng = np.random.default_rng(4)
    rows, centres = rng.normal(size=(300, 4)), rng.normal(size=(9, 4))
    members = [np.array([0, 1, 2]), np.array([3, 4]), np.array([5, 6, 7, 8])]
    tops = np.stack([centres[m].mean(axis=0) for m in members])
    for row, cell in zip(rows, kernels.nearest_centres(rows, tops, members, centres)):
        own = members[int(((tops - row) ** 2).sum(axis=1).argmin())]
        assert cell == own[((centres[own] - row) ** 2).sum(axis=1).argmin()]
    assert len(kernels.lloyd(np.ones((50, 3)), 5, 1)) == 1


def test_few_copies_of_a_vector_are_scored():
    rng = np.random.default_rng(5)
    corpus = np.concatenate([np.ones((1000, 4)), rng.normal(size=(20, 4))])
    ids = pa.array([None, *range(1019, 0, -1)], pa.int64())
    kept = kernels.fewer_copies(corpus, np.linalg.norm(corpus, axis=1), [ids], 3)
    assert kept.tolist() == [0, 998, 999, *range(1000, 1020)]
    assert kernels.fewer_copies(corpus[1000:], np.ones(20), [ids[1000:]], 3) is None


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_few_pairs_leave_the_cells(metric):
    """2,000 rows and 200 questions: a few pairs for each question are handed on, the best ones among them."""
    rng = np.random.default_rng(6)
    questions, corpus = rng.normal(size=(200, 8)), rng.normal(size=(2000, 8))
    corpus[500:1500], cells = corpus[0], np.arange(2000, dtype=np.int32) % 4
    visits, whole = {c: np.arange(200) for c in (0, 2, 3)}, np.linalg.norm(corpus, axis=1)
    parts = [(cells[low:low + 500], pa.array(range(low, low + 500)), corpus[low:low + 500], whole[low:low + 500], np.zeros(500, dtype=bool))
             for low in range(0, 2000, 500)]
    place, found = [], {}

    def batches():
        for low, part in zip(range(0, 2000, 500), parts):
            place[:] = [low]
            yield part

    pairs = 0
    for number, row, score, unknown in kernels.near_in_cells(batches(), questions, visits, 5, metric):
        pairs += len(number)
        assert not unknown.any() and not (cells[row + place[0]] == 1).any()
        for q, r, s in zip(number, row + place[0], score):
            found.setdefault(q, []).append((-s if metric != "l2" else s, r))
    assert pairs < 20_000
    asked = np.flatnonzero(cells != 1)
    for q in range(200):
        exact = np.round(np.linalg.norm(corpus[asked] - questions[q], axis=1) if metric == "l2" else
                         -corpus[asked] @ questions[q] / (whole[asked] * np.linalg.norm(questions[q]) if metric == "cosine" else 1.0), 6)
        want = [r for _, r in sorted(zip(exact, asked))[:5]]
        assert [r for _, r in sorted((round(s, 6), r) for s, r in found[q])[:5]] == want


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_approximate_search_scores_as_the_plain_expressions(spark, monkeypatch, metric):
    """Copies, NULL and infinite positions, NaN and zero vectors; questions in slices."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)] + [(100 + i, [0.5, 0.5, 0.5, 9.0]) for i in range(40)]
    rows += [(200, [0.0, 0.0, 0.0]), (201, [None, 1.0, 1.0]), (202, [float("nan"), 1.0, 1.0]), (203, [float("inf"), 0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "id int, v array<double>").withColumn("cell", F.col("id") % 3)
    path = run_dir(spark, "index")
    corpus.write.partitionBy("cell").parquet(f"{path}/rows")
    sizes = corpus.groupBy("cell").agg(F.count("*").alias("n"))
    sizes.withColumn("centre", F.array(F.col("cell").cast("double"), F.lit(0.0), F.lit(0.0))).write.parquet(f"{path}/centres")
    asked = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(10)] + [(10, [0.5, 0.5, 0.5]), (11, [0.0, 0.0, 0.0]),
                                  (12, None), (None, [1.0, 1.0, 1.0])], "query_id int, v array<double>")
    monkeypatch.setattr(vectors, "BLOCK_QUESTIONS", 4)
    monkeypatch.setattr(kernels, "SCORE_CELLS", 100)
    score = F.round(vectors.METRICS[metric]("q", "v"), 6)
    pairs = asked.filter("query_id IS NOT NULL AND v IS NOT NULL").withColumnRenamed("v", "q").crossJoin(corpus).select("query_id", "id", score.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.asc("score") if metric == "l2" else F.desc("score"), "id")
    want = pairs.withColumn("rank", F.row_number().over(order)).filter("rank <= 6")
    got = vectors.ann_topk(asked, path, "id", "v", 6, probes=3, metric=metric)
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 72
    # pairs are not joined and scored one by one
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()
    ragged = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0])], "query_id int, v array<double>")
    with pytest.raises(ValueError, match="lengths"):
        vectors.ann_topk(ragged, path, "id", "v", 2)
    assert vectors.ann_topk(asked.limit(0), path, "id", "v", 2).isEmpty()


def test_cells_are_probed_until_they_hold_k_rows():
    centres, sizes = np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([1, 1, 5, 9])
    near = kernels.probed_cells(np.array([[0.1], [3.0], [np.nan]]), centres, sizes, 1, 3)
    assert [at.tolist() for at in near] == [[0, 1, 2], [3], []]
