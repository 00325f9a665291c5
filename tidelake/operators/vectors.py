"""Similarity of listed pairs, exact and approximate nearest neighbours."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelake.functions import kernels, vector
from tidelake.session import estimated_bytes, materialize
from tidelake.sources.tables import write_table

METRICS = {"dot": vector.dot, "cosine": vector.cosine, "l2": vector.l2}

# above this corpus size the tasks' results are merged in two rounds
MERGE_BYTES = 64 << 30
MERGE_SALTS = 1024

# questions of at most about this many bytes, ids included, are sent to every task; more of
# them are answered slice by slice
BLOCK_BYTES = 32 << 20

# and at most about this many questions, which bounds the pairs that a task scores
BLOCK_QUESTIONS = 2048

# rows that a task hands back at once: they may carry long texts
ANSWER_ROWS = 256


def dot_of_pairs(pairs: DataFrame, vectors: DataFrame, id_col: str, vec_col: str,
                 a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Dot product for each listed pair of ids; a pair with a missing id gives no row."""
    left = vectors.select(F.col(id_col).alias(a), F.col(vec_col).alias("_va"))
    right = vectors.select(F.col(id_col).alias(b), F.col(vec_col).alias("_vb"))
    joined = pairs.join(left, a).join(right, b)
    return joined.withColumn("dot_product", vector.dot("_va", "_vb")).drop("_va", "_vb")


def dimension_stats(df: DataFrame, vec_col: str) -> DataFrame:
    """avg, min, max and count of every vector position (1-based)."""
    exploded = df.select(F.posexplode(vec_col).alias("pos", "x"))
    x = F.col("x").cast("double")
    return (exploded.groupBy((F.col("pos") + 1).alias("dimension"))
            .agg(F.avg(x).alias("avg_value"), F.min(x).alias("min_value"),
                 F.max(x).alias("max_value"), F.count("*").alias("n")))


def centroids(df: DataFrame, group: str, vec_col: str) -> DataFrame:
    """The mean vector of every group; only (group, position) sums are shuffled."""
    exploded = df.select(group, F.posexplode(vec_col).alias("pos", "x"))
    means = exploded.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(group).agg(F.transform(parts, lambda p: p["x"]).alias("centroid"))


def dot_with_first(df: DataFrame, group: str, id_col: str, vec_col: str, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Dot product of every row with the row of the smallest id of its group, in one pass over the rows.

    The first rows are one per group; Spark broadcasts them when they are small.
    """
    first = df.groupBy(group).agg(F.min(F.struct(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))).alias("_f"))
    joined = df.join(materialize(first, "first"), group).filter(F.col(id_col) > F.col("_f.id"))
    return joined.select(F.col("_f.id").alias(a), F.col(id_col).alias(b), vector.dot(F.col("_f.v"), F.col(vec_col)).alias("dot_product"))


def _slices(df: DataFrame, key: str, block_bytes: int, *arrays: str) -> list[DataFrame]:
    """The frame in slices of about ``block_bytes`` and ``BLOCK_QUESTIONS`` rows by a hash of ``key``; whole if it is small."""
    size = sum(F.size(c).cast("long") * 8 for c in arrays) + F.octet_length(F.concat_ws(",", F.col(key).cast("string")))
    rows, total = df.agg(F.count("*"), F.sum(size)).first()
    slices = max(math.ceil((total or 0) / block_bytes), math.ceil(rows / BLOCK_QUESTIONS))
    if slices <= 1:
        return [df]
    # hashed slices are not equally large
    slices = 2 * slices
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(slices)) == i) for i in range(slices)]


def topk(queries: DataFrame, corpus: DataFrame, id_col, vec_col: str, k: int, metric: str = "cosine",
         where: Column | None = None, query_id: str = "query_id", query_vec: str | None = None,
         exclude_self: bool = False, carry=(), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every query the ``k`` corpus rows with the best score.

    Scores are rounded to 6 places and ties go to the smaller id. The result has
    ``query_id``, ``rank``, the id column(s), the corpus columns listed in
    ``carry`` and ``score`` (for l2 a distance).
    Every task returns at most ``k`` rows per query, so the corpus is never shuffled.
    Queries beyond ``block_bytes`` or ``BLOCK_QUESTIONS`` are cut into slices, each a pass over the corpus. A corpus
    vector counts up to the length of the queries; a shorter one raises, as do queries of
    different lengths. Computes the query side eagerly, once.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    if where is not None:
        corpus = corpus.filter(where)
    asked = queries.select(query_id, F.col(query_vec or vec_col).cast("array<double>").alias("_v"))
    asked = materialize(asked.filter(F.col("_v").isNotNull()), "queries")
    kept = [*ids, *carry]
    rows = corpus.select(*kept, F.col(vec_col).alias("_v")).filter(F.col("_v").isNotNull())
    query_type = asked.schema[query_id].dataType
    schema = T.StructType([T.StructField(query_id, query_type), *[rows.schema[c] for c in kept],
                           T.StructField("score", T.DoubleType())])
    part = reduce(DataFrame.unionByName, [_broadcast_top(some, rows, schema, query_id, ids, kept, k, metric, exclude_self)
                                          for some in _slices(asked, query_id, block_bytes, "_v")])
    nearest = [F.desc("score"), *ids]
    if estimated_bytes(rows) > MERGE_BYTES:
        # very many tasks return k rows each: groups of tasks are merged first
        salted = part.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(MERGE_SALTS)))
        first = Window.partitionBy(query_id, "_salt").orderBy(*nearest)
        part = salted.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k).drop("_rank", "_salt")
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*nearest)))
    ranked = ranked.filter(F.col("rank") <= k)
    score = -F.col("score") if metric == "l2" else F.col("score")
    return ranked.select(query_id, "rank", *kept, (score + F.lit(0.0)).alias("score"))


def _broadcast_top(asked, rows, schema, query_id, ids, kept, k, metric, exclude_self):
    """Queries of checked size travel to every task."""
    listed = asked.orderBy(query_id).toArrow()
    names = listed.column(query_id).to_pylist()
    if len(pc.unique(pc.list_value_length(listed.column("_v")))) > 1:
        raise ValueError("queries have different lengths")
    matrix, _ = kernels.stack_vectors(listed.column("_v").combine_chunks()) if names else (np.empty((0, 0)), None)
    target = to_arrow_schema(schema)

    def best_of_partition(batches):
        def parts():
            for batch in batches:
                if batch.num_rows:
                    vectors_, lengths = kernels.stack_vectors(batch.column("_v"), matrix.shape[1])
                    few = kernels.fewer_copies(vectors_, lengths, [batch.column(c) for c in ids], k + bool(exclude_self))
                    if few is not None:
                        batch, vectors_, lengths = batch.take(pa.array(few)), vectors_[few], lengths[few]

                    def take(at, columns=ids, batch=batch):
                        # as objects: a NULL must not turn whole numbers into floats
                        return pd.DataFrame({c: pd.Series(batch.column(c).take(pa.array(at)).to_pylist(), dtype=object)
                                             for c in columns})

                    yield batch.column(ids[0]).to_pandas(), vectors_, lengths, take

        best = kernels.top_rows(parts(), matrix, names, k, metric, ids, exclude_self, kept[len(ids):]) if names else None
        for low in range(0, 0 if best is None else len(best), ANSWER_ROWS):
            some = best.iloc[low:low + ANSWER_ROWS]
            columns = [pa.array([names[q] for q in some["_q"]], type=target.field(0).type)]
            columns += [pa.array(some[c].tolist(), type=target.field(c).type) for c in kept]
            columns.append(pa.array(some["score"].to_numpy(), type=pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return rows.mapInArrow(best_of_partition, schema)


def topk_within(queries: DataFrame, corpus: DataFrame, on: str, id_col: str, vec_col: str, k: int,
                query_vec: str, metric: str = "cosine") -> DataFrame:
    """Top k among the corpus rows that share ``on`` with the query.

    ``queries`` has one row per value of ``on``; it is computed once, so Spark knows
    its size and broadcasts it when it is small. Each corpus row is scored once, and
    each task keeps k rows per value before the shuffle.
    """
    asked = materialize(queries.select(on, F.col(query_vec).alias("_q")), "queries")
    joined = corpus.join(asked, on)
    score = F.round(METRICS[metric]("_q", vec_col), 6)
    scored = joined.select(on, id_col, score.alias("score"))
    nearest = F.asc("score") if metric == "l2" else F.desc("score")
    order = Window.partitionBy(on).orderBy(nearest, id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# folders that a filter on an index names one by one
MOST_FOLDERS = 10_000


# rows from which the centres are learnt, rows of the sample per centre, and queries that measure recall
SAMPLE_ROWS = 200_000
ROWS_PER_CENTRE = 40
RECALL_QUERIES = 100


def sampled(df: DataFrame, total: int, rows: int, salt: str) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of the whole row."""
    if total <= rows:
        return df
    place = F.pmod(F.xxhash64(F.lit(salt), F.to_json(F.struct("*"))), F.lit(1 << 30))
    return df.filter(place < int((1 << 30) * rows / total))


def learn_centres(corpus: DataFrame, vec_col: str, total: int, cells: int | None = None, seed: int = 7,
                  sample_rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """Centres in two levels (cell, coarse, coarse_centre, centre), learnt from a sample of at most about ``sample_rows`` rows.

    The sample is clustered into about the square root of ``cells`` coarse cells, and the rows of every
    coarse cell once more in a task of their own. The sample bounds the number of cells.
    """
    sample = sampled(corpus.select(F.col(vec_col).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull()), total, sample_rows, "sample")
    sample = materialize(sample, "sample")
    size = sample.count()
    cells = min(cells or max(4, int(math.sqrt(total) / 2)), max(1, size // ROWS_PER_CENTRE) if size > 8 * ROWS_PER_CENTRE else 8, max(1, size))
    coarse = max(1, round(math.sqrt(cells)))
    features = sample.withColumn("_features", array_to_vector("_v"))
    model = KMeans(k=coarse, seed=seed, maxIter=10, initMode="k-means||", featuresCol="_features", predictionCol="coarse").fit(
        features.select("_features"))
    tops = [c.tolist() for c in model.clusterCenters()]
    placed = model.transform(features).select("coarse", "_v")
    # a coarse cell gets centres by its share of the sample, one at least
    held = {c: n for c, n in placed.groupBy("coarse").count().collect()}
    shares = {c: max(1, cells * n // size) for c, n in held.items()}
    for c in sorted(held, key=lambda c: shares[c] - cells * held[c] / size)[:max(0, cells - sum(shares.values()))]:
        shares[c] += 1

    def split(key, frame):
        rows = np.stack(frame["_v"].to_numpy())
        centres = kernels.lloyd(rows, shares[int(key[0])], seed)
        return pd.DataFrame({"coarse": int(key[0]), "centre": list(centres)})

    found = placed.groupBy("coarse").applyInPandas(split, "coarse int, centre array<double>")
    centres = found.toPandas().sort_values("coarse", kind="stable").reset_index(drop=True)
    centres["coarse_centre"] = [tops[c] for c in centres["coarse"]]
    return centres.assign(cell=np.arange(len(centres), dtype=np.int32))


def build_index(corpus: DataFrame, id_col: str, vec_col: str, path: str, cells: int | None = None, seed: int = 7,
                sample_rows: int = SAMPLE_ROWS) -> int:
    """Write the corpus as ``path/rows``, partitioned by cell, and its centres; gives their number.

    Centres come from a bounded sample (``learn_centres``), so their number does not grow with the corpus beyond
    it; every row is then assigned once, to the nearest coarse centre and the nearest centre inside that. The
    work is a constant per row. Rows without a vector are left out. Hot cells are split over several files.
    """
    spark, n = corpus.sparkSession, corpus.count()
    centres = learn_centres(corpus, vec_col, n, cells, seed, sample_rows)
    rows = corpus.filter(F.col(vec_col).isNotNull())
    tops = np.stack([centres.loc[centres["coarse"] == c, "coarse_centre"].iloc[0] for c in sorted(centres["coarse"].unique())])
    members = [centres.index[centres["coarse"] == c].to_numpy() for c in sorted(centres["coarse"].unique())]
    matrix = np.stack(centres["centre"].to_numpy())
    schema = T.StructType([*rows.schema, T.StructField("cell", T.IntegerType())])

    def assign(batches):
        for batch in batches:
            vectors_, _ = kernels.stack_vectors(batch.column(vec_col), matrix.shape[1])
            cell = kernels.nearest_centres(vectors_, tops, members, matrix)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    write_table(rows.mapInArrow(assign, schema), f"{path}/rows", partition_by=["cell"], mode="overwrite")
    sizes = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"))
    known = spark.createDataFrame(list(zip(centres["cell"].tolist(), [list(map(float, c)) for c in centres["centre"]])),
                                  "cell int, centre array<double>")
    known.join(sizes, "cell").write.mode("overwrite").parquet(f"{path}/centres")
    return len(centres)


def recall(found: DataFrame, exact: DataFrame, id_col: str, query_id: str = "query_id") -> float:
    """Share of the exact nearest rows that were found."""
    hits = exact.select(query_id, id_col).join(found.select(query_id, id_col), [query_id, id_col], "left_semi").count()
    return hits / max(1, exact.count())


def choose_probes(corpus: DataFrame, index: str, id_col: str, vec_col: str, k: int, metric: str = "l2", target: float = 0.95,
                  queries: int = RECALL_QUERIES) -> int:
    """The fewest probes, doubling, whose measured recall reaches ``target``.

    Measured with about ``queries`` rows of the corpus as queries, next to the exact answer over all rows; a
    query is a bounded sample of rows, the search is not.
    """
    total = corpus.count()
    asked = materialize(sampled(corpus.select(F.col(id_col).alias("query_id"), F.col(vec_col)), total, queries, "queries"), "asked")
    exact = materialize(topk(asked, corpus, id_col, vec_col, k, metric), "exact")
    cells, probes = corpus.sparkSession.read.parquet(f"{index}/centres").count(), 1
    while probes < cells:
        if recall(ann_topk(asked, index, id_col, vec_col, k, probes, metric), exact, id_col) >= target:
            return probes
        probes = min(cells, 2 * probes)
    return cells


def ann_topk(queries: DataFrame, index: str, id_col: str, vec_col: str, k: int, probes: int = 8, metric: str = "l2",
             query_id: str = "query_id") -> DataFrame:
    """Approximate top k: exact within the ``probes`` cells nearest to each query.

    Further cells are probed until they hold ``k`` rows, so a query gets fewer only if
    the corpus has fewer. Only the folders of probed cells are read, and a row is scored
    only against the queries that probe its cell. With as many probes as cells it is exact.
    """
    spark = queries.sparkSession
    asked = queries.select(query_id, F.col(vec_col).cast("array<double>").alias("_q"))
    asked = materialize(asked.filter(F.col(query_id).isNotNull() & F.col("_q").isNotNull()), "queries")
    if len(asked.select(F.size("_q")).distinct().limit(2).collect()) > 1:
        raise ValueError("queries have different lengths")
    visits = materialize(_visits(asked, spark.read.parquet(f"{index}/centres"), probes, k), "visits")
    rows = spark.read.parquet(f"{index}/rows").select("cell", id_col, vec_col)
    wanted = [row["cell"] for row in visits.select(F.explode("_cells").alias("cell")).distinct().limit(MOST_FOLDERS + 1).collect()]
    if len(wanted) <= MOST_FOLDERS:
        # only these folders are listed; beyond that the visits alone pick the rows, with the same result
        rows = rows.filter(F.col("cell").isin(wanted))
    schema = T.StructType([visits.schema[query_id], rows.schema[id_col], T.StructField("score", T.DoubleType())])
    part = reduce(DataFrame.unionByName, [_visited(some, rows, schema, query_id, id_col, vec_col, k, metric)
                                          for some in _slices(visits, query_id, BLOCK_BYTES, "_q", "_cells")])
    scored = part.withColumn("score", F.round("score", 6))
    nearest = F.asc("score") if metric == "l2" else F.desc("score")
    order = Window.partitionBy(query_id).orderBy(nearest, id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _visits(asked, centres, probes, k):
    """The queries with the list of the cells they probe; there are at most as many centres as the sample allows."""
    known = centres.orderBy("cell").toArrow().combine_chunks()
    cells, sizes = known.column("cell").to_numpy(), known.column("n").to_numpy()
    centre = known.column("centre").combine_chunks()

    def visit(batches):
        for batch in batches:
            if batch.num_rows:
                questions, _ = kernels.stack_vectors(batch.column("_q"))
                near = kernels.probed_cells(questions, kernels.stack_vectors(centre, questions.shape[1])[0], sizes, probes, k)
                found = pa.array([cells[at].tolist() for at in near], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "_cells"])

    return asked.mapInArrow(visit, T.StructType([*asked.schema, T.StructField("_cells", T.ArrayType(T.IntegerType()))]))


def _visited(visits, rows, schema, query_id, id_col, vec_col, k, metric):
    """Queries of checked size travel to every task, which scores the rows of a cell against those that probe it."""
    listed = visits.orderBy(query_id).toArrow().combine_chunks()
    names = listed.column(query_id).combine_chunks() if listed.num_rows else None
    if names is None:
        return rows.sparkSession.createDataFrame([], schema)
    matrix, _ = kernels.stack_vectors(listed.column("_q").combine_chunks())
    lists = listed.column("_cells").combine_chunks()
    cell, number = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    order = np.argsort(cell, kind="stable")
    present, first = np.unique(cell[order], return_index=True)
    visitors = dict(zip(present.tolist(), np.split(number[order], first[1:])))
    target = to_arrow_schema(schema)

    def score(batches):
        held = []

        def parts():
            for batch in batches:
                if batch.num_rows:
                    held[:] = [batch.column(id_col)]
                    column = batch.column(vec_col)
                    missing = kernels.missing_values(column, None if metric == "cosine" else matrix.shape[1])
                    yield batch.column("cell").to_numpy(), held[0], *kernels.stack_vectors(column, matrix.shape[1]), missing

        for question, row, value, unknown in kernels.near_in_cells(parts(), matrix, visitors, k, metric):
            columns = [names.take(pa.array(question)), held[0].take(pa.array(row)), pa.array(value, mask=unknown)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return rows.mapInArrow(score, schema)
