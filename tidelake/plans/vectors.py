"""Vector, retrieval and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions.times import micros
from tidelake.operators import features, retrieval, vectors
from tidelake.plans.registry import query, table
from tidelake.session import materialize, run_dir, spread

DOT = """round(list_sum(list_transform(range(1, len(a.embedding) + 1),
             lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6)"""


@query(f"""SELECT a.vec_id AS id_a, b.vec_id AS id_b, {DOT} AS dot_product
           FROM embeddings a JOIN embeddings b ON a.vec_id = (SELECT min(vec_id) FROM embeddings)
            AND b.vec_id = (SELECT max(vec_id) FROM embeddings)""")
def cross_join_single_rows(spark, sf):
    # the two one-row sides are looked up by id: one pair of ids gives one row, or none
    rows = table(spark, sf, "embeddings")
    pair = rows.agg(F.min("vec_id").alias("id_a"), F.max("vec_id").alias("id_b"))
    found = vectors.dot_of_pairs(pair, rows, "vec_id", "embedding")
    return found.select("id_a", "id_b", F.round("dot_product", 6).alias("dot_product"))


@query(f"""SELECT a.vec_id AS id_a, b.vec_id AS id_b, {DOT} AS dot_product
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_dot_product(spark, sf):
    rows = table(spark, sf, "embeddings")
    pairs = rows.select(F.col("vec_id").alias("id_a"), (F.col("vec_id") + 1).alias("id_b"))
    found = vectors.dot_of_pairs(pairs, rows, "vec_id", "embedding")
    return found.select("id_a", "id_b", F.round("dot_product", 6).alias("dot_product"))


@query(f"""SELECT a.vec_id AS id_a, b.vec_id AS id_b, {DOT} AS dot_product
           FROM (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) f
           JOIN embeddings a ON a.vec_id = f.vec_id JOIN embeddings b ON b.label = f.label AND b.vec_id > f.vec_id""")
def pairwise_dot(spark, sf):
    # pairs a < b between the first vector of a label and the others of that label
    found = vectors.dot_with_first(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return found.select("id_a", "id_b", F.round("dot_product", 6).alias("dot_product"))


@query("""SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS first_dimension FROM embeddings
          WHERE embedding[1]::DOUBLE > 0.15::DOUBLE""")
def filter_vector_dim(spark, sf):
    first = F.element_at("embedding", 1).cast("double")
    return table(spark, sf, "embeddings").filter(first > 0.15).select(
        "vec_id", "label", F.round(first, 6).alias("first_dimension"))


@query("""SELECT round(avg(embedding[1]::DOUBLE), 6) AS avg_dim1, round(avg(embedding[2]::DOUBLE), 6) AS avg_dim2,
                 count(*) AS total_vectors FROM embeddings""")
def vector_dim_stats(spark, sf):
    return table(spark, sf, "embeddings").agg(
        F.round(F.avg(F.element_at("embedding", 1).cast("double")), 6).alias("avg_dim1"),
        F.round(F.avg(F.element_at("embedding", 2).cast("double")), 6).alias("avg_dim2"),
        F.count("*").alias("total_vectors"))


@query("""SELECT CAST(d AS INTEGER) AS dimension, round(avg(x), 6) AS avg_value, round(min(x), 6) AS min_value,
                 round(max(x), 6) AS max_value, count(*) AS n
          FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings)
          GROUP BY d""")
def vector_dim_stats_all(spark, sf):
    stats = vectors.dimension_stats(table(spark, sf, "embeddings"), "embedding")
    return stats.select("dimension", *[F.round(c, 6).alias(c) for c in ("avg_value", "min_value", "max_value")], "n")


LONG = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings"
CENTRES = f"""WITH long AS ({LONG}),
              centre AS (SELECT label, d, avg(x) AS c FROM long GROUP BY label, d),
              size AS (SELECT label, sqrt(sum(c * c)) AS s FROM centre GROUP BY label),
              len AS (SELECT vec_id, sqrt(sum(x * x)) AS s FROM long GROUP BY vec_id)"""


@query(f"""{CENTRES},
           scored AS (SELECT q.label AS query_id, l.vec_id, round(sum(q.c * l.x) / any_value(z.s * n.s), 6) AS score
                      FROM centre q JOIN long l USING (d) JOIN size z ON z.label = q.label JOIN len n USING (vec_id)
                      GROUP BY q.label, l.vec_id),
           ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
           SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def semantic_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    centres = vectors.centroids(rows, "label", "embedding").withColumnRenamed("label", "query_id")
    found = vectors.topk(centres, rows, "vec_id", "embedding", 5, query_vec="centroid")
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"""{CENTRES},
           scored AS (SELECT l.label, l.vec_id, round(sum(q.c * l.x) / any_value(z.s * n.s), 6) AS score
                      FROM centre q JOIN long l USING (d, label) JOIN size z ON z.label = q.label JOIN len n USING (vec_id)
                      GROUP BY l.label, l.vec_id),
           ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM scored)
           SELECT label, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def semantic_topk_filtered(spark, sf):
    rows = table(spark, sf, "embeddings")
    centres = vectors.centroids(rows, "label", "embedding")
    found = vectors.topk_within(centres, rows, "label", "vec_id", "embedding", 5, "centroid")
    return found.withColumn("rank", F.col("rank").cast("long"))


def label_centres(rows):
    return vectors.centroids(rows, "label", "embedding").select(
        F.col("label").alias("query_id"), F.col("centroid").alias("embedding"))


@query()
def ann_topk(spark, sf):
    rows, path = table(spark, sf, "embeddings"), run_dir(spark, "index")
    cells = vectors.build_index(rows, "vec_id", "embedding", path)
    return vectors.ann_topk(label_centres(rows), path, "vec_id", "embedding", 5, probes=max(2, -(-3 * cells // 4)))


@query(f"""WITH long AS ({LONG}), centre AS (SELECT label, d, avg(x) AS c FROM long GROUP BY label, d),
           scored AS (SELECT q.label AS query_id, l.vec_id, round(sqrt(sum((q.c - l.x) * (q.c - l.x))), 6) AS score
                      FROM centre q JOIN long l USING (d) GROUP BY q.label, l.vec_id),
           ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored)
           SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def ann_topk_all_cells(spark, sf):
    # with every cell probed the answer is exact
    rows, path = table(spark, sf, "embeddings"), run_dir(spark, "index")
    cells = vectors.build_index(rows, "vec_id", "embedding", path)
    found = vectors.ann_topk(label_centres(rows), path, "vec_id", "embedding", 5, probes=cells)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
           scored AS (SELECT query_id, vec_id, round(sqrt(list_sum(list_transform(list_zip(e::DOUBLE[], embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS score
                      FROM q CROSS JOIN embeddings),
           best AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored)
                    WHERE rank <= 10 GROUP BY query_id)
           SELECT count(*) AS queries, sum(n)::BIGINT AS wanted, true AS recall_reached FROM best""")
def ann_recall(spark, sf):
    # every row whose id is divisible by 100 asks all rows; probes were chosen on other queries
    rows, path = table(spark, sf, "embeddings"), run_dir(spark, "index")
    vectors.build_index(rows, "vec_id", "embedding", path)
    probes = vectors.choose_probes(rows, path, "vec_id", "embedding", 10)
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.ann_topk(asked, path, "vec_id", "embedding", 10, probes)
    exact = materialize(vectors.topk(asked, spread(rows), "vec_id", "embedding", 10, "l2"), "exact")
    hits = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"),
                    (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


CHUNK, OVERLAP = 500, 50


def documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query()
def split_text(spark, sf):
    return retrieval.split_text(documents(spark, sf), "doc_id", "text", CHUNK, OVERLAP)


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM documents")
def split_text_rejoined(spark, sf):
    # without overlap the chunks of a document, put together again, are its text
    chunks = retrieval.split_text(documents(spark, sf), "doc_id", "text", CHUNK)
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    whole = chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("t"))
    return whole.select("doc_id", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


def _embedding_sql(name, key, source, dim=64):
    return f"""{name}_b AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS pos, count(*) AS c
                 FROM (SELECT {key}, unnest(string_split_regex(lower(text), '[ \\t\\r\\n]+')) AS t FROM {source})
                 WHERE t <> '' GROUP BY 1, 2),
               {name} AS (SELECT {key}, pos, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS w FROM {name}_b)"""


@query(f"""WITH {_embedding_sql('v', 'doc_id', 'documents')}
           SELECT doc_id, CAST(pos + 1 AS INTEGER) AS position, round(w, 6) AS weight FROM v""")
def embed_text(spark, sf):
    docs = retrieval.embed_text(documents(spark, sf), "doc_id", "text", 64)
    return docs.select("doc_id", F.posexplode("embedding")).filter("col > 0").select(
        "doc_id", (F.col("pos") + 1).alias("position"), F.round("col", 6).alias("weight"))


@query(f"""WITH {_embedding_sql('d', 'doc_id', 'documents')}, {_embedding_sql('q', 'item_id', 'benchmark')},
           scored AS (SELECT item_id, doc_id, round(sum(q.w * d.w), 6) AS score FROM q JOIN d USING (pos) GROUP BY 1, 2),
           ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
           SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 5""")
def retrieve_documents(spark, sf):
    asked = retrieval.embed_text(table(spark, sf, "benchmark"), "item_id", "text", 64)
    docs = retrieval.embed_text(documents(spark, sf), "doc_id", "text", 64)
    found = vectors.topk(asked, docs, "doc_id", "embedding", 5, "dot", query_id="item_id")
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH chosen AS (SELECT doc_id, text FROM documents WHERE lang = 'en' AND source = 'src1'),
           {_embedding_sql('d', 'doc_id', 'chosen')}, {_embedding_sql('q', 'item_id', 'benchmark')},
           scored AS (SELECT item_id, doc_id, round(sum(q.w * d.w), 6) AS score FROM q JOIN d USING (pos) GROUP BY 1, 2),
           ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
           SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 3""")
def retrieve_where(spark, sf):
    # the search is restricted by columns of the documents themselves
    asked = retrieval.embed_text(table(spark, sf, "benchmark"), "item_id", "text", 64)
    docs = retrieval.embed_text(table(spark, sf, "documents").filter("lang = 'en' AND source = 'src1'"), "doc_id", "text", 64)
    found = vectors.topk(asked, docs, "doc_id", "embedding", 3, "dot", query_id="item_id").filter("score > 0")
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_embedding_sql('d', 'doc_id', 'documents')}, {_embedding_sql('q', 'item_id', 'benchmark')},
           scored AS (SELECT item_id, doc_id, round(sum(q.w * d.w), 6) AS score FROM q JOIN d USING (pos) GROUP BY 1, 2),
           ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored),
           lengths AS (SELECT r.item_id, r.rank, d.text, sum(length(d.text)) OVER (PARTITION BY r.item_id ORDER BY r.rank) AS used
                       FROM ranked r JOIN documents d USING (doc_id) WHERE r.rank <= 4),
           kept AS (SELECT item_id, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
                    FROM lengths WHERE used <= 6000 GROUP BY item_id)
           SELECT item_id, CAST(coalesce(n, 0) AS INTEGER) AS n_chunks, coalesce(context, '') AS context
           FROM (SELECT DISTINCT item_id FROM ranked) LEFT JOIN kept USING (item_id)""")
def retrieve_whole_documents(spark, sf):
    # every document is one chunk, so that SQL can rank and cut them
    chunks = documents(spark, sf).select("doc_id", F.lit(0).alias("chunk_no"), "text")
    return retrieval.retrieve_context(table(spark, sf, "benchmark"), chunks, 4, 6000, "item_id", ["doc_id", "chunk_no"])


@query()
def retrieve_context(spark, sf):
    chunks = retrieval.split_text(documents(spark, sf), "doc_id", "text", CHUNK, OVERLAP)
    return retrieval.retrieve_context(table(spark, sf, "benchmark"), chunks, 4, 1500, "item_id", ["doc_id", "chunk_no"])


@query("""SELECT * FROM (
            SELECT conv_id, turn, role, text, CAST(count(*) OVER w AS INTEGER) AS n_earlier,
                   coalesce(string_agg(text, chr(10)) OVER w, '') AS history
            FROM conversations
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
          WHERE role = 'user'""".replace("SELECT * FROM", "SELECT conv_id, turn, text, n_earlier, history FROM", 1))
def conversation_history(spark, sf):
    return retrieval.history(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", 4)


@query("""SELECT CASE WHEN (doc_id % 100) * 31 % 100 < 80 THEN 'train' WHEN (doc_id % 100) * 31 % 100 < 90 THEN 'valid'
                      ELSE 'test' END AS split, quality, count(*) AS n
          FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def training_split(spark, sf):
    labelled = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id")
    parts = features.training_split(labelled, "doc_id", {"train": 80, "valid": 10, "test": 10})
    return parts.groupBy("split", "quality").agg(F.count("*").alias("n"))


@query("""SELECT l.event_id, l.user_id, l.ts, f.event_id AS feature_event_id, f.value AS feature_value
          FROM (SELECT * FROM events WHERE event_type = 'purchase') l
          ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') f
            ON l.user_id = f.user_id AND l.ts >= f.ts""")
def point_in_time_join(spark, sf):
    events = table(spark, sf, "events")
    labels = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts", "value")
    found = features.point_in_time_join(labels, clicks, "user_id", "ts", "ts", ["event_id", "value"], "event_id")
    return found.withColumnRenamed("value", "feature_value")


@query("""SELECT user_id, event_id, value FROM events
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_features(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    return features.latest_per_key(events, "user_id", "ts", "event_id").drop("ts")


@query("""SELECT event_id, user_id,
                 count(*) OVER (h RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS count_hour,
                 round(sum(value) OVER (h RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 2) AS sum_hour,
                 count(*) OVER (h RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS count_day,
                 round(sum(value) OVER (h RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW), 2) AS sum_day,
                 round((epoch_us(ts) - lag(epoch_us(ts)) OVER h) / 1e6, 6) AS seconds_since_previous
          FROM events WINDOW h AS (PARTITION BY user_id ORDER BY ts)""")
def rolling_features(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    rolled = features.rolling_features(events, "user_id", "ts", "value", {"hour": 3600, "day": 86400}, "event_id")
    return rolled.select("event_id", "user_id", "count_hour", F.round("sum_hour", 2).alias("sum_hour"), "count_day",
                         F.round("sum_day", 2).alias("sum_day"),
                         F.round("seconds_since_previous", 6).alias("seconds_since_previous"))


@query("""SELECT a.user_id, a.event_id, min(b.ts) AS next_ts, arg_min(b.event_id, b.ts) AS next_id
          FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
          WHERE a.event_type = 'view' AND b.event_type = 'purchase' GROUP BY 1, 2""")
def pattern_match(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    found = features.match_sequence(events, "user_id", "ts", "event_type", "view", "purchase", "6 HOURS", "event_id")
    return found.select("user_id", "event_id", "next_ts", "next_id")


@query("""SELECT event_id, user_id, round(m, 6) AS mean_before, round(s, 6) AS sd_before,
                 coalesce(n >= 2 AND abs(value - m) > 2.5 * s, false) AS is_anomaly
          FROM (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(value) OVER w AS n FROM events
                WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""")
def anomaly_zscore(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    flagged = features.flag_anomalies(events, "user_id", "ts", "value", 20, 2.5, "event_id")
    return flagged.select("event_id", "user_id", F.round("mean_before", 6).alias("mean_before"),
                          F.round("sd_before", 6).alias("sd_before"), "is_anomaly")
