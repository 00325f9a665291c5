"""Preparing documents for retrieval: chunks, vectors, context, history."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelake.functions import kernels
from tidelake.operators import skew
from tidelake.operators.vectors import topk


def split_text(df: DataFrame, id_col: str, text_col: str, chunk_size: int, overlap: int = 0) -> DataFrame:
    """Chunks of at most ``chunk_size`` characters, cut at the coarsest separator that fits.

    Consecutive chunks share up to ``overlap`` characters of whole pieces. The
    chunks cover the text. Gives (id, chunk_no, start, text), start being 0-based.
    """
    if not 0 <= overlap < chunk_size:
        raise ValueError("overlap must be at least 0 and below chunk_size")
    schema = T.StructType([df.schema[id_col], T.StructField("chunk_no", T.IntegerType()),
                           T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())])

    target = to_arrow_schema(schema)

    def chunks(batches):
        for batch in batches:
            # chunks take several times the bytes of their text: a slice of the batch at a time
            for place, *columns in kernels.chunk_slices(batch.column(1), chunk_size, overlap):
                columns = [batch.column(0).take(pa.array(place)), *(pa.array(c, type=t) for c, t in zip(columns, target.types[1:]))]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.select(id_col, text_col).mapInArrow(chunks, schema)


def embed_text(df: DataFrame, id_cols, text_col: str, dim: int = 64, model=None) -> DataFrame:
    """A unit vector per text, as column ``embedding``; a NULL text has a NULL vector.

    The default counts the lower-cased, blank-separated tokens in ``dim`` hash
    buckets (first 8 hex digits of MD5, modulo ``dim``) and needs no shuffle. A
    ``model`` is a function from a pandas series of texts to a matrix.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    if model is not None:
        def encode(texts: pd.Series) -> pd.Series:
            return pd.Series(list(np.asarray(model(texts), dtype=np.float64)))

        encoder = F.pandas_udf(encode, "array<double>")
    else:
        def count(texts: pa.Array) -> pa.Array:
            return kernels.hashed_texts(texts, dim)

        encoder = F.arrow_udf(count, "array<double>")
    # not marked as deterministic: otherwise a filter on the vector is pushed below
    # and encodes every text a second time
    return df.select(*ids, encoder.asNondeterministic()(text_col).alias("embedding"))


def retrieve_context(questions: DataFrame, chunks: DataFrame, k: int, max_chars: int, question_id: str,
                     chunk_ids, text_col: str = "text", dim: int = 64, model=None) -> DataFrame:
    """Per question the texts of its ``k`` nearest chunks, best first.

    Chunks are joined by an empty line while their summed length stays within
    ``max_chars``. Gives (question, n_chunks, context).
    """
    ids = list(chunk_ids)
    asked = embed_text(questions, question_id, text_col, dim, model)
    vectors = embed_text(chunks, [*ids, text_col], text_col, dim, model)
    # the text of the kept chunks travels with them: chunks are neither split
    # twice nor joined back
    found = topk(asked, vectors, ids, "embedding", k, "cosine", query_id=question_id, carry=[text_col])
    ranked = found.groupBy(question_id).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col(text_col).alias("text")))).alias("_found"))
    used = F.transform("_found", lambda f, i: F.aggregate(
        F.slice("_found", F.lit(1), i + 1), F.lit(0), lambda n, g: n + F.length(g["text"])))
    kept = F.slice("_found", F.lit(1), F.size(F.filter(used, lambda n: n <= max_chars)))
    return ranked.select(question_id, kept.alias("_kept")).select(
        question_id, F.size("_kept").alias("n_chunks"),
        F.array_join(F.transform("_kept", lambda f: f["text"]), "\n\n").alias("context"))


def history(df: DataFrame, conv: str, turn: str, role: str, text: str, n: int, min_rows=None) -> DataFrame:
    """For every user turn the texts of up to ``n`` earlier turns, joined by line breaks."""
    seen = skew.over_previous(
        df.select(conv, turn, role, text), [conv], [turn], n,
        {"_texts": lambda w: F.collect_list(text).over(w)}, min_rows=min_rows)
    return seen.filter(F.col(role) == "user").select(
        conv, turn, text, F.size("_texts").alias("n_earlier"), F.array_join("_texts", "\n").alias("history"))
