from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelake.functions import kernels
from tidelake.operators import retrieval

TEXT = st.text(alphabet="ab \n", max_size=300)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(5, 40), st.integers(0, 4))
def test_chunks_are_bounded_ordered_and_cover_the_text(text, size, overlap):
    chunks = kernels.chunk_text(text, size, overlap)
    assert all(0 < end - start <= size for start, end in chunks)
    covered = 0
    for start, end in chunks:
        assert start <= covered < end and covered - start <= overlap
        covered = end
    assert covered == len(text)


def test_the_coarsest_separator_wins():
    text = "one two\n\nthree four\nfive"
    assert [text[a:b] for a, b in kernels.split_pieces(text, 12)] == ["one two\n\n", "three four\n", "five"]
    assert kernels.split_pieces("abcdefg", 3) == [(0, 3), (3, 6), (6, 7)]


def test_split_text_numbers_chunks(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd"), (2, ""), (3, None)], "id int, body string")
    rows = retrieval.split_text(docs, "id", "body", 6).orderBy("id", "chunk_no").collect()
    assert [(r["id"], r["chunk_no"], r["start"], r["text"]) for r in rows] == [(1, 0, 0, "aa bb "), (1, 1, 6, "cc dd")]


def embed(text, dim):
    v = np.zeros(dim)
    for token in text.lower().split():
        v[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
    return v / np.linalg.norm(v) if v.any() else v


def test_embed_text_equals_brute_force(spark):
    texts = ["A b  a\n", "Straße Été x", "", "   ", "tab\tand more", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["embedding"] for r in retrieval.embed_text(frame, "id", "t", 16).collect()}
    assert got[5] is None
    for i, text in enumerate(texts[:5]):
        assert np.allclose(got[i], embed(text, 16))


def test_embed_text_with_a_model(spark):
    frame = spark.createDataFrame([(1, "abc"), (2, "z")], "id int, t string")

    def model(texts):
        return np.array([[len(t), 1.0] for t in texts])

    rows = retrieval.embed_text(frame, "id", "t", model=model).collect()
    assert {r["id"]: r["embedding"] for r in rows} == {1: [3.0, 1.0], 2: [1.0, 1.0]}


def test_retrieve_context_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    questions = spark.read.parquet(f"{small}/benchmark.parquet")
    chunks = retrieval.split_text(docs, "doc_id", "text", 400, 40)
    rows = chunks.collect()
    vectors = np.array([embed(r["text"], 64) for r in rows])
    got = {r["item_id"]: r for r in retrieval.retrieve_context(
        questions, chunks, 4, 900, "item_id", ["doc_id", "chunk_no"]).collect()}
    for question in questions.collect():
        scores = np.round(vectors @ embed(question["text"], 64), 6)
        best = sorted(range(len(rows)), key=lambda j: (-scores[j], rows[j]["doc_id"], rows[j]["chunk_no"]))[:4]
        texts, used = [], 0
        for j in best:
            used += len(rows[j]["text"])
            if used > 900:
                break
            texts.append(rows[j]["text"])
        assert got[question["item_id"]]["context"] == "\n\n".join(texts)
        assert got[question["item_id"]]["n_chunks"] == len(texts)


def test_history_keeps_the_last_turns(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(5)]
    frame = spark.createDataFrame(turns, "conv int, turn int, role string, text string")
    rows = retrieval.history(frame, "conv", "turn", "role", "text", 2).orderBy("turn").collect()
    assert [(r["turn"], r["history"]) for r in rows] == [(0, ""), (2, "m0\nm1"), (4, "m2\nm3")]


def test_a_batch_of_texts_is_hashed_in_slices(monkeypatch):
    texts = pa.array(["b a b", None, "", "c" * 50, "a  d", "e f g h i j"] * 20)
    whole, seen, split = kernels.hashed_texts(texts, 16), [], kernels.pc.split_pattern_regex
    monkeypatch.setattr(kernels, "TEXT_BYTES", 60, raising=False)
    monkeypatch.setattr(kernels.pc, "split_pattern_regex", lambda t, p: seen.append(t.nbytes) or split(t, p))
    assert kernels.hashed_texts(texts, 16).equals(whole) and len(whole) == 120
    assert len(seen) > 20 and len(kernels.hashed_texts(texts[:0], 16)) == 0


def test_chunks_leave_a_batch_slice_by_slice(spark, monkeypatch):
    texts = ["aa bb cc dd " * n for n in range(1, 40)]
    monkeypatch.setattr(kernels, "TEXT_BYTES", 400, raising=False)
    parts = [list(p) for p in kernels.chunk_slices(pa.array([None, "", *texts]), 30, 5)]
    assert len(parts) > 10 and all(sum(len(texts[at - 2]) for at in set(p[0])) <= 480 for p in parts)
    frame = spark.createDataFrame([(n, "k", t) for n, t in enumerate(texts)] + [(None, "k", "x")], "id int, other string, body string")
    got = [tuple(r) for r in retrieval.split_text(frame, "id", "body", 30, 5).collect()]
    want = [(n, i, a, t[a:b]) for n, t in [*enumerate(texts), (None, "x")] for i, (a, b) in enumerate(kernels.chunk_text(t, 30, 5))]
    assert sorted(got, key=str) == sorted(want, key=str)
