"""Passages, bytes, lines, shingle sets and benchmark windows against brute force."""

from __future__ import annotations

import brute
import pytest
from pyspark.sql import functions as F

from tidelake.llm import exchange as X
from tidelake.llm import kernels as K
from tidelake.llm import op2_substring, op3_suffixes, op7_jaccard, op8_lines, op9_decontaminate
from tidelake.llm import queries as Q
from tidelake.llm.components import components

SMALL = {"block_bytes": 2000}


def rows_of(frame, *names):
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=repr)


def by_bytes(rows):
    return brute.repeats(rows, lambda t: (t or "").encode(), bytes)


def test_passages_of_odd_rows(odd, odd_rows):
    want = [(i, n, gone, h) for i, n, gone, _, h in brute.repeats(odd_rows, brute.words, " ".join)]
    have = op2_substring.dedup_passages(odd, **SMALL)
    assert rows_of(have, "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(want)
    assert all(brute.sha(r.kept_text) == r.kept_sha256 for r in have.collect())
    assert sum(r[2] for r in want) > 500


@pytest.mark.parametrize("window", [32, 40])
def test_passages_with_other_windows(odd, odd_rows, window):
    want = [(i, gone) for i, _, gone, _, _ in brute.repeats(odd_rows, brute.words, " ".join, window)]
    have = op2_substring.dedup_passages(odd, window=window, **SMALL)
    assert rows_of(have, "doc_id", "n_removed") == ordered(want)


def test_cover_must_cover():
    with pytest.raises(ValueError):
        op2_substring.CoverAnchors(50, 31, (0, 1, 2))
    with pytest.raises(ValueError):
        op2_substring.CoverAnchors(30)


def test_bytes_of_odd_rows(odd, odd_rows):
    have = op3_suffixes.dedup_bytes(odd, **SMALL)
    assert rows_of(have, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == ordered(by_bytes(odd_rows))
    assert all(brute.sha(bytes(r.kept)) == r.kept_sha256 for r in have.collect())


def test_suffix_query_on_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    have = Q.QUERIES["op3_suffix_dedup"](spark, small)
    assert rows_of(have, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == ordered(by_bytes(rows))


def test_lines_of_odd_rows(odd, odd_rows):
    have = op8_lines.dedup_lines(odd, carry=["text", "block"], **SMALL)
    assert rows_of(have, "doc_id", "n_lines", "n_dropped", "kept_sha256") == ordered(brute.lines(odd_rows))
    for r in have.collect():
        assert op8_lines.kept_lines(r.carried.text, r.keep) == r.kept_text


def test_benchmark_windows_of_odd_rows(spark, odd, odd_rows):
    tests = [(1, odd_rows[8][1].upper()), (2, "One"), (3, None), (None, "two words"), (4, ""), (10, odd_rows[8][1][:90]), (2, "x")]
    bench = spark.createDataFrame(tests, "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    have = op9_decontaminate.decontaminate(odd, bench, carry=["block"])
    assert rows_of(have, *names) == ordered(brute.contamination(odd_rows, tests))
    assert have.where("contaminated AND length(clean_text) >= length(text)").isEmpty() if "text" in have.columns else True
    parts = op9_decontaminate.decontaminate(odd, bench, slice_bytes=300)
    assert rows_of(parts, *names) == ordered(brute.contamination(odd_rows, tests))
    clean = have.withColumnRenamed("clean_text", "text").select("doc_id", "text")
    again = op9_decontaminate.decontaminate(clean, spark.createDataFrame([(2, "one")], "item_id long, text string"))
    assert again.where("n_hit > 0").isEmpty()


@pytest.mark.parametrize("shingle,percent", [(3, 90), (5, 80), (2, 70)])
def test_jaccard_of_odd_rows(odd, odd_rows, shingle, percent):
    have = op7_jaccard.jaccard_components(odd, shingle, percent, **SMALL)
    assert rows_of(have, "doc_id", "n_shingles", "component_id") == ordered(brute.jaccard(odd_rows, shingle, percent))


@pytest.mark.parametrize("shingle,percent", [(3, 90), (5, 80)])
def test_jaccard_on_documents(spark, small, shingle, percent):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    have = op7_jaccard.jaccard_components(docs, shingle, percent)
    assert rows_of(have, "doc_id", "n_shingles", "component_id") == ordered(brute.jaccard(rows, shingle, percent))


def test_jaccard_of_a_chain_whose_ends_do_not_link(spark):
    # neighbours link, others do not; the smallest id is at one end
    words = [f"w{i}" for i in range(140)]
    rows = [(100 - k, " ".join(words[k * 3:k * 3 + 100])) for k in range(12)]
    want = brute.jaccard(rows, 3, 90)
    assert len({c for _, _, c in want}) == 1
    have = op7_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert rows_of(have, "doc_id", "n_shingles", "component_id") == ordered(want)


@pytest.mark.parametrize("boundary", [10, 20, 30])
def test_every_boundary_gives_the_same_links(spark, odd, odd_rows, boundary, monkeypatch):
    monkeypatch.setattr(op7_jaccard, "boundary", lambda *a, **k: boundary)
    have = op7_jaccard.jaccard_components(odd, 2, 80, **SMALL)
    assert rows_of(have, "doc_id", "component_id") == ordered((i, c) for i, _, c in brute.jaccard(odd_rows, 2, 80))


@pytest.mark.parametrize("shingle,percent,size", [(3, 90, 9), (5, 80, 4)])
def test_a_whole_small_set_inside_a_larger_one(spark, shingle, percent, size):
    # the smaller set can spare no member; the larger ones link through it only
    words = [f"w{i}" for i in range(size + shingle + 1)]
    rows = [(3, " ".join(words[:-1])), (2, " ".join(words[1:-1])), (1, " ".join(words[1:])), (4, " ".join(words[2:]))]
    want = brute.jaccard(rows, shingle, percent)
    assert sorted(n for _, n, _ in want) == [size, size, size + 1, size + 1] and {c for _, _, c in want} == {1}
    have = op7_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle, percent)
    assert rows_of(have, "doc_id", "n_shingles", "component_id") == ordered(want)


def test_linked_sets_share_a_part():
    import numpy as np

    rng = np.random.default_rng(3)
    rule = op7_jaccard.Rule(3, 90, 10)
    for size in (10, 17, 40, 111, 300):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            b = a.copy()
            for k in range(len(a)):  # as many changes as a link allows
                c = np.unique(np.append(np.delete(b, rng.integers(len(b))), rng.integers(0, 1 << 63, 1).astype(np.uint64)))
                if not rule.linked(len(np.intersect1d(a, c)), len(a), len(c)):
                    break
                b = c
            member, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            keys, text = op7_jaccard.part_keys(member, first, np.array([0, 1]), rule)
            assert set(keys[text == 0]) & set(keys[text == 1])


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 90), (7, 7)], "a long, b long")
    have = {r.node: r.component for r in components(links).collect()}
    assert have == {**{i: 0 for i in range(61)}, 100: 90, 90: 90}


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (op2_substring.dedup_passages(none), op3_suffixes.dedup_bytes(none), op7_jaccard.jaccard_components(none),
                op8_lines.dedup_lines(none), op9_decontaminate.decontaminate(none, bench)):
        assert out.count() == 0


def test_no_benchmark(spark, odd, odd_rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    have = op9_decontaminate.decontaminate(odd, bench)
    assert have.count() == len(odd_rows) and have.where("contaminated").isEmpty()


def test_packed_numbers_come_back():
    import numpy as np

    values = np.array([0, 1, 255, 256, 1 << 40, (1 << 64) - 1], dtype=np.uint64)
    assert (K.unpack(K.pack(values), len(values)) == values).all()
    assert (K.unpack_sorted(K.pack_sorted(values), len(values)) == values).all()
    assert K.pack(values[:0]) == b"" and len(K.unpack(b"", 0)) == 0
    ids = np.array([-3, 5, 1 << 62])
    assert (K.unpack(K.pack(ids), 3).view(np.int64) == ids).all()


def test_blocks_depend_on_ids_only(spark, odd):
    frame, _, count = X.blocks(odd, block_bytes=500)
    assert count > 3
    assert frame.where("doc_id IS NOT NULL").where(F.col("block") != X.block_of("doc_id", count)).isEmpty()


def test_bitmaps_never_differ_by_more_than_the_sets():
    import numpy as np

    rng = np.random.default_rng(9)
    for size, other in ((5, 9), (300, 280), (1000, 1100), (1024, 1025)):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.append(a[:len(a) // 2], rng.integers(0, 1 << 63, other - len(a) // 2).astype(np.uint64)))
        width, maps = op7_jaccard.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        ends = np.cumsum(width // 8)
        both = op7_jaccard.folded([maps[:ends[0]], maps[ends[0]:ends[1]]])
        apart = len(np.setxor1d(a, b))
        assert 0 < np.bitwise_count(both[0] ^ both[1]).sum() <= apart
        same = op7_jaccard.folded([maps[:ends[0]], maps[:ends[0]]])
        assert (same[0] == same[1]).all()


def test_a_group_whose_smallest_id_is_at_its_edge(spark):
    import random

    # the original has a large id; its copies link with it, hardly with each other
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(40):
        words = list(base)
        for k in rng.sample(range(200), 3):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    want = brute.jaccard(rows, 3, 90)
    assert len({c for _, _, c in want}) == 1
    have = op7_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert rows_of(have, "doc_id", "n_shingles", "component_id") == ordered(want)


def test_stars_cover_every_member_that_is_near_another():
    import numpy as np

    near = np.random.default_rng(2).random((30, 20)) < 0.1
    row, column = op7_jaccard.hubs(near)
    assert near[row, column].all() and len(row) <= 50 and len(row) >= max(near.any(axis=1).sum(), near.any(axis=0).sum()) // 2
    assert len(op7_jaccard.hubs(np.zeros((3, 3), dtype=bool))[0]) == 0


def test_test_windows_take_little_memory():
    import pickle
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randrange(3, 400)))) for i in range(900)]
    size = sum(len(text) for _, text in items)
    grams = op9_decontaminate.Grams(items, 10)
    arrays = [grams.data, grams.starts, grams.ends, grams.first, *(x for table in grams.tables.values() for x in table)]
    # a slice of 32 MB of text stays below 300 MB
    assert size > 900_000 and sum(a.nbytes for a in arrays) < 6 * size and len(pickle.dumps(grams)) < 7 * size
