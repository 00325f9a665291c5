"""Manifest, packing and filter orders against plain Python versions of their definitions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelake.llm import op11_merkle, op12_packing, op13_interactions, tokens
from tidelake.llm import queries as Q

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def ordered(rows):
    return sorted(rows, key=repr)


def joined(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(row):
    return joined(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fanout):
    """(root, siblings before and after each leaf, level by level)."""
    proofs, level = [[] for _ in leaves], [(x, [i]) for i, x in enumerate(leaves)]
    while len(level) > 1:
        above = []
        for low in range(0, len(level), fanout):
            run = level[low:low + fanout]
            for k, (_, members) in enumerate(run):
                for i in members:
                    proofs[i].append(("".join(x for x, _ in run[:k]), "".join(x for x, _ in run[k + 1:])))
            above.append((joined(*(x for x, _ in run)), [i for _, m in run for i in m]))
        level = above
    return level[0][0] if level else None, proofs


def manifests(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0], leaf(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([x for *_, x in sorted(groups[g], key=lambda r: (r[0], r[1] or 0, r[2]))], fanout) for g in names}
    root, upper = tree([subs[g][0] for g in names], fanout)
    out = []
    for g, rest in zip(names, upper):
        members = sorted(groups[g], key=lambda r: (r[0], r[1] or 0, r[2]))
        out += [(i, x, subs[g][0], root, own + rest) for (_, i, x), own in zip(members, subs[g][1])]
    return out


def many(odd_rows):
    langs = [None, "", "de", "en", "en", "en", "é", "z"]
    return [(i, None if k % 4 == 0 else f"s{k % 3}", langs[k % 7 if k < 60 else 3], None if k % 5 == 0 else k, t)
            for k, (i, t) in enumerate(odd_rows + odd_rows[:7] + [(1000, "alone")])] + [(5, "s", "z", 1, "only one")]


@pytest.mark.parametrize("fanout,block", [(2, 1), (2, 4), (2, 1024), (3, 9), (5, 30)])
def test_manifest_of_odd_rows(spark, odd_rows, fanout, block):
    rows = many(odd_rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumn("grp", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("leaf", F.lit(3)).repartition(3)
    have = op11_merkle.manifest(docs, fanout=fanout, block_rows=block)
    have = have.withColumn("folded", op11_merkle.fold(F.col("leaf"), F.col("proof")))
    found = have.collect()
    want = manifests(rows, fanout)
    assert ordered((r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof]) for r in found) == ordered(want)
    assert all(r.folded == r.root for r in found)


def test_manifest_of_one_row_and_of_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    row = (7, "s", None, 3, "abc")
    one = op11_merkle.manifest(spark.createDataFrame([row], schema)).collect()
    assert [(r.leaf, r.subroot, r.root, r.proof) for r in one] == [(leaf(row),) * 3 + ([],)]
    assert op11_merkle.manifest(spark.createDataFrame([], schema)).count() == 0


def test_manifest_shows_altered_rows(spark, small):
    rows = Q.QUERIES["op11_merkle_manifest"](spark, small).collect()
    altered = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
    assert altered and {r.doc_id for r in rows if not r.verified} == altered
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = [(i, x, sub, root, joined(*(a + b for a, b in proof))) for i, x, sub, root, proof in manifests(docs)]
    assert ordered((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in rows) == ordered(want)


def texts_of_all_kinds(n):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " ", " ", "　", "a", "B", "é", "ß", "中", "1", "Ⅷ", ".", ",", "'", "'s", "don't", "’", "—", "😀",
             "<|endoftext|>", "\r", "\x1c", "\x85", "​", "́", "عرب", "﻿", "\x00", " word", " longerword", "12345678901234567"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", None, "é" * 50, "x" * 3000]


def test_token_ids_are_those_of_the_tokenizer(spark, small):
    encoder = tokens.Encoder(VOCABULARY)
    texts = texts_of_all_kinds(3000) + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for known in (1 << 21, 500):  # the second forgets now and then
        tokens.KNOWN_PIECES, before = known, tokens.KNOWN_PIECES
        try:
            for low in range(0, len(texts), 700):
                part = texts[low:low + 700]
                ids, at = encoder.encode(pa.array(part))
                assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == encoder.plain([t or "" for t in part])
        finally:
            tokens.KNOWN_PIECES = before


def check_packing(rows, docs, window):
    """Every id of every document lies in one piece; sequences have no gap and need no padding."""
    encoder = tokens.Encoder(VOCABULARY)
    want = Counter()
    for doc_id, text in docs:
        want[doc_id, tuple(encoder.plain([text or ""])[0] + [1])] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for (doc_id, ids), copies in want.items():
        own = pieces[doc_id, len(ids)]
        held = [r for r in own if r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes())]
        assert sum(r.length for r in held) >= copies * len(ids)
        cover = Counter(i for r in held for i in range(r.start, r.start + r.length))
        assert set(cover) == set(range(len(ids))) and min(cover.values()) >= copies
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


@pytest.mark.parametrize("window", [2, 64, 2048])
def test_packing_of_odd_rows(odd, odd_rows, window):
    check_packing(op12_packing.pack(odd, VOCABULARY, window).collect(), odd_rows, window)


def test_packing_keeps_most_rests_whole(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = Q.QUERIES["op12_nnls_packing"](spark, small).collect()
    sequences = check_packing(rows, docs, 2048)
    assert sum(sum(r.length for r in own) < 2048 for own in sequences.values()) <= 11
    assert sum(r.doc_tokens % 2048 == r.length for r in rows) > 0.5 * len(docs)


def test_packing_of_nothing(none):
    assert op12_packing.pack(none, VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        op12_packing.pack(none, VOCABULARY, window=1000)


def test_least_squares_finds_a_mix_that_exists():
    rows = np.array([[6, 2, 0], [5, 3, 0], [4, 4, 0], [4, 2, 2]])
    histogram = np.zeros(8, dtype=np.int64)
    for row, times in zip(rows, (300, 20, 7, 50)):
        for n in row[row > 0]:
            histogram[n] += times
    x = op12_packing.least_squares(rows, histogram, rounds=2000)
    assert np.allclose(x, [300, 20, 7, 50], atol=0.1)
    counts = op12_packing.rounded(rows, x, histogram)
    used = np.bincount(rows.ravel(), weights=np.repeat(counts, 3), minlength=8)[1:]
    assert (used <= histogram[1:]).all() and used.sum() > 0.99 * histogram.sum()


@pytest.mark.parametrize("times", [1, 1000, 10 ** 9])
def test_plans_do_not_grow_with_counts(times):
    rng = np.random.default_rng(1)
    for histogram in (rng.integers(0, 5, 256), np.where(np.arange(256) > 140, 3, 0), np.where(np.arange(256) == 150, 9, 0)):
        histogram = histogram * times
        histogram[0] = 0
        plan = op12_packing.plan_rests(histogram, 256)
        table = plan.table()
        assert table.num_rows < 3 * 256 ** 2 / 6
        count = np.zeros(256, dtype=np.int64)
        np.add.at(count, table.column("cls").to_numpy(), table.column("high").to_numpy() - table.column("low").to_numpy())
        assert (count == histogram).all()


def audit(rows, marks):
    """The contract's rows by walking through every document and order."""
    good = {i for i, q, _ in marks if i is not None and q == 1}
    toxic = {i for i, _, t in marks if i is not None and t == 1}
    docs = []
    for i, text, part in rows:
        text = text or ""
        words = brute.words(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)}
        docs.append((part or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        shapley = Counter()
        found = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), sum(f in d[0] for d in own) - len(gone),
                              sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return out


def test_filter_orders_of_odd_rows(spark, odd, odd_rows, marks):
    rows = [(i, t, None if k % 4 == 0 else f"s{k % 3}") for k, (i, t) in enumerate(odd_rows)]
    rows += [(i and i + 1, t, "copies") for i, t, _ in rows[:40]] + [(77, "#A", "")]
    labels = [tuple(r) for r in marks.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit("x")).withColumn("n", F.lit(1.5))
    have = op13_interactions.interactions(op13_interactions.failures(docs, marks)).collect()
    assert ordered(tuple(r) for r in have) == ordered(audit(rows, labels))


def test_filter_orders_of_nothing_and_of_other_filters(spark, none, marks):
    assert op13_interactions.interactions(op13_interactions.failures(none, marks)).count() == 0
    masks = spark.createDataFrame([("p", 3, 2, 1, 0), ("p", 1, 5, 0, 0), ("p", 3, 1, 0, 1), (None, 0, 4, 4, 4)],
                                  "part string, mask int, n long, good long, toxic long")
    have = {(r.part, r.filter_order, r.step): r for r in op13_interactions.interactions(masks, "XY").collect()}
    assert len(have) == 8
    first = have["p", "YX", 1]
    assert (first.kept, first.removed, first.redundant, first.unique_fails, first.good_lost, first.toxic_lost, first.shapley) == (5, 3, 0, 0, 1, 1, 3)
    assert have["p", "XY", 2].redundant == 3 and have["p", "XY", 1].shapley == 8 + 5 and have[None, "XY", 2].kept == 4
    with pytest.raises(ValueError):
        op13_interactions.Orders("ABCDEFGH")
