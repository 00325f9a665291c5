"""Rules, forests, language model, mixture, licences: brute force, identities and held-out labels."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelake.llm import op1_licenses, op4_rules, op5_classes, op6_mixture, op10_forest
from tidelake.llm import queries as Q

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def auc(score, good):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


def labelled(spark, folder, result):
    return result.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()


def test_statistics_of_odd_rows(odd, odd_rows, marks):
    rows = op10_forest.quality_rules(odd, marks).collect()
    want = [(i, *brute.statistics(t)) for i, t in odd_rows]
    assert sorted(((r.doc_id, *(r[c] for c in COUNTS)) for r in rows), key=repr) == sorted(want, key=repr)
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_forest_finds_bad_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = labelled(spark, folder, Q.QUERIES["op10_isolation_forest"](spark, folder))
    good = found[found.quality == 1]
    assert (~found[found.quality == 0].kept).mean() > 0.95
    assert good[~good.base_failed].kept.mean() > 0.97


def test_labels_of_other_documents_do_not_displace_their_own(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    foreign = spark.range(10_000_000, 10_050_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    plain, beside = (op10_forest.quality_rules(docs, some, train_rows=300).where("NOT kept AND NOT base_failed").count()
                     for some in (labels, labels.union(foreign.select(*labels.columns))))
    assert plain == beside > 30
    # one label, thousands of rows of its id: one row is looked at
    one = docs.limit(1).select("doc_id", "text").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n")
    stats = op10_forest.with_features(op10_forest.S.statistics(one))
    assert op10_forest.labelled_rows(stats, one.select("doc_id", F.lit(1).alias("quality"))).count() == 1


def test_threshold_by_trying_every_limit():
    rng = np.random.default_rng(9)
    for _ in range(30):
        steps = np.sort(rng.choice(50, 12, replace=False))
        good, bad = rng.integers(0, 40, 12), rng.integers(0, 9, 12)
        limit = op10_forest.best_threshold(steps, good, bad, 0.1, 2.0)
        worth = {x: bad[steps > x].sum() / bad.sum() - 2.0 * good[steps > x].sum() / good.sum() for x in [*steps, 99.0]
                 if good[steps > x].sum() <= 0.1 * good.sum()}
        assert abs(bad[steps > limit].sum() / bad.sum() - 2.0 * good[steps > limit].sum() / good.sum() - max(worth.values())) < 1e-9


def test_filter_agrees_with_the_rules(spark, small, odd, marks):
    for docs, labels in ((spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")),
                         (odd, marks)):
        kept = op10_forest.quality_rules(docs, labels).where("kept").groupBy("doc_id").count()
        rows = op10_forest.keep_good(docs, labels)
        assert rows.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, rows.groupBy("doc_id").count().collect()), key=repr)


def test_forest_without_labels_keeps_what_passes(spark, odd, none, marks):
    rows = op10_forest.quality_rules(odd, marks.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in rows)
    assert op10_forest.quality_rules(none, marks).count() == 0
    assert op10_forest.keep_good(none, marks).count() == 0


def test_path_of_a_lone_row_is_short():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(size=(300, 2)), [[40, 40]]])
    trees = [op10_forest.grow_tree(rows[rng.choice(301, 128, replace=False)], rng) for _ in range(60)]
    paths = sum(t.lengths(rows) for t in trees)
    assert paths[-1] < np.sort(paths[:-1])[5]


def test_rule_ensemble_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = labelled(spark, folder, Q.QUERIES["op4_rule_ensemble"](spark, folder))
    for r in found.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = found[found.held_out]
    assert auc(out.score.to_numpy(), out.quality.to_numpy() > 0) > 0.97
    assert (out.predicted == out.quality).mean() > 0.95


def test_labels_of_held_out_rows_change_nothing(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.expr("crc32(CAST(doc_id AS STRING)) % 5 = 0"), 1 - F.col("quality")).otherwise(
        F.col("quality")))
    a, b = (sorted(map(tuple, op4_rules.score_quality(docs, x, trees=4).collect())) for x in (labels, turned))
    assert a == b


def test_rule_ensemble_of_odd_rows(odd, odd_rows, marks, none):
    rows = op4_rules.score_quality(odd, marks, trees=3).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    one = op4_rules.score_quality(odd, marks.where("quality = 1")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.9
    assert {r.score for r in op4_rules.score_quality(odd, marks.limit(0)).collect()} == {0.5}
    assert op4_rules.score_quality(none, marks, trees=2).count() == 0


def test_rules_are_conjunctions_of_bounds(spark):
    rule = op4_rules.Rule((("symbols", 0.5, None), ("upper", None, 0.2)))
    rows = spark.createDataFrame([(0.6, 0.1), (0.5, 0.1), (0.6, 0.3)], "symbols double, upper double")
    assert [r[0] for r in rows.select(rule.column()).collect()] == [True, False, False]


def unigrams(rows):
    count = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*brute.words(t, lower=True), None])
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        own = [*brute.words(t, lower=True), None]
        out.append((i, len(own), sum(count[w] > 0 for w in own), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)))
    return out


def test_unigram_scores(spark, small, odd, odd_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for frame, rows in ((docs, [tuple(r) for r in docs.select("doc_id", "text").collect()]), (odd, odd_rows)):
        have = op5_classes.score_texts(frame, rounds=1, parts=2, sweeps=1, block_bytes=5000).collect()
        key = lambda r: (repr(r[:4]), r[4])
        for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in have), key=key),
                        sorted(unigrams(rows), key=key)):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])


def test_class_bigrams_beat_unigrams_on_held_out_texts(spark):
    rows = Q.QUERIES["op5_class_bigrams"](spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum() + 0.2 * rows.n_tokens.sum()
    assert (rows.score > rows.base_score).mean() > 0.9


def class_bigrams(rows, kind, n_classes):
    """Scores of a class bigram model, word by word, with the class of each word given."""
    own = [[*brute.words(t, lower=True), None] for _, t in rows]
    train = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    count, size, kinds, pairs, after, before = Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
    for words, learns in zip(own, train):
        if learns:
            count.update(words)
            for a, b in zip([None, *words], words):
                pairs[kind[a], kind[b]] += 1
                before[kind[a]] += 1
                after[kind[b]] += 1
    for w, n in count.items():
        size[kind[w]] += n
        kinds[kind[w]] += 1
    total, out = sum(after.values()), []
    for words in own:
        score = 0.0
        for a, b in zip([None, *words], words):
            share = (after[kind[b]] + 1) / (total + n_classes)
            score += math.log10((pairs[kind[a], kind[b]] + share) / (before[kind[a]] + 1))
            mass = count[b] - 0.5 if count[b] else 0.5 * kinds[kind[b]] + 1
            score += math.log10(mass / (size[kind[b]] + 1))
        out.append(score)
    return out


def test_scores_are_those_of_a_class_bigram_model(spark, small, odd, odd_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for frame, rows in ((odd, odd_rows), (docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])):
        settings = dict(n_classes=8, rounds=2, least=3, head_share=0.01, parts=3, sweeps=2, block_bytes=20000)
        classes = {r.h: r for r in op5_classes.word_classes(frame, **settings).collect()}
        names = sorted({w for _, t in rows for w in brute.words(t, lower=True)})
        kind = {None: 0}
        for w in names:
            h = op5_classes.tokens(pa.array([w]))[0]
            kind[w] = classes[int(h.view(np.int64)[0])]["class"]
        assert len(classes) == len(names) and all(1 <= kind[w] < 8 for w in names)
        have = sorted(((repr(r.doc_id), r.score) for r in op5_classes.score_texts(frame, **settings).collect()))
        want = sorted((repr(i), s) for (i, _), s in zip(rows, class_bigrams(rows, kind, 8)))
        assert [a for a, _ in have] == [a for a, _ in want]
        assert np.allclose([b for _, b in have], [b for _, b in want])


def test_frequent_words_leave_the_class_of_their_shape(spark):
    rng = np.random.default_rng(3)
    # the words of both kinds have one shape and take turns: only their neighbours tell them apart
    kinds = [[f"a{k}{i}xyz" for i in range(15)] for k in (1, 2)]
    marks = ["on", "off"]
    rows = [(d, " ".join(w for _ in range(60) for k in (int(rng.integers(2)),) for w in (marks[k], rng.choice(kinds[k])))) for d in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {r.h: r["class"] for r in op5_classes.word_classes(frame, n_classes=6, rounds=3, head_share=0.1, parts=8).collect()}
    found = [{classes[int(op5_classes.tokens(pa.array([w]))[0].view(np.int64)[0])] for w in kind} for kind in kinds]
    assert not found[0] & found[1]


def test_a_move_is_the_best_of_all():
    rng = np.random.default_rng(2)
    f = lambda n: np.sum(n * np.log(np.maximum(n, 1)))
    first, code, count = [0], [], []
    for _ in range(30):
        for side in (0, 4):
            some = rng.choice(4, rng.integers(1, 4), replace=False)
            parts = rng.multinomial(40, np.ones(len(some)) / len(some))
            code += [side + int(c) for c in some]
            count += parts.tolist()
        first.append(len(code))
    first, code, count = np.array(first), np.array(code), np.array(count)
    classes = rng.integers(1, 4, 30)
    def matrix(own):
        out = np.zeros((8, 4))
        np.add.at(out, (code, np.repeat(own, np.diff(first))), count)
        return out
    def value(own):
        return f(matrix(own)) - 2 * f(matrix(own)[:4].sum(0))
    moved = op5_classes.best_classes(first, code, count, classes, matrix(classes), np.arange(30) % 2 == 0)
    assert (moved[1::2] == classes[1::2]).all() and (moved != classes).any()
    for i in range(0, 30, 2):
        tried = [value(np.where(np.arange(30) == i, k, classes)) for k in (1, 2, 3)]
        assert tried[moved[i] - 1] == pytest.approx(max(tried))


def test_class_probabilities_sum_to_one():
    size, kinds = np.array([3.0, 100.0, 0.0]), np.array([1.0, 40.0, 0.0])
    model = op5_classes.ClassModel(size, kinds, 103, 41)
    counts = np.array([61.0] + [1.0] * 39)
    known = (10 ** model.word_scores(counts, np.ones(40, dtype=int))).sum()
    unknown = 10 ** model.word_scores(np.array([0.0]), np.array([1]))[0]
    assert known + unknown == pytest.approx(1)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    # two kinds of units that follow each other in turn
    kind = np.arange(40) % 2
    text = np.array([rng.choice(np.flatnonzero(kind == k % 2)) for k in range(4000)] + [40])
    def tally(classes):
        out = np.zeros((41, 2, 4))
        np.add.at(out, (text[1:], 0, classes[text[:-1]]), 1)
        np.add.at(out, (text[:-1], 1, classes[text[1:]]), 1)
        return out
    classes = np.append(1 + rng.integers(0, 3, 40), 0)
    def likelihood(c):
        pairs = np.zeros((4, 4))
        np.add.at(pairs, (c[text[:-1]], c[text[1:]]), 1)
        f = lambda n: (n * np.log(np.maximum(n, 1))).sum()
        return f(pairs) - f(pairs.sum(0)) - f(pairs.sum(1))
    before = likelihood(classes)
    for _ in range(4):
        classes, _ = op5_classes.exchange(tally(classes), classes, 4, 40)
    assert likelihood(classes) > before and classes[40] == 0
    assert len(set(classes[:40][kind == 0]) & set(classes[:40][kind == 1])) == 0


def test_scores_of_odd_rows_and_empty_tables(odd, odd_rows, none):
    rows = op5_classes.score_texts(odd, rounds=1).collect()
    assert len(rows) == len(odd_rows) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert op5_classes.score_texts(none, rounds=1).count() == 0
    nothing = op5_classes.score_texts(odd, held_out="true", rounds=1).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in nothing)


def water(sizes):
    """Targets by giving the excess away again and again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: 1 + k % 3 for k, n in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        open_ = [n for n in names if n not in full]
        share = {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n: 3.0 * sizes[n] for n in open_ if share[n] > 3 * sizes[n]}
        if not over:
            return share | full
        full |= over


def check_mix(docs, rows, seed="mix"):
    result, pieces = op6_mixture.mix(docs, seed=seed)
    have = result.collect()
    sizes = defaultdict(int)
    for s, t in rows:
        sizes[s] += len(brute.words(t))
    want, taken = water(sizes), defaultdict(int)
    assert len(have) == len(rows)
    for r in have:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= max(0.02 * goal, 8)
    parts = pieces.collect()
    assert sum(p.high - p.low for p in parts) == sum(taken.values())
    slots = defaultdict(set)
    for p in parts:
        assert 0 <= p.low < p.high
        slots[p.slot].add(p.source)
    assert all(len(s) == 1 for s in slots.values())
    return sorted(map(tuple, have), key=repr)


def test_mix_meets_its_targets(spark, small, odd):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = check_mix(docs, [tuple(r) for r in docs.select("source", "text").collect()])
    assert first == sorted(map(tuple, op6_mixture.mix(docs.repartition(7))[0].collect()), key=repr)
    check_mix(odd, [tuple(r) for r in odd.select("source", "text").collect()])


def test_small_sources_are_full_and_their_excess_goes_on(spark):
    rows = [(k, "a", "w " * 10) for k in range(2)] + [(100 + k, "b", "w " * 50) for k in range(40)] + [
        (200, "c", "w"), (300, None, "w " * 30), (400, "", None), (None, "b", "w w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    check_mix(docs, [(s, t) for _, s, t in rows])


def test_sources_below_a_block_meet_their_targets(spark, monkeypatch):
    # a total above SLOTS blocks of the smallest target's size; null is the last source
    monkeypatch.setattr(op6_mixture, "SLOTS", 1 << 11)
    rows = [(k, "hot", "w " * 1000) for k in range(250)] + [(1000 + k, "z", "w " * 7) for k in range(3)] + [
        (2000, None, "w " * 20), (3000, "b", "w"), (4000, "c", "w " * 130), (5000, "d", "w " * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    check_mix(docs, [(s, t) for _, s, t in rows])
    result, pieces = op6_mixture.mix(docs)
    taken = {r.source: r.t for r in result.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    want = water({"hot": 250000, "z": 21, None: 20, "b": 1, "c": 130, "d": 90})
    assert taken == {s: max(1, round(goal)) for s, goal in want.items()}
    sizes = pieces.groupBy("slot").agg(F.sum(F.col("high") - F.col("low")).alias("n")).agg(F.max("n")).first()[0]
    assert sizes == op6_mixture.block_words(250262, min(want.values()))


def test_mix_of_nothing(none, odd):
    assert op6_mixture.mix(none)[0].count() == 0
    empty = op6_mixture.mix(odd.withColumn("text", F.lit(" ")))[0].collect()
    assert all(r.taken == 0 and r.target == 0 for r in empty)


def test_licences_against_whole_alignment(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    templates = {k: op1_licenses.TEMPLATES[k] for k in ("Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "MIT")}
    have = op1_licenses.scan_licenses(docs, templates).groupBy("doc_id", "license").agg(F.max("coverage").alias("c")).collect()
    found = {(r.doc_id, r.license): r.c for r in have}
    want = {}
    for r in docs.collect():
        for name, template in templates.items():
            if any(w in r.text.lower() for w in ("licens",)) and (share := brute.matched(r.text, template)) >= 0.8:
                want[r.doc_id, name] = share
    assert found.keys() == want.keys() and found
    assert all(found[k] == pytest.approx(want[k]) for k in found)


def test_licences_with_edits_and_repeats(spark):
    apache, mit = op1_licenses.TEMPLATES["Apache-2.0 header"], op1_licenses.TEMPLATES["MIT"]
    words = apache.split()
    edited = " ".join(words[:20] + ["inserted", "words"] + words[20:40] + words[41:])
    rows = [(1, "before " + edited + " after"), (2, " ".join([mit] * 3)), (3, "no notice at all"), (4, None), (None, mit),
            (5, "Released under the MIT"), (6, ""), (7, " ".join(words[:len(words) // 2]))]
    found = op1_licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in found} == {(1, "Apache-2.0"), (1, "Apache-2.0 header"), (2, "MIT"), (None, "MIT"),
                                                      (5, "MIT"), (7, "Apache-2.0")}
    spans = sorted((r.first_word, r.last_word) for r in found if r.doc_id == 2)
    assert spans == [(0, 4), (5, 9), (10, 14)]
    long = next(r for r in found if r.license == "Apache-2.0 header")
    assert long.matched == long.template_words - 1 and long.first_word == 1


def test_licences_of_odd_rows(spark, odd, none):
    found = op1_licenses.scan_licenses(odd).collect()
    assert {(r.doc_id, r.license) for r in found} == {(19, "Apache-2.0"), (19, "MIT")}
    assert op1_licenses.scan_licenses(none).count() == 0
    assert op1_licenses.scan_licenses(odd, templates={}).count() == 0
    with pytest.raises(ValueError):
        op1_licenses.scan_licenses(odd, templates={"x": "two words"})
