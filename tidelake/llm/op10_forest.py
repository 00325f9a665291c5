"""Quality rules: hard limits on text statistics, then an isolation forest over them."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidelake.llm import stats as S
from tidelake.llm.op9_decontaminate import pieces
from tidelake.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# shares of text statistics, drawn towards 0 in short texts, where they vary by chance
# as (count, of, added to ``of``)
FEATURES = {
    "symbols": ("n_symbols", "n_words", 20), "upper": ("n_upper", "n_letters", 100), "bangs": ("n_bangs", "n_words", 20),
    "repeats": ("n_repeat_words", "n_words", 20), "dup_lines": ("n_dup_lines", "n_lines", 10),
    "marks": ("n_marks", "n_words", 20), "word_length": ("word_chars", "n_words", 1),
    "digits": ("n_digits", "n_chars", 100), "distinct": ("n_distinct", "n_words", 1),
}
# labelled rows the forest is grown on and its threshold set by: those with the smallest hashed ids
TRAIN_ROWS = 20_000
# scores are counted in steps of this part of 1
SCORE_STEPS = 50_000


def average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.maximum(np.asarray(n, dtype=float), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    feature: np.ndarray  # -1 in a leaf
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray  # depth of a leaf, with the mean depth its rows would still have had

    def lengths(self, rows):
        node = np.zeros(len(rows), dtype=np.int64)
        while True:
            feature = self.feature[node]
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                return self.path[node]
            at = node[inner]
            low = rows[inner, feature[inner]] < self.split[at]
            node[inner] = np.where(low, self.left[at], self.right[at])


def grow_tree(rows, rng):
    """Random splits between the smallest and the largest value of a random feature."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes, todo = [[-1, 0.0, 0, 0, 0.0]], [(0, np.arange(len(rows)), 0)]
    while todo:
        at, own, depth = todo.pop()
        low, high = (rows[own].min(axis=0), rows[own].max(axis=0)) if len(own) else (np.zeros(1), np.zeros(1))
        uneven = np.flatnonzero(high > low)
        if depth >= limit or not len(uneven):
            nodes[at][4] = depth + float(average_path(len(own)))
            continue
        feature = int(rng.choice(uneven))
        split = rng.uniform(low[feature], high[feature])
        if split <= low[feature]:
            split = high[feature]
        below = rows[own, feature] < split
        nodes[at][:4] = [feature, split, len(nodes), len(nodes) + 1]
        todo += [(len(nodes), own[below], depth + 1), (len(nodes) + 1, own[~below], depth + 1)]
        nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
    columns = list(zip(*nodes))
    return Tree(*(np.array(c, dtype=t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, float))))


@dataclass
class Forest:
    trees: list
    sample: int
    low: np.ndarray  # usual range of each feature
    high: np.ndarray
    threshold: float = np.inf

    def excess(self, rows):
        """How far values lie outside their usual range."""
        return np.maximum(rows - self.high, 0) - np.maximum(self.low - rows, 0)

    def scores(self, rows):
        """2 ** (- mean path / expected path): near 1 for rows that few splits set apart."""
        if not self.trees:
            return np.zeros(len(rows))
        rows = self.excess(rows)
        mean = sum(t.lengths(rows) for t in self.trees) / len(self.trees)
        return 2.0 ** (-mean / max(float(average_path(self.sample)), 1e-9))


def best_threshold(scores, good, bad, lost, price):
    """The limit with the most bad rows above it, less ``price`` times the good rows above it.

    ``good`` and ``bad`` count the rows of each of the ascending ``scores``. Both count as shares; never more
    than a share ``lost`` of the good rows.
    """
    if not good.sum() or not bad.sum():
        return np.inf
    limits = np.append((scores[1:] + scores[:-1]) / 2, np.inf)
    good_above, bad_above = (1 - np.cumsum(n) / n.sum() for n in (good, bad))
    worth = np.where(good_above <= lost, bad_above - price * good_above, -np.inf)
    return float(limits[np.flatnonzero(worth == worth.max())[-1]])


def labelled_rows(stats, labels, label_col="quality", id_col="doc_id"):
    """(doc_id, good, FEATURES) of every labelled document, one row per id; ``stats`` holds those that pass the base rule."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good"))
    marks = marks.where("doc_id IS NOT NULL AND good IS NOT NULL").groupBy("doc_id").agg((F.max("good") > 0).alias("good"))
    once = stats.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("f"))
    return once.join(marks, "doc_id").select("doc_id", "good", "f.*")


def fit_forest(rows, train_rows=TRAIN_ROWS, trees=100, sample=256, tail=0.001, lost=0.01, price=2.0, seed=10):
    """A forest on labelled rows, by how far they exceed the range of good ones.

    The usual range of a feature leaves out a share ``tail`` of the good rows at both ends. Ranges and the
    threshold come from all labelled rows; only the trees are grown on ``train_rows`` of them, chosen by hashed id.
    """
    rows = materialize(rows, "labelled")
    ends = rows.where("good").agg(*[F.percentile_approx(f, [tail, 1 - tail], 100_000).alias(f) for f in FEATURES]).first()
    none = np.zeros(len(FEATURES))
    if ends[0] is None:
        return Forest([], sample, none, none)
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).orderBy("doc_id").select(*FEATURES).toPandas().to_numpy(float)
    forest = Forest([], min(sample, len(chosen)), *(np.array([ends[f][i] for f in FEATURES], dtype=float) for i in (0, 1)))
    rng, far = np.random.default_rng(seed), forest.excess(chosen)
    forest.trees = [grow_tree(far[rng.choice(len(far), forest.sample, replace=False)], rng) for _ in range(trees)]

    def scored(batches):
        for batch in batches:
            values = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(np.rint(forest.scores(values) * SCORE_STEPS).astype(np.int64))],
                                             names=["good", "step"])

    # a row per step of the score at most
    counts = rows.select("good", *FEATURES).mapInArrow(scored, "good boolean, step long").groupBy("step").agg(
        F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad")).orderBy("step").toPandas()
    forest.threshold = best_threshold(counts["step"].to_numpy() / SCORE_STEPS, counts["good"].to_numpy(), counts["bad"].to_numpy(), lost, price)
    return forest


def base_rule(min_words, max_repeats):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeats * F.col("n_words"))


def with_features(stats):
    return stats.withColumns({name: F.col(part) / (F.col(of) + more) for name, (part, of, more) in FEATURES.items()})


def quality_rules(docs, labels, id_col="doc_id", text_col="text", label_col="quality", min_words=10, max_repeats=20,
                  train_rows=TRAIN_ROWS, **forest):
    """Statistics, base rule and isolation forest verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than ``min_words`` words, or more than ``max_repeats`` percent of
    them in repeated 5-word windows), anomaly (0 to 1) and kept: false if the base rule
    failed or the anomaly is above the threshold. The forest is grown on the FEATURES of ``train_rows``
    labelled rows that pass the base rule; its threshold sets all such bad rows apart
    from good ones and rejects at most 1 percent of the good ones. Without labels of both
    kinds it rejects nothing. Null and empty texts have no words, so the base rule fails. One
    row per input row, also without an id. Other columns are not read.
    """
    stats = materialize(S.statistics(docs, id_col, text_col), "rules")
    failed, stats = base_rule(min_words, max_repeats), with_features(stats)
    forest = fit_forest(labelled_rows(stats.where(~failed), labels, label_col, id_col), train_rows, **forest)
    shown = ["doc_id", *S.COUNTS[:5]]

    def judge(batches):
        for batch in batches:
            rows = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in shown), pa.array(forest.scores(rows))],
                                             names=[*shown, "anomaly"])

    judged = stats.select(*shown, *FEATURES).mapInArrow(judge, ", ".join(f"{c} long" for c in shown) + ", anomaly double")
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(forest.threshold)))


def keep_good(docs, labels, id_col="doc_id", text_col="text", label_col="quality", min_words=10, max_repeats=20,
              train_rows=TRAIN_ROWS, **forest):
    """The rows of ``docs``, with all their columns, that ``quality_rules`` keeps.

    One pass over the texts gives the statistics of labelled rows, which are joined with their labels without
    the texts; a second judges and filters the texts where they are, so no text is moved and rows need no id.
    """
    stats = with_features(S.statistics(docs, id_col, text_col))
    failed = base_rule(min_words, max_repeats)
    forest = fit_forest(labelled_rows(stats.where(~failed), labels, label_col, id_col), train_rows, **forest)

    def judge(batches):
        for batch in pieces(batches, text_col):
            n = dict(zip(S.COUNTS, S.counts(batch.column(text_col))))
            rows = np.column_stack([n[part] / (n[of] + more) for part, of, more in FEATURES.values()])
            bad = (n["n_words"] < min_words) | (100 * n["n_repeat_words"] > max_repeats * n["n_words"])
            yield batch.filter(pa.array(~bad & (forest.scores(rows) <= forest.threshold)))

    return docs.mapInArrow(judge, docs.schema)
