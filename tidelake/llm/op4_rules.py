"""Quality classifier: tree paths as rules, lasso logistic weights, compiled to columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidelake.llm import stats as S
from tidelake.session import materialize

FEATURES = list(S.FEATURES)


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: (feature, above this or None, at most this or None)."""

    bounds: tuple

    def column(self):
        tests = [F.col(f) > low for f, low, _ in self.bounds if low is not None]
        tests += [F.col(f) <= high for f, _, high in self.bounds if high is not None]
        held = tests[0]
        for test in tests[1:]:
            held = held & test
        return held


def tree_rules(node, bounds=None):
    """The conjunctions that lead to every node below a node of a fitted tree."""
    bounds = bounds or {}
    if bounds:
        yield Rule(tuple((f, *bounds[f]) for f in sorted(bounds)))
    if "Internal" in node.getClass().getSimpleName():
        feature, split = FEATURES[node.split().featureIndex()], float(node.split().threshold())
        low, high = bounds.get(feature, (None, None))
        yield from tree_rules(node.leftChild(), bounds | {feature: (low, split if high is None else min(high, split))})
        yield from tree_rules(node.rightChild(), bounds | {feature: (split if low is None else max(low, split), high)})


@dataclass
class RuleModel:
    intercept: float
    weighted: list  # (weight, rule)

    def column(self):
        """Probability of label 1 as one column expression over the statistics."""
        total = F.lit(self.intercept)
        for weight, rule in self.weighted:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(rows, trees=16, depth=3, penalty=0.0005, seed=4):
    """Fit on rows of FEATURES and ``label`` (0 or 1): rules from a forest, weights by lasso.

    Without rows the score is 0.5 everywhere; with one label only, its smoothed share.
    """
    tally = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    n, ones = tally["n"], tally["ones"] or 0
    if not 0 < ones < n:
        share = (ones + 1) / (n + 2)
        return RuleModel(float(log_odds(share)), [])
    # a shallow forest splits on few features at a time, so that its paths differ
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label", *FEATURES)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird",
                                    subsamplingRate=0.7).fit(assembled)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree._call_java("rootNode"))}, key=repr)
    if not rules:
        return RuleModel(float(log_odds((ones + 1) / (n + 2))), [])
    held = assembled.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(held)
    return RuleModel(float(lasso.intercept), [(float(w), r) for w, r in zip(lasso.coefficients, rules) if w != 0])


def log_odds(p):
    return math.log(p / (1 - p))


def score_quality(docs, labels, id_col="doc_id", text_col="text", label_col="quality", held_out="crc32(CAST(doc_id AS STRING)) % 5 = 0",
                  cut=0.3, **model):
    """Probability that a document is good, by a sparse ensemble of rules on its statistics.

    Learns from labelled rows that are not ``held_out``; only the FEATURES of the text are
    inputs. Returns doc_id, held_out, score and predicted (1 from ``cut`` on), one row per
    input row. Null and empty texts have statistics of 0 and are scored like others; rows
    without an id, without a label or with a null label are not learned from; a repeated id
    is learned from once per row, repeated labels count once with the highest. Other
    columns are not read.
    """
    stats = materialize(S.with_features(S.statistics(docs, id_col, text_col)).withColumn(
        "held_out", F.coalesce(F.expr(held_out), F.lit(False))), "quality")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    marks = marks.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = materialize(stats.where("NOT held_out").join(marks, "doc_id").select("label", *FEATURES), "quality_rows")
    score = fit_rules(rows, **model).column()
    return stats.select("doc_id", "held_out", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))
