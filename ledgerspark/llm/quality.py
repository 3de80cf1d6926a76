"""Quality classifier: a sparse rule ensemble over text statistics.

Trees grown on a bounded labelled sample give their paths as conjunctive rules; a lasso logistic
regression over the rules keeps few of them; the kept rules are compiled into one Spark column
expression over the statistics. The statistics are counted over whole texts, one pass each.

Defined results: a null or empty text has all statistics zero and gets a score like any other; rows
that repeat get the same score each; a row with a null doc_id is scored but never learned from; of
several labels of one document or text the larger counts; an input column of the score's name is replaced,
all others are carried along whatever their names; an empty table gives no rows; without labelled
rows of both kinds the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.bpe import small_batches
from ledgerspark.llm.labelled import training_texts
from ledgerspark.llm.shared import free_name, materialize, release

#: Partitions of the bounded sample while the trees are grown.
SAMPLE_PARTS = 2
#: Steps of the lasso, sweeps over its weights in a step, and the change at which it ends.
LASSO_STEPS, LASSO_SWEEPS, LASSO_END = 50, 200, 1e-7
STATISTICS = ["chars", "words", "word_length", "upper", "digit", "space", "line_feed", "stop", "comma", "bang", "bar", "other_sign", "non_ascii", "top_sign", "distinct_words", "repeats", "distinct_lines", "line_words"]

_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_SIGN = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_PLAIN = [46, 44, 33, 124, 63]


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of STATISTICS; shares are of its bytes or words."""
    if not text:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size, words, lines = float(count.sum()), text.split(), text.split("\n")
    n = max(1, len(words))
    letters = max(1.0, float(count[_UPPER].sum() + count[_LOWER].sum() + count[128:].sum()))
    other = count[_SIGN].sum() - count[_PLAIN].sum()
    return [
        np.log1p(size), np.log1p(len(words)), size / n, count[_UPPER].sum() / letters, count[_DIGIT].sum() / size, count[32] / size, count[10] / size,
        count[46] / size, count[44] / size, count[33] / size, count[124] / size, other / size, count[128:].sum() / size, count[_SIGN].max() / size,
        len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n, len(set(lines)) / len(lines), n / len(lines),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([[float(x) for x in statistics(t)] for t in texts])


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most?, threshold), ...


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def score(self, stats: Column) -> Column:
        """The compiled rules: a logistic of the weights of the rules that hold."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(holds(rule, stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule, stats: Column) -> Column:
    out = F.lit(True)
    for place, at_most, threshold in rule:
        out = out & ((stats[place] <= threshold) if at_most else (stats[place] > threshold))
    return out


def tree_rules(node, path: Rule = ()) -> list[Rule]:
    """Every path of a fitted tree, from its root to any node, as a rule."""
    out = [path] if path else []
    if node.getClass().getSimpleName() == "InternalNode":
        place, threshold = node.split().featureIndex(), float(node.split().threshold())
        out += tree_rules(node.leftChild(), (*path, (place, True, threshold)))
        out += tree_rules(node.rightChild(), (*path, (place, False, threshold)))
    return out


def marks_of(rules: list[Rule], stats: np.ndarray) -> np.ndarray:
    """Whether each rule holds, a row a text."""
    out = np.ones((len(stats), len(rules)), bool)
    for j, rule in enumerate(rules):
        for place, at_most, threshold in rule:
            out[:, j] &= (stats[:, place] <= threshold) == at_most
    return out


def lasso_logistic(marks: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the least mean logistic loss plus penalty times the absolute weights, each
    multiplied by its mark's standard deviation. Newton steps, each solved by coordinate descent."""
    spread = marks.std(axis=0)
    use = np.flatnonzero(spread > 0)
    x = np.column_stack([(marks[:, use] - marks[:, use].mean(axis=0)) / spread[use], np.ones(len(y))])
    cost = np.append(np.full(len(use), penalty), 0.0)
    w = np.append(np.zeros(len(use)), np.log(y.mean() / (1 - y.mean())))
    loss = lambda v: np.logaddexp(0, -(2 * y - 1) * (x @ v)).mean() + cost @ np.abs(v)
    now = loss(w)
    for _ in range(LASSO_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - y) / len(y)
        bend = (x * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ x / len(y)
        new, pull = w.copy(), slope.copy()  # pull: the slope of the quadratic at `new`
        for _ in range(LASSO_SWEEPS):
            most = 0.0
            for j in range(len(w)):
                at = bend[j, j] * new[j] - pull[j]
                change = np.sign(at) * max(0.0, abs(at) - cost[j]) / bend[j, j] - new[j]
                if change:
                    new[j] += change
                    pull += bend[:, j] * change
                    most = max(most, abs(change))
            if most < LASSO_END:
                break
        step = 1.0
        while step > 1e-6 and loss(w + step * (new - w)) > now:
            step /= 2
        after = loss(w + step * (new - w))
        if now - after < LASSO_END * now:
            break
        w, now = w + step * (new - w), after
    weights = np.zeros(marks.shape[1])
    weights[use] = w[:-1] / spread[use]
    return weights, float(w[-1] - weights @ marks.mean(axis=0))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", trees: int = 20, depth: int = 3, penalty: float = 0.002) -> RuleModel:
    """Trees, then the lasso over their paths. The lasso is one task over the bounded sample's marks."""
    small_batches(docs.sparkSession)
    sample = training_texts(docs, labels, label)
    stats = sample.select(statistics_of("text").alias("stats"), F.col("y").cast("double").alias("label"))
    # bagging depends on the place of rows in partitions: the same sample must give the same trees
    rows = materialize(stats.repartition(SAMPLE_PARTS, "stats").sortWithinPartitions("stats", "label"))
    total, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not total or ones in (0, total):
        release(rows)
        share = min(1 - 1e-6, max(1e-6, ones / total if total else 0.5))
        return RuleModel([], [], float(np.log(share / (1 - share))))
    data = rows.select(array_to_vector("stats").alias("features"), "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.5, seed=7).fit(data)
    rules = list(dict.fromkeys(r for t in forest.trees for r in tree_rules(t._call_java("rootNode"))))

    def lasso(frames):
        whole = pd.concat(list(frames), ignore_index=True)  # TRAINING_ROWS rows at most
        weights, bias = lasso_logistic(marks_of(rules, np.stack(whole["stats"].to_numpy())), whole["label"].to_numpy(), penalty)
        yield pd.DataFrame({"place": range(-1, len(rules)), "weight": [bias, *weights]})

    found = rows.coalesce(1).mapInPandas(lasso, "place int, weight double").where("weight <> 0").collect()  # a row a rule
    release(rows)
    weight = {r["place"]: r["weight"] for r in found}
    bias = weight.pop(-1, 0.0)
    return RuleModel([rules[i] for i in sorted(weight)], [weight[i] for i in sorted(weight)], bias)


def score_quality(docs: DataFrame, model: RuleModel, into: str = "quality_score") -> DataFrame:
    """All columns of docs and the score, between 0 and 1, in the column `into` (replaced if it is there)."""
    small_batches(docs.sparkSession)
    stats = free_name(docs, "stats")
    scored = docs.withColumn(stats, statistics_of("text"))
    keep = [c for c in docs.columns if c.lower() != into.lower()]
    return scored.select(*keep, model.score(F.col(stats)).alias(into))
