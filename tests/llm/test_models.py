"""The parts of the classifiers and the tokenizer that have an exact answer, and columns whose names clash."""

import random
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm import bpe, line_dedup, quality, queries, shared, toxicity

SF = "/root/testdata/sf0.001"


def brute_segments(scores):
    """Maximal segments by definition: the best stretch, the shortest of equals, then left and right of it."""

    def within(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if best is None or total > best[0] or (total == best[0] and j + 1 - i < best[2] - best[1]):
                    best = (total, i, j + 1)
        if best is None or best[0] <= 0:
            return []
        return [*within(a, best[1]), (best[1], best[2]), *within(best[2], b)]

    return within(0, len(scores))


def test_every_segment_is_that_of_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        scores = [rng.randint(-5, 5) + rng.random() * 1e-3 for _ in range(rng.randint(0, 25))]
        found = toxicity.maximal_segments(scores)
        assert [x[:2] for x in found] == brute_segments(scores)
        assert all(sum(scores[a:b]) == pytest.approx(s) for a, b, s in found)


@pytest.mark.parametrize("shape", ["rare hits", "falling", "nested"])
def test_segments_take_linear_time(shape):
    def seconds(n):
        scores = {"rare hits": [3.0] + [-0.5] * 9, "falling": [3.0, -5.0] * 5, "nested": []}[shape] * n
        if shape == "nested":
            scores = [x for i in range(5 * n) for x in (3 + i * 0.01, -1 - i * 0.02)]
        began = time.perf_counter()
        toxicity.maximal_segments(scores)
        return time.perf_counter() - began

    small, large = (min(seconds(n) for _ in range(3)) for n in (2_000, 16_000))
    assert large < 24 * small  # eight times the words; the square would be 64 times


def test_scale_makes_p_values_hold():
    """On texts of independent words the share of best segments with p <= x is about x at most."""
    rng, values, shares = np.random.default_rng(4), np.array([-0.5, 2.5]), np.array([0.97, 0.03])
    rate = toxicity._solve_rate(values, shares)
    best = lambda n: max((s for *_, s in toxicity.maximal_segments(rng.choice(values, n, p=shares).tolist())), default=0.0)
    words = rng.integers(50, 2000, 1500)
    seen = np.array([best(n) for n in words])
    scale = toxicity.fit_scale(words[:750].astype(float), seen[:750], rate, 2.5)
    p = -np.expm1(-scale * words[750:] * np.exp(-rate * seen[750:]))
    for x in (0.05, 0.2, 0.5):
        assert (p <= x).mean() <= x + 0.04


def test_lasso_is_optimal():
    """The subgradient conditions of the penalised mean logistic loss."""
    rng = np.random.default_rng(3)
    marks = rng.random((500, 30)) < rng.random(30)
    marks[:, 7] = True  # a rule that always holds
    y = (marks[:, 0].astype(int) * 3 - marks[:, 1] * 2 + rng.normal(size=500) > 0.5).astype(float)
    penalty = 0.01
    weights, bias = quality.lasso_logistic(marks, y, penalty)
    slope = (1 / (1 + np.exp(-(marks @ weights + bias))) - y) @ (marks - marks.mean(axis=0)) / len(y)
    spread = marks.std(axis=0)
    assert weights[7] == 0 and 0 < np.count_nonzero(weights) < 30
    for j in np.flatnonzero(spread > 0):
        if weights[j]:
            assert slope[j] == pytest.approx(-np.sign(weights[j]) * penalty * spread[j], abs=1e-5)
        else:
            assert abs(slope[j]) <= penalty * spread[j] + 1e-5


def test_compiled_rules_score_as_their_marks(spark):
    docs = queries.read(spark, SF, "documents")
    model = quality.fit_quality(docs, queries.read(spark, SF, "labels"), trees=4)
    rows = quality.score_quality(docs.select("doc_id", "text"), model).collect()
    stats = np.array([quality.statistics(r["text"]) for r in rows])
    want = 1 / (1 + np.exp(-(quality.marks_of(model.rules, stats) @ np.array(model.weights) + model.bias)))
    assert np.allclose([r["quality_score"] for r in rows], want)


def test_every_code_point_is_encoded_as_by_the_library():
    tokenizer = Tokenizer.from_file(str(queries.TOKENIZER))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    encoder = bpe.Encoder(bpe.BpeModel(queries.TOKENIZER), tuple, "tuples")
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    texts = points + ["a" + c + "B" for c in points[:0x3000]]
    for i in range(0, len(texts), 100_000):
        part = texts[i : i + 100_000]
        mine = [[t for chunk in parts for t in chunk] for parts in encoder.batch(part)]
        assert mine == [x.ids for x in tokenizer.encode_batch(part, add_special_tokens=False)]


def test_results_replace_columns_of_their_names(spark):
    """Input columns named like every result, and like names the operators may use within."""
    names = ["quality_score", "toxic_score", "toxic_passages", "n_lines", "n_dropped", "_stats", "_quality", "_toxic", "_text", "_lines", "_doc", "_row", "row", "_gone", "_h1", "_last"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in enumerate(["a b c", None, "x " * 50])], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 1), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    results = [
        (quality.score_quality(docs, quality.fit_quality(docs, labels)), {"quality_score"}),
        (toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)), {"toxic_score", "toxic_passages"}),
        (line_dedup.dedup_lines(docs), {"n_lines", "n_dropped"}),
    ]
    for out, made in results:
        assert sorted(out.columns) == sorted(docs.columns) and out.count() == 3
        for c in {*names} - made:
            assert out.where(F.col(c) == c).count() == 3
        for c in made:
            assert out.where(F.col(c).cast("string") == c).count() == 0
    assert shared.free_name(docs, "Text") == "__Text"


def test_hot_and_other_lines_are_dropped_alike(spark):
    rows = [(i, f"this line is in every document\nthis line is in a few of them {i // 4}\nown line number {i} of this text") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()))
    for hot_lines in (0, 3, 1000):
        assert sorted(map(tuple, line_dedup.dedup_lines(docs, hot_lines=hot_lines).collect())) == want


def test_samples_of_many_labels_and_of_labels_given_twice(spark, monkeypatch):
    from ledgerspark.llm import labelled

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    whole = labelled.training_texts(docs, labels, "toxic")
    assert whole.count() == labels.where(~labelled.held_out(F.col("doc_id"))).count()
    some = labelled.training_texts(docs, labels, "toxic", 200)
    assert 120 < some.count() < 300 and {r["y"] for r in some.collect()} == {0, 1}
    assert labelled.training_texts(docs, labels, "toxic", 2).count() < 15
    twice = labels.unionByName(labels.where("doc_id < 100").withColumn("toxic", F.lit(1))).unionByName(labels.where("doc_id < 50").withColumn("toxic", F.lit(None).cast("int")))
    known = {r["text"]: r["y"] for r in labelled.training_texts(docs, twice, "toxic").collect()}
    assert len(known) == whole.count() and all(y == 1 for t, y in known.items() if int(t.split()[1]) < 100)
