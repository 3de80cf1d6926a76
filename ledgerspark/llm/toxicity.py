"""Toxicity by maximal scoring segments.

Words get log-odds between toxic and other labelled documents, with a Dirichlet prior from their
joint frequency, for or against; words that are not significant count as neutral, and every word pays
a drift, so that a random stretch loses. A linear scan finds all maximal scoring segments of a text.
The best segments of clean documents follow an extreme-value law: its rate comes from the scores of
their words, its scale from their best segments. Each segment gets its p-value in a text of that
length, the significant ones are added up, and a logistic curve fitted on the labelled sample turns
the sum into a score.

Defined results: a null or empty text has no segments and gets the score of such texts; ties between
segments keep the text's order; rows that repeat get the same result each; a row with a null doc_id is
scored but never learned from; of several labels of one document or text the larger counts; input
columns of the results' names are replaced, all others are carried along whatever their names; an
empty table gives no rows; without labelled rows of both kinds no word scores.
"""

from __future__ import annotations

import warnings
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.bpe import CACHE_WORDS, forget_words, small_batches
from ledgerspark.llm.labelled import training_texts
from ledgerspark.llm.shared import free_name, materialize, release

#: The words kept are at most so many: the size of the broadcast model. The least significant of more
#: are left out, and their number is the model's `left_out`. Words of a bounded sample rarely are more.
MAX_WORDS = 50_000
#: The prior's weight against the data, least z-score, documents and log-odds of a scoring word.
PRIOR, LEAST_Z, LEAST_DOCS, LEAST_ODDS = 0.1, 3.0, 4, 2.0
#: A word against toxicity takes at most so much from a segment: one of them does not end a passage.
MOST_AGAINST = 1.0
DRIFT, SIGNIFICANT = 0.5, 0.05
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡"


#: Beginnings of words count as tokens too (with a star): unseen forms back off to the longest one.
STEMS = (5, 4)


def word_of(chunk: str) -> str:
    return chunk.strip(_EDGES).lower()


def tokens_of(word: str) -> list[str]:
    """The word and its beginnings, the most specific first."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order, in linear time.

    Candidates are kept with the running totals before and after them, and with a link to the nearest
    earlier candidate of a smaller total before it. A new candidate joins with the linked one as long
    as that has the smaller total after it; candidates between them go. One that links to nothing
    starts below all before it: those are final. Every visit of a link drops or ends a candidate.
    """
    final: list[tuple[int, int, float]] = []
    held: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, link
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, link = i, before, len(held) - 1
        while True:
            while link >= 0 and held[link][2] >= low:
                link = held[link][4]
            if link < 0 or held[link][3] >= total:
                break
            start, _, low, _, onward = held[link]
            del held[link:]
            link = onward
        if link < 0:
            final += [(a, b, y - x) for a, b, x, y, _ in held]
            held.clear()
        held.append((start, i + 1, low, total, link))
    return final + [(a, b, y - x) for a, b, x, y, _ in held]


@dataclass
class ToxicModel:
    words: dict[str, float]
    rate: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # its K
    slope: float = 0.0
    bias: float = -3.0
    left_out: int = 0

    def weight(self, chunk: str) -> float:
        return next((self.words[t] for t in tokens_of(word_of(chunk)) if t in self.words), 0.0)

    def segments(self, text: str | None, known: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words of the whole text and its maximal segments."""
        chunks = text.split() if text else []
        for c in set(chunks).difference(known):
            known[c] = self.weight(c)
        values = [known[c] for c in chunks]
        if max(values, default=0.0) <= DRIFT:
            return len(chunks), []
        return len(chunks), maximal_segments([v - DRIFT for v in values])

    def passages(self, text: str | None, known: dict[str, float]) -> list[tuple[int, int, float, float]]:
        """Significant (start, end, score, p) in words of the whole text."""
        words, found = self.segments(text, known)
        out = []
        for a, b, s in found:
            p = -np.expm1(-self.scale * words * np.exp(-self.rate * s))
            if p <= SIGNIFICANT:
                out.append((a, b, float(s), float(max(p, 1e-300))))
        return out

    def evidence(self, text: str | None, known: dict[str, float]) -> float:
        return float(np.log1p(sum(-np.log(p) for *_, p in self.passages(text, known))))


def _frequencies(sample: DataFrame) -> DataFrame:
    """(word, toxic, other): documents of the sample with the word; counted in tasks before the shuffle."""

    def run(frames):
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for f in frames:
            for text, y in zip(f["text"], f["y"], strict=True):
                counts[y].update({t for c in set(text.split()) for t in tokens_of(word_of(c))})
        both = list({*counts[0], *counts[1]})
        for i in range(0, len(both), 100_000):
            part = both[i : i + 100_000]
            yield pd.DataFrame({"word": part, "toxic": [counts[1][w] for w in part], "other": [counts[0][w] for w in part]})

    return sample.mapInPandas(run, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _log_odds(counts: DataFrame) -> tuple[dict[str, float], int]:
    """The scoring words, and how many did not fit."""
    totals = counts.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).first()
    if not totals["t"] or not totals["o"]:
        return {}, 0
    t, o, prior = float(totals["t"]), float(totals["o"]), PRIOR * (F.col("toxic") + F.col("other"))
    mass = PRIOR * (t + o)
    odds = lambda y, n: F.log((y + prior) / (n + mass - y - prior))
    scored = counts.withColumn("delta", odds(F.col("toxic"), t) - odds(F.col("other"), o))
    scored = scored.withColumn("z", F.col("delta") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior)))
    toward = (F.col("toxic") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z) & (F.col("delta") >= LEAST_ODDS)
    against = (F.col("other") >= LEAST_DOCS) & (F.col("z") <= -LEAST_Z)
    kept = scored.where(toward | against)
    fit = kept.orderBy(F.desc(F.abs("z")), "word").limit(MAX_WORDS).select("word", "delta").collect()
    left_out = kept.count() - MAX_WORDS if len(fit) == MAX_WORDS else 0
    return {r["word"]: max(r["delta"], -MOST_AGAINST) for r in fit}, left_out


def _solve_rate(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 (there is one: the drift is negative)."""
    low, high = 1e-6, 1e-6
    excess = lambda r: float((shares * np.exp(r * values)).sum()) - 1
    while excess(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def fit_scale(words: np.ndarray, best: np.ndarray, rate: float, least: float) -> float:
    """K of the extreme-value law by maximum likelihood, from the best segments of clean texts.

    words * exp(-rate * best) is exponential with rate K; of a text without segments only a bound is
    known, that of the least possible score.
    """
    seen = best > 0
    exposure = (words * np.exp(-rate * np.where(seen, best, least))).sum()
    return float((seen.sum() + 1) / (exposure + 1))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and bias of a ridge logistic curve, by Newton steps."""
    a, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        g = a.T @ (y - p) - 0.01 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return max(0.0, float(w[0])), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicModel:
    small_batches(docs.sparkSession)
    sample = materialize(training_texts(docs, labels, label))
    counts = materialize(_frequencies(sample))
    words, left_out = _log_odds(counts)
    model = ToxicModel(words, left_out=left_out)
    if left_out:
        warnings.warn(f"{left_out} words of the labelled sample have no weight: the model keeps {MAX_WORDS}", stacklevel=2)
    release(counts)
    if max(words.values(), default=0.0) <= DRIFT:
        release(sample)
        return model

    def clean_scores(frames):  # how often each word score occurs in clean documents
        counts: Counter = Counter()
        for f in frames:
            for text in f["text"]:
                counts.update(round(model.weight(c), 1) for c in text.split())
        yield pd.DataFrame({"value": list(counts.keys()), "n": list(counts.values())})

    clean = sample.where("y = 0").mapInPandas(clean_scores, "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    size = float(clean["n"].sum())
    values = np.append(clean["value"].to_numpy(), max(words.values())) - DRIFT
    model.rate = _solve_rate(values, np.append(clean["n"].to_numpy(), 1.0) / (size + 1))
    least = min(w for w in words.values() if w > DRIFT) - DRIFT

    @F.pandas_udf("struct<words: long, best: double>")
    def maxima(texts: pd.Series) -> pd.DataFrame:
        known: dict[str, float] = {}
        found = [model.segments(t, known) for t in texts]
        return pd.DataFrame({"words": [n for n, _ in found], "best": [max((s for *_, s in x), default=0.0) for _, x in found]})

    best = sample.where("y = 0").select(maxima("text").alias("m")).select("m.*").toArrow().to_pandas()  # TRAINING_ROWS rows at most
    model.scale = fit_scale(best["words"].to_numpy(dtype=float), best["best"].to_numpy(), model.rate, least)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        known: dict[str, float] = {}
        return pd.Series([model.evidence(t, known) for t in texts])

    seen = sample.select(evidence("text").alias("x"), "y").toArrow().to_pandas()  # TRAINING_ROWS rows at most
    release(sample)
    model.slope, model.bias = _logistic(seen["x"].to_numpy(), seen["y"].to_numpy(dtype=float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, score: str = "toxic_score", passages: str = "toxic_passages") -> DataFrame:
    """All columns of docs, the score (0 to 1) and the significant segments, in columns of these names.

    Input columns of the two names are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_WORDS words at most

    @F.pandas_udf("struct<toxic_score: double, toxic_passages: array<struct<start: int, end: int, score: double, p: double>>>")
    def scored(series: pd.Series) -> pd.DataFrame:
        forget_words()
        m, known = shared.value, _known
        if len(known) > CACHE_WORDS:
            known.clear()
        found = [m.passages(t, known) for t in series]
        x = np.array([np.log1p(sum(-np.log(p) for *_, p in f)) for f in found])
        return pd.DataFrame({"toxic_score": 1 / (1 + np.exp(-(m.slope * x + m.bias))), "toxic_passages": [[dict(zip(("start", "end", "score", "p"), y, strict=True)) for y in f] for f in found]})

    _known: dict[str, float] = {}
    found = free_name(docs, "toxic")
    keep = [c for c in docs.columns if c.lower() not in (score.lower(), passages.lower())]
    return docs.withColumn(found, scored("text")).select(*keep, F.col(found)["toxic_score"].alias(score), F.col(found)["toxic_passages"].alias(passages))
