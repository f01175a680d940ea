"""Quality classifier: naive Bayes features under a linear support vector machine.

A text becomes a set of hashed n-gram indicators: words and pairs of words, and one to three shapes of
words (case, digits, marks and repeats instead of letters). Each indicator is scaled by the logarithm of the
ratio of its smoothed class counts, and a linear hinge-loss model is fitted to the scaled indicators by dual
coordinate descent. Margins of two halves, each scored by a model of the other, give the curve that turns a
margin into a score between 0 and 1.

The fit sees at most `sample` labelled rows, those with the least hash of their doc_id, in one task; scoring
sees every text whole. A label is left out if it is null, not 0 or 1, or if two labels of a doc_id differ; of
several texts under a labelled doc_id the least is used. Without labels every score is 0.5, with labels of
one class it is the smoothed share of class 1. Null text counts as empty, and an empty text has a score; a
null doc_id is scored and not held out; repeated rows score alike; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import text_or_empty

DIMENSIONS = 1 << 18
SAMPLE = 4_000
FOLDS = 5
THRESHOLD = 0.3
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 10
# Distinct words remembered by a task.
CACHE = 200_000

_CLASSES = ((re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile("[A-Z]+"), "A"), (re.compile(r"\d+"), "0"))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


def _shape(word: str) -> str:
    """Runs of lower case, upper case and digits as one letter each; marks stay, repeated ones once."""
    if word.isalpha():
        if word.islower():
            return "a"
        if word.isupper():
            return "A"
        if word.istitle():
            return "Aa"
    upper = "".join("A" if c.isupper() else c for c in word)
    for pattern, letter in _CLASSES:
        upper = pattern.sub(letter, upper)
    return re.sub(r"(.)\1+", r"\1", upper)


class _Words(dict):
    """word -> hash of its shape above the hash of the word itself, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        shape = zlib.crc32(_shape(word).encode("utf-8", "replace"))
        code = self[word] = shape << 32 | zlib.crc32(word.lower().encode("utf-8", "replace"))
        return code


_words = _Words()


def indicators(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a text; feature 0 is there in every text."""
    words = text.split()
    if not words:
        return np.array([0, 1], np.int32)
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    word, shape = codes & _LOW, codes >> np.uint64(32)
    same = np.concatenate(([False], word[1:] == word[:-1]))
    shape = np.where(same, shape * np.uint64(3) + np.uint64(1), shape)
    # Shapes are few, so their n-grams become distinct before they are hashed.
    grams = [word, np.unique(shape) + np.uint64(1 << 40)]
    if len(word) > 1:
        grams += [word[:-1] * _ODD[0] + word[1:], np.unique(shape[:-1] * _ODD[1] + shape[1:])]
    if len(word) > 2:
        grams.append(np.unique(shape[:-2] * _ODD[2] + shape[1:-1] * _ODD[1] + shape[2:]))
    mixed = np.concatenate(grams) * _ODD[0]
    ids = ((mixed >> np.uint64(40)) % np.uint64(DIMENSIONS - 2)).astype(np.int32)
    return np.concatenate((np.zeros(1, np.int32), np.unique(ids) + np.int32(2)))


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    counts = np.full((2, DIMENSIONS), SMOOTHING)
    for row, y in zip(rows, label):
        counts[y, row] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])
    ratio[0] = 1.0
    return ratio


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights of least hinge loss with a squared norm, by coordinate descent on the dual."""
    weights, alpha = np.zeros(DIMENSIONS), np.zeros(len(rows))
    norm = np.array([v @ v for v in values])
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        furthest = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                weights[rows[i]] += step * sign[i] * values[i]
                alpha[i] = new
                furthest = max(furthest, abs(step) / cost)
        if furthest < 1e-3:
            break
    return weights


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, text: str) -> float:
        ids = indicators(text)
        margin = float(self.weights[ids].sum()) / math.sqrt(len(ids))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * margin + self.offset))))


def _weights(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    ratio = log_count_ratios(rows, label)
    values = [ratio[r] / math.sqrt(len(r)) for r in rows]
    return descend(rows, values, np.where(label == 1, 1.0, -1.0)) * ratio


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of least log loss, by Newton steps."""
    slope = offset = 0.0
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 10.0 / max(1e-12, np.abs(step).max()))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def fit_rows(rows: list[np.ndarray], label: np.ndarray) -> Model:
    ones, n = int(label.sum()), len(label)
    if min(ones, n - ones) < 2:
        share = (ones + 1) / (n + 2)
        return Model(np.zeros(DIMENSIONS), 0.0, math.log(share / (1 - share)))
    # Alternating within each class, so that both halves hold both classes.
    half = np.empty(n, int)
    for y in (0, 1):
        half[label == y] = np.arange((label == y).sum()) % 2
    margin = np.empty(n)
    for side in (0, 1):
        seen, rest = np.nonzero(half != side)[0], np.nonzero(half == side)[0]
        weights = _weights([rows[i] for i in seen], label[seen])
        margin[rest] = [weights[rows[i]].sum() / math.sqrt(len(rows[i])) for i in rest]
    return Model(_weights(rows, label), *_curve(margin, label))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows that are not held out."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("other"))
        .where("label = other")
        .select(F.col("doc_id").alias("labelled_id"), "label")
        .orderBy(F.xxhash64("labelled_id"), "labelled_id")
        .limit(sample)
    )
    # At most `sample` rows, whatever the number of labels.
    rows = (
        docs.select("doc_id", text_or_empty().alias("text"))
        .join(F.broadcast(known), F.col("doc_id") == F.col("labelled_id"))
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "label": b.label, "ids": [indicators(t).tobytes() for t in b.text]})

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        seen = pd.concat(parts).sort_values("doc_id") if parts else pd.DataFrame({"label": [], "ids": []})
        model = fit_rows([np.frombuffer(x, np.int32) for x in seen.ids], seen.label.to_numpy(int))
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "slope": [model.slope], "offset": [model.offset]})

    found = rows.mapInPandas(features, "doc_id long, label int, ids binary").repartition(1)
    row = found.mapInPandas(train, "weights binary, slope double, offset double").first()
    if row is None:
        return fit_rows([], np.empty(0, int))
    return Model(np.frombuffer(row["weights"], np.float64), row["slope"], row["offset"])


def scorer(docs: DataFrame, model: Model):
    """A column function text -> score; the model has a fixed size and is sent out once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        known = sent.value
        return pd.Series([known.score(t) for t in text], dtype="float64")

    return score


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    of = scorer(docs, fit(docs, labels, sample))
    scored = docs.select("doc_id", held_out().alias("held_out"), of(text_or_empty()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with all their columns."""
    of = scorer(docs, fit(docs, labels, sample))
    return docs.where(of(text_or_empty()) >= THRESHOLD)
