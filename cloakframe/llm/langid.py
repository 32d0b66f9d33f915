"""Language identification: averaged hashed subword embeddings, a linear softmax, stochastic gradient descent.

A text is the mean of the embeddings of its character 1- to 4-grams inside words, hashed into buckets. Embeddings and
softmax are learned together on a bounded sample of labelled rows; a temperature is fitted on a fifth of the sample
that is not trained on, and with it the threshold below which a prediction is rejected: at most a half, and at most
what a thousandth of the correctly predicted validation rows fall below.

Defined results: null, empty and letterless texts get `und`, score 0 and are rejected; so does every text if no row
has a label. Whole texts are read, in pieces, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashed import bounded_sample, code_points, gram_counts, letters

BUCKETS, DIMENSIONS, ORDERS = 4096, 16, range(1, 5)
#: Labelled rows that the model is fitted on, at most (but for repeated ids).
SAMPLE_ROWS = 2400
UNKNOWN = "und"


def word_counts(text: str | None) -> np.ndarray | None:
    """Bucket counts of a text, None if it has no letter."""
    if not text:
        return None
    codes = code_points(" " + text.lower() + " ")
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    return gram_counts(np.where(is_letter, codes, np.uint32(32)), ORDERS, BUCKETS, True)


def features(text: str | None) -> np.ndarray | None:
    counts = word_counts(text)
    return None if counts is None else (counts / max(counts.sum(), 1)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """table: what each bucket adds to each language's logit (embedding by softmax weights by temperature)."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = word_counts(text) if self.langs else None
        if counts is None:
            return UNKNOWN, 0.0, True
        p = _softmax((counts @ self.table / max(counts.sum(), 1) + self.bias)[None])[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, lang: np.ndarray, seed: int = 7, epochs: int = 30, batch: int = 32, rate: float = 2.0) -> Model:
    """x: a row of bucket frequencies for each text."""
    langs = tuple(sorted(set(lang)))
    if not langs:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0), 0.0)
    rng = np.random.default_rng(seed)
    y = np.searchsorted(langs, lang)
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    scale = 20.0  # frequencies are small
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            mean = scale * x[rows] @ embed
            wrong = _softmax(mean @ weights + bias)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            wrong /= len(rows)
            back = wrong @ weights.T
            weights -= step * mean.T @ wrong
            bias -= step * wrong.sum(0)
            embed -= step * scale * x[rows].T @ back
    logits = lambda rows: scale * x[rows] @ embed @ weights + bias
    check = held if len(held) >= 20 else order
    raw, truth = logits(check), y[check]
    heat = min(np.geomspace(0.25, 8, 41), key=lambda t: -np.log(_softmax(raw / t)[np.arange(len(check)), truth] + 1e-12).mean())
    p = _softmax(raw / heat)
    right = p.max(1)[p.argmax(1) == truth]
    threshold = float(min(0.5, np.quantile(right, 0.001))) if len(right) else 0.0
    return Model(langs, (scale * embed @ weights / heat).astype(np.float64), (bias / heat).astype(np.float64), threshold)


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows; features are made on the executors."""
    rows = bounded_sample(labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull()), "id", sample_rows)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(i, lang, f.tobytes()) for i, text, lang in zip(batch["id"], batch["text"], batch["lang"], strict=True) if (f := features(text)) is not None]
            yield pd.DataFrame(made, columns=["id", "lang", "x"])

    got = rows.select("id", "text", "lang").mapInPandas(vectors, rows.select("id", "lang").schema.add("x", "binary")).toPandas()
    got = got.sort_values(["id", "lang"], kind="stable")
    return fit(np.stack([np.frombuffer(x, np.float32) for x in got["x"]]) if len(got) else np.zeros((0, BUCKETS), np.float32), got["lang"].to_numpy(str))


def predict(text: Column, model: Model) -> Column:
    """struct<lang_pred, score, rejected> of a text column."""
    sent = SparkSession.active().sparkContext.broadcast(model)  # some 130 kB for four languages

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts in batches:
            yield pd.DataFrame([own.predict(text) for text in texts], columns=["lang_pred", "score", "rejected"])

    return predicted(text)
