"""Quality classification from positives and unlabelled text: non-negative unbiased risk, estimated class prior.

Trusted positives are the labelled rows of quality 1; unlabelled are rows of the whole corpus. A first linear model
tells the two apart; from the tail where positives lie densest the share of positives in unlabelled text is estimated.
The second model minimises prior * risk of positives as positives + max(0, risk of unlabelled as negatives - prior *
risk of positives as negatives), by mini-batches; where the inner risk turns negative its gradient is reversed.

Defined results: null and empty texts are scored by the features of an empty text; without any positive every score
is 0. Whole texts are read, in pieces, whatever their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashed import bounded_sample, code_points, gram_counts, letters

BUCKETS, ORDERS, SIGNALS = 1024, range(1, 4), 13
#: Rows of trusted positives and of unlabelled text that the model is fitted on, at most (but for repeated ids).
POSITIVE_ROWS, UNLABELLED_ROWS = 2000, 3000


def features(text: str | None) -> np.ndarray:
    """Root frequencies of hashed character n-grams, then signals of layout and vocabulary."""
    text = text or ""
    codes = code_points(text)
    n = max(len(codes), 1)
    counts = gram_counts(codes, ORDERS, BUCKETS, False)
    is_letter = letters()[codes]
    ascii_upper = ((codes >= 65) & (codes <= 90)).sum()
    words, lines = text.split(), text.split("\n")
    n_words = max(len(words), 1)
    repeated_words = 1 - len(set(words)) / n_words
    often = Counter(words).most_common(1)[0][1] / n_words if words else 0
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n_words
    bare = sum(not any(map(str.isalpha, word)) for word in words) / n_words
    marked = sum(not word[-1].isalnum() and word[-1] not in ".,;:?" for word in words) / n_words
    repeated_lines = sum(c for line, c in Counter(lines).items() if c > 1 and line) / max(len(lines), 1)
    signals = [is_letter.sum() / n, ascii_upper / n, ((codes >= 48) & (codes <= 57)).sum() / n, (codes == 32).sum() / n, ((codes > 32) & ~is_letter).sum() / n, np.log1p(len(words)) / 10, sum(map(len, words)) / n_words / 10, repeated_words, repeated_lines, often, doubled, bare, marked]
    return np.concatenate([np.sqrt(counts / max(counts.sum(), 1)), signals]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        return float(_sigmoid(features(text) @ self.weights + self.bias))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: int = 20) -> float:
    """Share of positives in unlabelled text: the least ratio of the two tails above a score, with slack for few rows."""
    edges = np.sort(positive)[::-1]
    p, u, best = np.sort(positive), np.sort(unlabelled), 1.0
    for edge in edges[least - 1 :: max(1, len(edges) // 200)]:
        tail_p, tail_u = (len(p) - np.searchsorted(p, edge)) / len(p), (len(u) - np.searchsorted(u, edge)) / len(u)
        slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
        best = min(best, (tail_u + slack * 0.05) / tail_p)
    return float(np.clip(best, 0.05, 0.98))


def _descend(xp: np.ndarray, xu: np.ndarray, prior: float | None, rng: np.random.Generator, epochs: int = 60, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """prior None: plain logistic regression of positives against unlabelled."""
    w, b = np.zeros(xp.shape[1], np.float64), 0.0
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    for epoch in range(epochs):
        up, uu = rng.permutation(len(xp)), rng.permutation(len(xu))
        parts = max(1, max(len(xp), len(xu)) // 256)
        for ip, iu in zip(np.array_split(up, parts), np.array_split(uu, parts), strict=True):
            if not len(ip) or not len(iu):
                continue
            p, u = xp[ip], xu[iu]
            sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
            gp, gu = (sp - 1) / len(ip), su / len(iu)  # slopes of the losses as positive and as negative
            if prior is None:
                grad = np.append(p.T @ gp + u.T @ gu, gp.sum() + gu.sum()) / 2
            else:
                gn = sp / len(ip)
                inner = -np.log(1 - su + 1e-12).mean() - prior * -np.log(1 - sp + 1e-12).mean()
                rest = np.append(u.T @ gu - prior * (p.T @ gn), gu.sum() - prior * gn.sum())
                grad = prior * np.append(p.T @ gp, gp.sum()) + rest if inner >= 0 else -rest
            grad[:-1] += decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = rate * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 11) -> Model:
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(0), 0.0, 0.0)
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    mean, spread = every.mean(0), every.std(0) + 1e-2
    xp, xu = (positive - mean) / spread, (unlabelled - mean) / spread
    # the prior is estimated on rows that the first model was not fitted on, each half by the other's model
    half_p, half_u, priors = rng.permutation(len(xp)) % 2 == 0, rng.permutation(len(xu)) % 2 == 0, []
    for side in (True, False):
        w, b = _descend(xp[half_p == side], xu[half_u == side], None, rng, epochs=20)
        priors.append(estimate_prior(xp[half_p != side] @ w + b, xu[half_u != side] @ w + b, least=max(5, min(50, len(xp) // 6))) if (half_p != side).any() and (half_u != side).any() else 0.5)
    prior = float(np.mean(priors))
    w, b = _descend(xp, xu, prior, rng)
    return Model(w / spread, float(b - (mean / spread) @ w), prior)


def _vectors(rows: DataFrame) -> np.ndarray:
    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "x": [features(text).tobytes() for text in batch["text"]]})

    got = rows.select("id", "text").mapInPandas(vectors, rows.select("id").schema.add("x", "binary")).toPandas()
    got = got.sort_values("id", kind="stable")
    return np.stack([np.frombuffer(x, np.float32) for x in got["x"]]).astype(np.float64) if len(got) else np.zeros((0, BUCKETS + SIGNALS))


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """Fit on bounded samples of the trusted positives of labels (label 1) and of all documents."""
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    trusted = bounded_sample(labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct().withColumn("text", F.lit("")), "id", positive_rows)
    positive = _vectors(bounded_sample(texts.join(F.broadcast(trusted), "id", "left_semi"), "id", positive_rows))  # ids may repeat
    return fit(positive, _vectors(bounded_sample(texts, "id", unlabelled_rows)))


def score(text: Column, model: Model) -> Column:
    sent = SparkSession.active().sparkContext.broadcast(model)  # some 10 kB

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sent.value.score(text) for text in texts], dtype="float64")

    return scored(text)
