"""Quality classifier: Naive Bayes support vectors.

n-gram indicators (byte trigrams, word-shape trigrams and binned shapes) are
scaled by their class log-count ratios; on them a linear hinge-loss model is
fitted by dual coordinate descent, and its margin made a probability by a
sigmoid fitted on rows left out of a first fit.

The model is fitted on the driver from SAMPLE labelled documents at most,
chosen by hash of doc_id among all rows whose crc32(doc_id as text) mod 5 is
not 0; it has DIMS weights whatever the input.  Every document is then scored
in one scan.

Defined cases: null text is an empty one, which is scored like any other;
labels that are null are left out, contrary labels of a document count as 1;
without labels of both classes every score is the share of 1 (0.5 without any).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import features, linear
from .fitting import DIMS, remainder, sample, scored

SAMPLE = 8192
FOLD, HELD_OUT = 5, 0
THRESHOLD = 0.3


class Model:
    """weight and scale by feature, bias, and the sigmoid's a and b."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        self.scale = np.zeros(DIMS)
        self.weight, self.bias, self.a = np.zeros(DIMS), 0.0, 0.0
        share = float(y.mean()) if len(y) else 0.5
        self.b = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        if len(set(y.tolist())) == 2:
            part = np.arange(len(y)) % 4 == 0
            if len(set(y[part].tolist())) == 2 and len(set(y[~part].tolist())) == 2:
                some = [r for r, p in zip(rows, part, strict=True) if not p]
                scale = linear.log_count_ratios(some, y[~part], DIMS)
                w, _, b = linear.dual_coordinate_descent(some, y[~part], scale)
                out = linear.decision([r for r, p in zip(rows, part, strict=True) if p], scale, w, b)
                self.a, self.b = linear.sigmoid_fit(out, y[part])
            else:
                self.a, self.b = 4.0, 0.0
            self.scale = linear.log_count_ratios(rows, y, DIMS)
            self.weight, _, self.bias = linear.dual_coordinate_descent(rows, y, self.scale)
        self.product = (self.weight * self.scale).astype(np.float64)
        self.square = self.scale**2

    def __call__(self, own: np.ndarray, place: np.ndarray, n: int) -> dict[str, np.ndarray]:
        dot = np.bincount(own, weights=self.product[place], minlength=n)
        norm = np.sqrt(np.bincount(own, weights=self.square[place], minlength=n))
        f = dot / np.maximum(norm, 1e-9) + self.bias
        return {"score": linear.probability(f, self.a, self.b)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Model:
    rows, y = sample(docs, labels, [label], features.style, bound, remainder(F.col("doc_id"), FOLD) != HELD_OUT)
    return Model(rows, y[:, 0])


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    out = scored(docs, features.style, fit(docs, labels, label, bound), ["score"])
    held = remainder(F.col("doc_id"), FOLD) == HELD_OUT
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
