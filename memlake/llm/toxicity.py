"""Toxicity by a classifier chain.

The categories are predicted one after the other.  Each has a linear model over
lower-cased words and their beginnings; every later model also reads the
earlier categories' probabilities, and is trained with those predicted for each
training row by models that did not see the row (out of fold), so that it meets
in training what it will meet in use.

labels has one toxicity flag and one quality flag, of which three categories
are made: toxic_prose (toxic, in good text), toxic_junk (toxic, in poor text)
and last toxic, which reads both and is the verdict.  Where quality is not
known, only toxic is learned from a row that is toxic.  The models are fitted on the driver from at most SAMPLE toxic and
SAMPLE other labelled documents, chosen by hash; documents are scored in one
scan.

Defined cases: null text is an empty one; a null toxicity label is left out; a
category without both classes in the sample has its share as probability.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import features, linear
from .fitting import DIMS, sample, scored

SAMPLE = 4096
FOLDS = 3
THRESHOLD = 0.5
CATEGORIES = ("toxic_prose", "toxic_junk", "toxic")


class Link:
    """One category's model: words and earlier probabilities to a probability."""

    def __init__(self, rows: Sequence[np.ndarray], y: np.ndarray, earlier: np.ndarray, calibration: tuple[float, float] | None = None):
        self.scale, self.weight = np.zeros(DIMS), np.zeros(DIMS)
        self.dense, self.bias = np.zeros(earlier.shape[1]), 0.0
        share = float(y.mean()) if len(y) else 0.0
        self.a, self.b = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        if 0 < share < 1:
            self.scale = linear.log_count_ratios(rows, y, DIMS, alpha=0.5)
            self.weight, self.dense, self.bias = linear.dual_coordinate_descent(rows, y, self.scale, c=1.0, epochs=5, dense=earlier)
            self.a, self.b = calibration or (4.0, 0.0)

    def margin(self, rows: Sequence[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        return linear.decision(rows, self.scale, self.weight, self.bias, earlier, self.dense)


class Chain:
    """The links in the order of names; a label of -1 is not known and no link learns from it."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, names: Sequence[str] = CATEGORIES, folds: int = FOLDS):
        self.names, self.links = tuple(names), []
        n = len(rows)
        earlier, fold = np.zeros((n, 0)), np.arange(n) % folds
        for k in range(len(self.names)):
            y, out = labels[:, k], np.zeros(n)
            known = y >= 0
            for f in range(folds):
                train, test = np.flatnonzero((fold != f) & known), np.flatnonzero(fold == f)
                link = Link([rows[i] for i in train], y[train], earlier[train])
                out[test] = link.margin([rows[i] for i in test], earlier[test])
            a_b = linear.sigmoid_fit(out[known], y[known]) if 0 < y[known].sum() < known.sum() else None
            self.links.append(Link([rows[i] for i in np.flatnonzero(known)], y[known], earlier[known], a_b))
            p = linear.probability(out, self.links[-1].a, self.links[-1].b)
            earlier = np.column_stack([earlier, p])

    def __call__(self, own: np.ndarray, place: np.ndarray, n: int) -> dict[str, np.ndarray]:
        probs: dict[str, np.ndarray] = {}
        for name, link in zip(self.names, self.links, strict=True):
            x = link.scale[place]
            norm = np.sqrt(np.bincount(own, weights=x * x, minlength=n))
            f = np.bincount(own, weights=link.weight[place] * x, minlength=n) / np.maximum(norm, 1e-9) + link.bias
            for v, p in zip(link.dense, probs.values(), strict=True):
                f = f + v * p
            probs[name] = linear.probability(f, link.a, link.b)
        return probs


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Chain:
    rows, y = sample(docs, labels, ["toxic", "quality"], features.vocabulary, bound, F.lit(True), stratum="toxic")
    toxic, good = y[:, 0], y[:, 1]
    unknown = (toxic == 1) & (good < 0)
    return Chain(rows, np.column_stack([np.where(unknown, -1, toxic * good), np.where(unknown, -1, toxic * (1 - good)), toxic]))


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_<category>..., toxic) for every document."""
    out = scored(docs, features.vocabulary, fit(docs, labels, bound), list(CATEGORIES))
    return out.select("doc_id", *[F.col(c).alias(f"p_{c}") for c in CATEGORIES], (F.col("toxic") >= threshold).cast("int").alias("toxic"))
