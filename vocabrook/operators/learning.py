"""Context models of many surfaces at once: vocabularies by aggregations, one bounded fit a surface and fold.

Everything that grows with the texts (counting words and pairs, choosing each vocabulary, document frequencies) is done by
Spark for all surfaces and folds together; the fold is a column. What is left for a surface and fold are the weights of at
most `most` texts a label on at most max(sizes) features: one group each, fitted in numpy. There is no job a surface.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import reused
from .disambiguation import WORD, grams, trainable

MODEL = "surface string, kind string, label string, feature string, weight double, idf double, f1 double, size int"


def descend(loss, start: np.ndarray, rounds: int = 400, kept: int = 10, tol: float = 1e-9) -> np.ndarray:
    """The minimum of a smooth convex function by limited-memory quasi-Newton steps; loss(x) -> (value, gradient)."""
    x, (value, slope) = start, loss(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < tol:
            break
        way, sizes = slope.copy(), []
        for s, y in reversed(moves):
            size = (s @ way) / (s @ y)
            sizes.append(size)
            way -= size * y
        if moves:
            s, y = moves[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), size in zip(moves, reversed(sizes), strict=True):
            way += s * (size - (y @ way) / (s @ y))
        stride, down = 1.0, way @ slope
        while True:
            tried = x - stride * way
            new_value, new_slope = loss(tried)
            if new_value <= value - 1e-4 * stride * down or stride < 1e-12:
                break
            stride /= 2
        s, y = tried - x, new_slope - slope
        if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)):
            moves = [*moves[-kept + 1 :], (s, y)]
        if abs(value - new_value) <= 1e-15 * max(1.0, abs(value)):
            x, value, slope = tried, new_value, new_slope
            break
        x, value, slope = tried, new_value, new_slope
    return x


class Sparse:
    """Rows of a matrix by their cells, each row of length 1."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int):
        length = np.sqrt(np.bincount(row, value * value, minlength=rows))
        self.row, self.column, self.value = row, column, value / np.where(length > 0, length, 1)[row]
        self.rows, self.columns = rows, columns

    def times(self, w: np.ndarray) -> np.ndarray:
        """(labels, columns) -> (rows, labels)."""
        return np.stack([np.bincount(self.row, self.value * v[self.column], minlength=self.rows) for v in w], axis=1)

    def back(self, r: np.ndarray) -> np.ndarray:
        """(rows, labels) -> (labels, columns)."""
        return np.stack([np.bincount(self.column, self.value * v[self.row], minlength=self.columns) for v in r.T])


def fitted(x: Sparse, y: np.ndarray, labels: int, rows: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (labels, columns) and intercepts of a softmax over the rows; of two labels the first one's are 0."""
    n, free = int(rows.sum()), labels - 1 if labels == 2 else labels
    hot = np.zeros((x.rows, labels))
    hot[np.arange(x.rows), y] = 1

    def unpacked(p):
        w, b = p[: free * x.columns].reshape(free, x.columns), p[free * x.columns :]
        if free < labels:
            w, b = np.concatenate([np.zeros((1, x.columns)), w]), np.concatenate([[0.0], b])
        return w, b

    def loss(p):
        w, b = unpacked(p)
        z = x.times(w) + b
        z -= z.max(axis=1, keepdims=True)
        total = np.log(np.exp(z).sum(axis=1))
        r = (np.exp(z - total[:, None]) - hot) * (rows / n)[:, None]
        slope = x.back(r) + w / (strength * n)
        value = -((z - total[:, None]) * hot).sum(axis=1)[rows].sum() / n + (w * w).sum() / (2 * strength * n)
        skip = labels - free
        return value, np.concatenate([slope[skip:].ravel(), r.sum(axis=0)[skip:]])

    return unpacked(descend(loss, np.zeros(free * (x.columns + 1))))


def weighted_f1(truth: np.ndarray, told: np.ndarray) -> float:
    """F1 of each label, weighted by how often it is right."""
    total = 0.0
    for label in np.unique(truth):
        hit, both = ((told == label) & (truth == label)).sum(), (told == label).sum() + (truth == label).sum()
        total += 2 * hit / both * (truth == label).mean()
    return float(total)


def learn(texts: DataFrame, sizes: Sequence[int] = (100, 1000), folds: int = 5, strength: float = 10.0, most: int = 1000, least: int = 5, kind: str = "own", cutoff: float | None = None, pattern: str = WORD) -> DataFrame:
    """texts(surface, label, text) -> the rows of all surfaces' models (see disambiguation), with f1 and size.

    A surface is learnt if it has two labels or more, each of more than `least` texts; of a label with more than `most`
    texts, the first `most` by digest are used. f1 is the mean over `folds` of the weighted F1 of held-out texts; the size
    of vocabulary with the best one is taken (the smaller of equals). cutoff: models with an f1 above it only.
    """
    turn = Window.partitionBy("surface", "label").orderBy("key")
    rows = texts.filter("surface is not null and label is not null and text is not null").withColumn("key", F.md5("text"))
    rows = rows.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= most).withColumn("fold", (F.col("turn") - 1) % folds)
    rows = reused(rows.join(trainable(rows, least=least), "surface", "left_semi").select("surface", "label", "turn", "fold", grams("text", pattern).alias("grams")))
    cells = rows.select("surface", "label", "turn", "fold", F.explode("grams").alias("feature")).groupBy("surface", "label", "turn", "fold", "feature").agg(F.count("*").alias("times"))

    # the fit of fold k leaves out its texts; that of fold -1 has all
    others = F.explode(F.filter(F.sequence(F.lit(-1), F.lit(folds - 1)), lambda k: k != F.col("fold"))).alias("k")
    counts = cells.groupBy("surface", "feature", "fold").agg(F.sum("times").alias("tf"), F.count("*").alias("df"))
    counts = counts.select("surface", "feature", "tf", "df", others).groupBy("surface", "k", "feature").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    place = F.row_number().over(Window.partitionBy("surface", "k").orderBy(F.desc("tf"), "feature")) - 1
    sums = rows.groupBy("surface", "fold").count().select("surface", "count", others).groupBy("surface", "k").agg(F.sum("count").alias("n"))
    words = counts.withColumn("at", place).filter(F.col("at") < max(sizes)).join(sums, ["surface", "k"])
    words = reused(words.select("surface", "k", "feature", "at", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf")))

    data = cells.join(words, ["surface", "feature"]).select("surface", "k", "label", "turn", "fold", "at", (F.col("times") * F.col("idf")).alias("value"))
    # a text without a word of the vocabulary is a row too
    every = rows.select("surface", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1))).alias("k"), "label", "turn", "fold", F.lit(-1).alias("at"), F.lit(0.0).alias("value"))
    sizes = sorted(sizes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        surface, k = pdf["surface"].iloc[0], int(pdf["k"].iloc[0])
        labels, y = np.unique(pdf["label"].to_numpy(str), return_inverse=True)
        order, row = np.unique(np.stack([y, pdf["turn"].to_numpy()]), axis=1, return_inverse=True)
        row, n = row.ravel(), order.shape[1]
        fold = np.zeros(n, np.int64)
        fold[row] = pdf["fold"]
        at, value, out = pdf["at"].to_numpy(), pdf["value"].to_numpy(float), []
        for size in sizes:
            cell = (at >= 0) & (at < size)
            x = Sparse(row[cell], at[cell], value[cell], n, size)
            w, b = fitted(x, order[0], len(labels), fold != k, strength)
            if k < 0:
                used = np.unique(at[cell])
                out += [(surface, k, size, label, -1, float(b[i]), None) for i, label in enumerate(labels)]
                out += [(surface, k, size, label, int(c), float(w[i, c]), None) for i, label in enumerate(labels) for c in used]
            elif (fold == k).any():
                out.append((surface, k, size, None, None, None, weighted_f1(order[0][fold == k], (x.times(w) + b).argmax(axis=1)[fold == k])))
        return pd.DataFrame(out, columns=["surface", "k", "size", "label", "at", "weight", "f1"]).astype({"at": "Int32"})

    fits = reused(data.unionByName(every).groupBy("surface", "k").applyInPandas(fit, "surface string, k int, size int, label string, at int, weight double, f1 double"))
    best = fits.filter("k >= 0").groupBy("surface", "size").agg(F.avg("f1").alias("f1")).groupBy("surface").agg(F.max(F.struct("f1", (-F.col("size")).alias("neg"))).alias("best"))
    best = best.select("surface", F.col("best.f1").alias("f1"), (-F.col("best.neg")).cast("int").alias("size"))
    best = best.filter(F.col("f1") > cutoff) if cutoff is not None else best
    rows = fits.filter("k = -1").drop("f1").join(best, ["surface", "size"]).join(words.filter("k = -1").select("surface", "at", "feature", "idf"), ["surface", "at"], "left")
    return rows.select("surface", F.lit(kind).alias("kind"), "label", "feature", "weight", "idf", "f1", "size")
