"""Operator 7: a quality classifier on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import bounded, held_out, ngrams, scored, training_rows
from .shared import slices, small_batches

BITS, MOST = 20, 2


def values(row: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """log(1 + count), scaled to length 1 for each row."""
    x = np.log1p(count)
    return x / np.sqrt(np.maximum(np.bincount(row, x * x, rows), 1e-12))[row]


class Ftrl:
    """Logistic regression with per-coordinate follow-the-regularised-leader (proximal) updates."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        """One example: its distinct coordinates, their values and its label."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 5000, passes: int = 4, folds: int = 3, fold: int = 1) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Log counts of hashed 1- and 2-grams of tokens, scaled to length 1, plus a bias coordinate; at most ``train_rows``
    labelled rows outside the held-out fold train (those with the smallest hashed ids), in ``passes`` shuffled passes
    with a fixed seed. A text's score is the sparse dot product of its n-grams with the weights, in one pass.

    Null and empty texts get the bias alone; null ids are held out; null labels do not train; without labelled rows
    every score is 0.5. Repeated rows are scored each. Only the named columns are read. An empty table gives an empty
    result."""
    spark = docs.sparkSession
    small_batches(spark)

    def features(batches):
        for batch in batches:
            for part in slices(batch, "text_"):
                row, bucket, count, _ = ngrams(part.column("text_"), BITS, MOST)
                x, cuts = values(row, count, part.num_rows), np.searchsorted(row, np.arange(part.num_rows + 1))
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays([part.column("label_"), pa.array([bucket[a:z].astype("<u4").tobytes() for a, z in spans]), pa.array([x[a:z].astype("<f4").tobytes() for a, z in spans])], names=["label_", "at", "x"])

    known = labels.where(~held_out(id_col, folds, fold))
    table = training_rows(docs, known, F.col(label_col).cast("int"), id_col, text_col, train_rows).mapInArrow(features, "label_ int, at binary, x binary")
    table = bounded(table, train_rows, "at", "label_").toArrow()
    rows = sorted(zip(*(table.column(i).to_pylist() for i in (1, 2, 0)), strict=True))
    model, order = Ftrl((1 << BITS) + 1), np.random.default_rng(5)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            model.learn(np.append(np.frombuffer(at, "<u4"), 1 << BITS), np.append(np.frombuffer(x, "<f4").astype(float), 1.0), label)
    weights = spark.sparkContext.broadcast(model.weights().astype(np.float32))

    def score(column):
        w = weights.value
        row, bucket, count, _ = ngrams(column, BITS, MOST)
        z = w[-1] + np.bincount(row, w[bucket] * values(row, count, len(column)), len(column))
        return [1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))]

    out = scored(docs, id_col, text_col, [T.StructField("score", T.DoubleType())], score)
    return out.select(id_col, held_out(id_col, folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
