"""Node classification: softmax regression over node vectors, fitted by gradients that tasks add up.

A step takes the rows whose id falls into its mini-batch (all rows if there is one), adds up their gradients batch by batch inside the tasks and
merges these sums; one sum of classes x (numbers + 1) reaches the driver. That is bounded by MAX_NUMBERS, which is checked.
Nothing is drawn at random, so a fit is the same on every run up to the order of additions. Rows without a label take no part
in the fit; rows without a vector are left out. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.neighbours import matrix
from quillgraph.session import cut, forget

MAX_NUMBERS = 1 << 22
DIGITS = 9


@dataclass(frozen=True)
class Model:
    """Labels in order, and per label the weights of a vector's numbers and a constant."""

    labels: list
    weights: np.ndarray


def _logits(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return x @ weights[:, :-1].T + weights[:, -1]


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(rows: DataFrame, steps: int = 100, rate: float = 1.0, penalty: float = 0.0, batches: int = 1, column: str = "embedding", label: str = "label") -> Model:
    """`rows` has id, a vector and a label; `penalty` is the weight of the squared weights (not of the constants)."""
    known = rows.filter(F.col(label).isNotNull() & F.col(column).isNotNull())
    data = cut(known.select(F.pmod(F.col("id"), F.lit(batches)).alias("part"), F.transform(column, lambda v: v.cast("double")).alias("x"), F.col(label).alias("label")))
    width = data.select(F.max(F.size("x"))).first()[0]
    most = MAX_NUMBERS // ((width or 0) + 1)
    labels = [r[0] for r in data.select("label").distinct().limit(most + 1).collect()]
    if len(labels) > most:
        raise ValueError(f"more than {most} labels of {width} numbers")
    labels.sort()
    weights = np.zeros((len(labels), (width or 0) + 1))
    place = {v: k for k, v in enumerate(labels)}
    for step in range(steps if labels else 0):
        def run(found: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros_like(weights)
            for batch in found:
                if batch.num_rows:
                    x = matrix(batch.column(0))
                    off = _softmax(_logits(x, weights))
                    off[np.arange(len(x)), [place[v] for v in batch.column(1).to_pylist()]] -= 1
                    total += np.column_stack([off.T @ x, off.sum(axis=0)])
                    n += len(x)
            if n:
                yield pa.record_batch([pa.array([n], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["n", "total"])

        sums = data.filter(F.col("part") == step % batches).select("x", "label").mapInArrow(run, "n bigint, total array<double>")
        merged = sums.groupBy(F.lit("all").alias("rows")).agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("total")).collect()
        if merged:
            shrink = np.column_stack([weights[:, :-1], np.zeros(len(labels))]) * penalty
            weights = weights - rate * (merged[0]["total"].toArray().reshape(weights.shape) / merged[0]["n"] + shrink)
    forget(data)
    return Model(labels, weights)


def predict(rows: DataFrame, model: Model, column: str = "embedding") -> DataFrame:
    """id, predicted (null if nothing was learned), probability; of equal labels the first."""
    vectors = rows.filter(F.col(column).isNotNull()).select("id", F.transform(column, lambda v: v.cast("double")).alias("x"))
    if not model.labels:
        return vectors.select("id", F.lit(None).alias("predicted"), F.lit(0.0).alias("probability"))
    weights, labels = model.weights, pa.array(model.labels)
    kind = rows.sparkSession.createDataFrame([(model.labels[0],)], ["predicted"]).schema["predicted"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                logits = _logits(matrix(batch.column(1)), weights)
                best = np.round(logits, DIGITS).argmax(axis=1)
                share = _softmax(logits)[np.arange(len(best)), best]
                yield pa.record_batch([batch.column(0), labels.take(pa.array(best)), pa.array(share)], names=["id", "predicted", "probability"])

    return vectors.mapInArrow(run, f"id {dict(vectors.dtypes)['id']}, predicted {kind}, probability double")
