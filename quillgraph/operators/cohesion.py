"""Geometry of clusterings: silhouette, Davies-Bouldin, Calinski-Harabasz, distances to centroids.

One pass over the rows gives the moments of each cluster: number, sum vector and sum of squares. They merge, so a task sends one row per
cluster, and a cluster of a third of all rows is as cheap as any other. Everything else follows from them:
the mean squared distance of a row x to a cluster is |x|^2 - 2 x.sum/n + squares/n, so no pairs of rows are formed.

Rows meet the clusters in blocks of BLOCK_NUMBERS numbers of moments, which bounds what a task holds however many clusters there are.
`vectors` has id and a vector, `assigned` has id and cluster; rows without a vector or cluster are left out. Distances are
Euclidean, those of the silhouette squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.neighbours import matrix
from quillgraph.session import cut, forget

BLOCK_NUMBERS = 1 << 21


def placed(vectors: DataFrame, assigned: DataFrame, column: str = "embedding") -> DataFrame:
    """id, cluster, x (doubles)."""
    x = F.transform(column, lambda v: v.cast("double")).alias("x")
    return vectors.select("id", x).filter("x IS NOT NULL").join(assigned.filter("cluster IS NOT NULL").select("id", "cluster"), "id")


def moments(rows: DataFrame) -> DataFrame:
    """cluster, n, total (sum vector), squares (sum of squared lengths)."""
    summed = rows.select("cluster", array_to_vector("x").alias("v")).groupBy("cluster").agg(
        Summarizer.metrics("count", "sum", "normL2").summary(F.col("v")).alias("s"))
    squares = F.aggregate(vector_to_array("s.normL2"), F.lit(0.0), lambda t, v: t + v * v)
    return summed.select("cluster", F.col("s.count").alias("n"), vector_to_array("s.sum").alias("total"), squares.alias("squares"))


def _blocks(found: DataFrame) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """clusters, n, sum vectors, squares of one bounded block of clusters after the other."""
    block, size = [], 0
    for r in found.orderBy("cluster").toLocalIterator():
        block.append(r)
        size += len(r["total"])
        if size >= BLOCK_NUMBERS:
            yield _block(block)
            block, size = [], 0
    if block:
        yield _block(block)


def _block(rows: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    return [r["cluster"] for r in rows], np.array([r["n"] for r in rows], float), np.array([r["total"] for r in rows], float), np.array([r["squares"] for r in rows], float)


def silhouette_rows(rows: DataFrame) -> DataFrame:
    """id, cluster, silhouette: (b - a) / max(a, b) with a the mean squared distance to the rest of the own cluster, b the least one to another; 0 in a cluster of one."""
    rows = cut(rows)
    found = cut(moments(rows))
    state = rows.select("id", "cluster", "x", F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    kept = None
    for labels, n, total, squares in _blocks(found):
        place = {c: k for k, c in enumerate(labels)}

        def run(batches: Iterator[pa.RecordBatch], place=place, n=n, total=total, squares=squares) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column(2))
                length = (x * x).sum(axis=1)
                sums = np.maximum(squares - 2 * x @ total.T + n * length[:, None], 0.0)
                own = np.array([place.get(c, -1) for c in batch.column(1).to_pylist()])
                here = np.flatnonzero(own >= 0)
                a, b = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[3:])
                a, b, mean = a.copy(), b.copy(), sums / n
                rest = n[own[here]] - 1
                a[here] = np.where(rest > 0, sums[here, own[here]] / np.maximum(rest, 1), 0.0)
                mean[here, own[here]] = np.inf
                b = np.fmin(b, mean.min(axis=1))
                number = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
                yield pa.record_batch([*batch.columns[:3], number(a), number(b)], names=batch.schema.names)

        state = cut(state.mapInArrow(run, state.schema))
        if kept is not None:
            forget(kept)
        kept = state
    single = found.filter("n = 1").select("cluster", F.lit(True).alias("single"))
    top = F.greatest("a", "b")
    score = F.when(F.col("single") | F.isnull("b") | (F.col("b") == float("inf")) | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return state.join(single, "cluster", "left").select("id", "cluster", score.alias("silhouette"))


def silhouette(rows: DataFrame) -> DataFrame:
    """One row: rows, silhouette (mean)."""
    return silhouette_rows(rows).agg(F.count("*").alias("rows"), F.avg("silhouette").alias("silhouette"))


def centroids(found: DataFrame) -> DataFrame:
    """cluster, n, centroid, rms_distance (square root of the mean squared distance to the centroid)."""
    length = F.aggregate("total", F.lit(0.0), lambda s, v: s + v * v)
    spread = F.sqrt(F.greatest((F.col("squares") - length / F.col("n")) / F.col("n"), F.lit(0.0)))
    return found.select("cluster", "n", F.transform("total", lambda v: v / F.col("n")).alias("centroid"), spread.alias("rms_distance"))


def centroid_distances(rows: DataFrame, found: DataFrame) -> DataFrame:
    """id, cluster, distance of each row to the centroid of its cluster."""
    centre = centroids(found).select("cluster", "centroid")
    gap = F.sqrt(F.aggregate(F.zip_with("x", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return rows.join(centre, "cluster").select("id", "cluster", gap.alias("distance"))


def mean_centroid_distance(rows: DataFrame) -> DataFrame:
    """cluster, n, mean_distance, rms_distance, max_distance."""
    found = cut(moments(rows))
    mean = centroid_distances(rows, found).groupBy("cluster").agg(F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"))
    return centroids(found).select("cluster", "n", "rms_distance").join(mean, "cluster")


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    """One row: clusters, rows, calinski_harabasz = (between / (k - 1)) / (within / (n - k)); null below two clusters, without spread or without spare rows."""
    found = cut(moments(rows))
    length = F.aggregate("total", F.lit(0.0), lambda s, v: s + v * v)
    whole = found.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.sum(length / F.col("n")).alias("heavy"))
    cells = found.select(F.posexplode("total").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))
    middle = cells.agg(F.sum(F.col("v") * F.col("v"))).scalar() / F.col("n")
    between, within = F.col("heavy") - middle, F.col("squares") - F.col("heavy")
    score = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))))
    return whole.select(F.col("k").alias("clusters"), F.coalesce("n", F.lit(0)).cast("bigint").alias("rows"), score.alias("calinski_harabasz"))


def davies_bouldin(rows: DataFrame, root_mean_square: bool = False) -> DataFrame:
    """One row: clusters, davies_bouldin: mean over clusters of the largest (s_i + s_j) / distance of the centroids.

    s is the mean distance to the centroid or, straight from the moments without a second pass, the root of the mean squared one. Clusters of one centroid don't meet.
    """
    found = cut(moments(rows))
    scatter = centroids(found).select("cluster", "n", F.col("centroid").alias("total"), F.col("rms_distance").alias("squares"))
    if not root_mean_square:
        mean = centroid_distances(rows, found).groupBy("cluster").agg(F.avg("distance").alias("squares"))
        scatter = scatter.drop("squares").join(mean, "cluster")
    scatter = cut(scatter)
    state = kept = scatter.select("cluster", "total", "squares", F.lit(0.0).alias("worst"))
    for _, _, centre, s in _blocks(scatter):
        def run(batches: Iterator[pa.RecordBatch], centre=centre, s=s) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, own, worst = matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
                apart = np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centre], axis=1)
                ratio = np.where(apart > 0, (own[:, None] + s) / np.where(apart > 0, apart, 1.0), 0.0)
                yield pa.record_batch([*batch.columns[:3], pa.array(np.maximum(worst, ratio.max(axis=1)))], names=batch.schema.names)

        state = cut(state.mapInArrow(run, state.schema))
        forget(kept)
        kept = state
    return state.agg(F.count("*").alias("clusters"), F.avg("worst").alias("davies_bouldin"))
