"""Node embeddings, clustering of vectors, vector similarity."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.vectors import cosine
from quillgraph.operators.explore import with_ends
from quillgraph.operators.graph import NATURAL, Graph
from quillgraph.operators.node_means import Places, means
from quillgraph.operators.ranking import range_buckets, sample_key, sample_per_group
from quillgraph.session import cut

# A digest gives eight 16-bit draws: below the first bound +sqrt(3), below the second -sqrt(3), else 0.
DRAWS_PER_DIGEST = 8
PLUS_BELOW, MINUS_BELOW = 10923, 21845


def random_rows(df: DataFrame, key: str, dim: int, seed: int) -> DataFrame:
    """The rows and `vector`: very sparse random projection row of each key, the same on every run."""
    blocks = math.ceil(dim / DRAWS_PER_DIGEST)
    digests = f"transform(sequence(0, {blocks - 1}), b -> md5(concat({key}, '-', b, '-', {seed})))"
    draws = f"flatten(transform({digests}, h -> transform(sequence(0, {DRAWS_PER_DIGEST - 1}), j -> conv(substr(h, 4 * j + 1, 4), 16, 10))))"
    entries = f"transform({draws}, x -> CASE WHEN x < {PLUS_BELOW} THEN sqrt(3D) WHEN x < {MINUS_BELOW} THEN -sqrt(3D) ELSE 0D END)"
    return df.select("*", array_to_vector(F.slice(F.expr(entries), 1, dim)).alias("vector"))


def _neighbour_mean(edges: DataFrame, vectors: DataFrame, weighted: bool, places: Places | None = None) -> DataFrame:
    """id, part, pos, vector: weighted mean of the vectors of the nodes it points to, added up slice by slice (see `node_means`).

    Drawn vectors look small in the plan and in a file, so joins are asked to merge; one row per node is never broadcast.
    """
    places = places or Places(edges, vectors)
    at = vectors if "pos" in vectors.columns else places.on(vectors)
    first = vectors.select(F.size(vector_to_array("vector"))).first()
    found = means(places, at.select("part", "pos", vector_to_array("vector").alias("vector")), first[0] if first else 0, weighted)
    return found.select("id", "part", "pos", array_to_vector("vector").alias("vector"))


def _unit(df: DataFrame) -> DataFrame:
    return Normalizer(inputCol="vector", outputCol="unit", p=2.0).transform(df).select("id", "part", "pos", F.col("unit").alias("vector"))


def fast_rp(graph: Graph, dim: int = 256, weighted: bool = False, seed: int = 0, orientation: str = NATURAL,
            features: DataFrame | None = None, feature_dim: int = 0) -> DataFrame:
    """id, embedding (array): sum of the normalised one- and two-step neighbour means of random rows.

    `features` (id, embedding) adds a block: the node's own features times a random matrix.
    """
    edges = graph.oriented(orientation).select("src", "dst", "weight")
    places = Places(edges, graph.nodes).stored()
    rows = random_rows(places.on(graph.nodes.select("id")), "id", dim, seed)
    one = cut(_unit(_neighbour_mean(edges, rows, weighted, places)))
    two = _unit(_neighbour_mean(edges, one, weighted, places))
    zero = F.array_repeat(F.lit(0.0), dim)
    p1 = one.select("id", vector_to_array("vector").alias("p1"))
    p2 = two.select("id", vector_to_array("vector").alias("p2"))
    out = graph.nodes.select("id").join(p1, "id", "left").join(p2, "id", "left").select(
        "id", F.zip_with(F.coalesce("p1", zero), F.coalesce("p2", zero), lambda a, b: a + b).alias("embedding"))
    if features is None:
        return out
    block = project_features(features, feature_dim, seed + 1)
    empty = F.array_repeat(F.lit(0.0), feature_dim)
    return out.join(block, "id", "left").select("id", F.concat("embedding", F.coalesce("projected", empty)).alias("embedding"))


def project_features(features: DataFrame, dim: int, seed: int) -> DataFrame:
    """id, projected: features times a (feature x dim) random matrix whose rows depend on the feature number only."""
    cells = features.select("id", F.posexplode("embedding").alias("pos", "value"))
    width = features.select(F.max(F.size("embedding")).alias("w")).select(
        F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("pos"))
    matrix = random_rows(width, "pos", dim, seed).select(
        "pos", F.posexplode(vector_to_array("vector")).alias("dim", "entry")).filter("entry <> 0")
    sums = cells.join(matrix, "pos").groupBy("id", "dim").agg(F.sum(F.col("value") * F.col("entry")).alias("v"))
    packed = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m"))  # at most dim entries
    return packed.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.coalesce(
        F.try_element_at(F.col("m"), j.cast("int")), F.lit(0.0))).alias("projected"))


def kmeans(vectors: DataFrame, k: int = 120, seed: int = 0, iterations: int = 20, column: str = "embedding") -> DataFrame:
    """id, cluster: Lloyd rounds from the k rows of the least draw (`sample_key`); ties go to the first centre.

    Only the k centres are on the driver and in the tasks. A task adds up its rows by cluster before the shuffle, so a cluster
    holding most rows is k small sums per batch. Distances are compared to 9 digits, so that the order of additions
    doesn't decide. An empty cluster keeps its centre.
    """
    data = cut(vectors.select("id", F.transform(column, lambda x: x.cast("double")).alias("x")))
    first = data.orderBy(sample_key("id", seed), "id").limit(k).collect()
    centres = np.array([r["x"] for r in first], float)
    for _ in range(iterations if first else 0):
        sums = data.select("x").mapInArrow(_nearest(centres, True), "cluster int, n bigint, total array<double>")
        moved = sums.groupBy("cluster").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("total")).collect()
        before = centres.copy()
        for r in moved:
            centres[r["cluster"]] = r["total"].toArray() / r["n"]
        if np.array_equal(before, centres):
            break
    return data.mapInArrow(_nearest(centres, False), data.select("id", F.lit(0).alias("cluster")).schema)


def _nearest(centres: np.ndarray, total: bool):
    """Batch function: the cluster of each row, or the sum of the rows of each cluster."""
    squares = (centres * centres).sum(axis=1)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cluster = np.round(squares - 2 * x @ centres.T, 9).argmin(axis=1).astype(np.int32) if batch.num_rows else np.zeros(0, np.int32)
            if not total:
                yield pa.record_batch([batch.column("id"), pa.array(cluster)], names=["id", "cluster"])
            elif batch.num_rows:
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                sums = np.add.reduceat(x[order], first, axis=0)
                n = np.diff(np.append(first, len(order)))
                yield pa.record_batch([pa.array(found), pa.array(n.astype(np.int64)), pa.array(list(sums), pa.list_(pa.float64()))], names=["cluster", "n", "total"])

    return run


def combine_vectors(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, embedding: the two vectors one after the other (ids present on both sides)."""
    return left.select("id", F.col("embedding").alias("l")).join(
        right.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("r")), "id").select(
        "id", F.concat("l", "r").alias("embedding"))


def mean_pool(tokens: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """key, embedding: element-wise mean of all vectors of a key; a task sends one vector per key."""
    vector = array_to_vector(F.transform(column, lambda x: x.cast("double")))
    means = tokens.select(key, vector.alias("v")).groupBy(key).agg(Summarizer.mean(F.col("v")).alias("m"))
    return means.select(key, vector_to_array("m").alias("embedding"))


def edge_similarity(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """src, dst, similarity (float): cosine of the end vectors; null if an end has no vector."""
    a = vectors.select(F.col("id").alias("src"), F.col("embedding").alias("v1"))
    b = vectors.select(F.col("id").alias("dst"), F.col("embedding").alias("v2"))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    return both.select("src", "dst", cosine(F.col("v1"), F.col("v2")).cast("float").alias("similarity"))


def category_similarity(vectors: DataFrame, sample: int | None = None, seed: int = 0) -> DataFrame:
    """category_a, category_b, similarity: mean cosine over pairs of different rows, one from each category.

    The mean of u.v over all pairs is the dot product of the category sums of unit vectors, so no pair
    of rows is formed: one sum per (category, position), then category sums meet on the position.
    A category paired with itself leaves out each row's product with itself.
    """
    rows = sample_per_group(vectors, ["category"], "id", sample, seed) if sample else vectors
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = rows.select("category", F.posexplode(F.transform(
        "embedding", lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))).alias("pos", "u"))
    sums = cut(unit.groupBy("category", "pos").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("own")))
    sizes = rows.groupBy("category").agg(F.count("*").alias("n"))
    a = sums.select(F.col("category").alias("category_a"), "pos", F.col("s").alias("sa"), F.col("own"))
    b = sums.select(F.col("category").alias("category_b"), "pos", F.col("s").alias("sb"))
    dots = a.join(b, "pos").groupBy("category_a", "category_b").agg(
        F.sum(F.col("sa") * F.col("sb")).alias("dot"), F.sum("own").alias("own"))
    sized = dots.join(sizes.select(F.col("category").alias("category_a"), F.col("n").alias("na")), "category_a").join(
        sizes.select(F.col("category").alias("category_b"), F.col("n").alias("nb")), "category_b")
    same = F.col("category_a") == F.col("category_b")
    total = F.when(same, F.col("dot") - F.col("own")).otherwise(F.col("dot"))
    pairs = F.when(same, F.col("na") * (F.col("na") - 1)).otherwise(F.col("na") * F.col("nb"))
    return sized.filter(pairs > 0).select("category_a", "category_b", (total / pairs).alias("similarity"), pairs.alias("pairs"))


def directed_category_similarity(vectors: DataFrame, rows_per_bucket: int = 500) -> DataFrame:
    """category_a, category_b, similarity, pairs: mean cosine over row pairs a < b (by id), a of the first and b of the second category.

    Rows are cut into buckets by id. Two buckets part at the highest bit in which their numbers differ, so for each bit
    the sums of unit vectors of the lower halves meet those of the upper halves. Only pairs inside a bucket are formed, so
    work is linear in the rows.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))
    rows = cut(range_buckets(vectors.select("id", "category", unit.alias("u")), "id", "bucket", rows_per_bucket))
    cells = cut(rows.select("bucket", "category", F.posexplode("u").alias("pos", "x")).groupBy("bucket", "category", "pos").agg(F.sum("x").alias("s")))
    sizes = rows.groupBy("bucket", "category").agg(F.count("*").alias("n"))
    bits = max(1, (rows.agg(F.max("bucket")).first()[0] or 0).bit_length())

    def halves(parts: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
        """Sums of the lower and of the upper half below every node of the binary tree over the buckets."""
        up = parts.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).groupBy(
            "bit", F.expr("shiftright(bucket, bit + 1)").alias("node"), F.expr("shiftright(bucket, bit) % 2").alias("side"), *keys).agg(F.sum(value).alias(value))
        up = cut(up)
        return tuple(up.filter(F.col("side") == i).drop("side").withColumnsRenamed({"category": f"category_{c}", value: f"{value}{c}"}) for i, c in ((0, "a"), (1, "b")))

    lower, upper = halves(cells, ["category", "pos"], "s")
    across = lower.join(upper, ["bit", "node", "pos"]).groupBy("category_a", "category_b").agg(F.sum(F.col("sa") * F.col("sb")).alias("total"))
    lower, upper = halves(sizes, ["category"], "n")
    counts = lower.join(upper, ["bit", "node"]).groupBy("category_a", "category_b").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"))
    left = rows.select("bucket", F.col("id").alias("a"), F.col("category").alias("category_a"), F.col("u").alias("ua"))
    right = rows.select("bucket", F.col("id").alias("b"), F.col("category").alias("category_b"), F.col("u").alias("ub"))
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    inside = left.join(right, "bucket").filter("a < b").groupBy("category_a", "category_b").agg(F.sum(dot).alias("total"), F.count("*").alias("pairs"))
    every = across.join(counts, ["category_a", "category_b"]).unionByName(inside).groupBy("category_a", "category_b").agg(
        F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
    return every.filter("pairs > 0").select("category_a", "category_b", (F.col("total") / F.col("pairs")).alias("similarity"), "pairs")


def directed_category_difference(similarity: DataFrame) -> DataFrame:
    """category_a, category_b, difference as in `category_difference`, with every ordered pair of categories counted by itself."""
    sums = similarity.withColumn("total", F.col("similarity") * F.col("pairs"))
    own = sums.filter("category_a = category_b").agg(F.sum("total") / F.sum("pairs")).scalar()
    return sums.select("category_a", "category_b", F.try_divide(F.col("total") - 2 * own, F.col("pairs") - 1).alias("difference"))


def category_difference(similarity: DataFrame) -> DataFrame:
    """category_a, category_b, difference = (sum of similarities - 2 * mean own similarity) / (pairs - 1).

    Unordered row pairs count, as in `category_similarity(...)`'s `pairs` for different categories;
    the mean own similarity runs over all row pairs inside categories.
    """
    same = F.col("category_a") == F.col("category_b")
    pairs = F.when(same, F.col("pairs") / 2).otherwise(F.col("pairs"))
    sums = similarity.withColumn("n", pairs).withColumn("total", F.col("similarity") * pairs)
    own = sums.filter(same).agg(F.sum("total") / F.sum("n")).scalar()
    return sums.select("category_a", "category_b",
                       F.try_divide(F.col("total") - 2 * own, F.col("n") - 1).alias("difference"))


def category_mean_difference(similarity: DataFrame) -> DataFrame:
    """category, mean_difference = (mean similarity to other categories - own similarity) / other categories."""
    own = similarity.filter("category_a = category_b").select("category_a", F.col("similarity").alias("own"))
    other = similarity.filter("category_a <> category_b").groupBy("category_a").agg(
        F.avg("similarity").alias("mean"), F.count("*").alias("n"))
    return own.join(other, "category_a").select(
        F.col("category_a").alias("category"), ((F.col("mean") - F.col("own")) / F.col("n")).alias("mean_difference"))


def category_deviation(similarity: DataFrame) -> DataFrame:
    """category_a, category_b, deviation from the first category's mean similarity."""
    mean = similarity.groupBy("category_a").agg(F.avg("similarity").alias("mean"))
    return similarity.join(mean, "category_a").select(
        "category_a", "category_b", (F.col("similarity") - F.col("mean")).alias("deviation"))
