"""Connected components of links, as DataFrame rounds of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import join_hot, store


def roots(links: DataFrame) -> DataFrame:
    """node, root for every linked node that isn't itself the least of its component; `links` has columns a, b.

    A round hangs the larger neighbours of each node, then the smaller ones, on the least of them; the number of
    rounds grows with the logarithm of the longest path. Neighbours are never gathered: the least is an aggregate,
    and nodes of very many links are joined without moving their rows.
    """
    edges = store(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = join_hot(both, least, "a", "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store(large.distinct(), "large")
        below = store(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "below")
        small = join_hot(large, below, "a", "n").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = store(below.select("a", F.col("m").alias("b")).unionByName(small).distinct(), "links")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
