"""Node vectors meet the edges without a broadcast."""

from pyspark.sql import functions as F

from quillgraph.operators import embedding as em


def test_vectors_are_not_broadcast(spark):
    """A drawn vector looks small in the plan: thousands of rows of 256 numbers came under the broadcast limit."""
    nodes = spark.range(2000)
    edges = nodes.select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % 2000).alias("dst"), F.lit(1.0).alias("weight"))
    means = em._neighbour_mean(edges, em.random_rows(nodes, "id", 256, 0), False)
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    drawn = {r["id"]: r["vector"] for r in em.random_rows(nodes, "id", 256, 0).filter("id IN (3, 10)").collect()}
    got = {r["id"]: r["vector"] for r in means.filter("id IN (0, 1)").collect()}
    assert got == {0: drawn[3], 1: drawn[10]} and means.count() == 2000
