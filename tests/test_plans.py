"""Plan shape: native expressions, no cross joins, columns pruned and filters pushed to the scan."""

import pytest

from quillgraph.plans import all as _all  # noqa: F401
from quillgraph.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"
LAZY = ["category_citation_matrix", "coverage", "modularity_directed", "term_tfidf", "cooccurrence_by_year", "extract_keywords",
        "edge_similarity", "accuracy_per_category", "strongest_topics_of_article", "detect_language", "two_hop_ancestors", "category_similarity"]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_native_plan(spark, name):
    plan = physical(REGISTRY[name].run(spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_only_needed_columns_are_read(spark):
    plan = physical(REGISTRY["category_citation_matrix"].run(spark, SF))
    assert "l_extendedprice" not in plan and "p_retailprice" not in plan


def test_filters_reach_the_scan(spark):
    assert "EqualTo(lang,en)" in physical(REGISTRY["english_documents"].run(spark, SF))


def test_rank_filter_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in physical(REGISTRY["strongest_topics_of_article"].run(spark, SF))


def test_stored_edges_are_not_shuffled_or_sorted_again(spark, make):
    from pyspark.sql import functions as F

    from quillgraph.operators.graph import Adjacency

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = make([(i, (i * 7) % 50) for i in range(50)])
        adjacency = Adjacency(g.edges, "src")
        one = adjacency.attach(g.nodes.select("id", F.lit(1.0).alias("x"))).groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("x"))
        plan = physical(adjacency.attach(one).groupBy("dst").agg(F.sum("x")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # state by id, messages of round one, messages of round two; the edges are in neither
    assert plan.count("Exchange hashpartitioning") == 3
    assert plan.count("Sort [src") == 0
