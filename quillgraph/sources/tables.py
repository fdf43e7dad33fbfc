"""The scholarly data model over the given Parquet tables.

Each function returns a lazy frame; Catalyst prunes columns down to the scan.
The integer weights and ids keep results identical between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KNOWN_UNTIL = 1999
EVALUATION_YEAR = 2000
RUNS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, category, year, known_category (null after the last labelled year)."""
    category = F.expr("CAST(substr(p_brand, 7) AS INT)")
    year = F.lit(1995) + F.col("p_size") % 7
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        category.alias("category"),
        year.alias("year"),
        F.when(year <= KNOWN_UNTIL, category).alias("known_category"),
    )


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: consecutive lines of one order cite each other.

    The join key is (order, line number), so even an order holding a large share of all rows
    spreads over its line numbers.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    here = lines.select("l_orderkey", F.col("l_partkey").alias("src"), (F.col("l_linenumber") + 1).alias("line"))
    after = lines.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("line"))
    return (
        here.join(after, ["l_orderkey", "line"])
        .filter("src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("weight"))
    )


def has_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, topic, weight."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("topic"))
        .agg(F.sum("l_quantity").alias("weight"))
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, year, category, run, cluster, consensus for three clustering runs."""
    runs = articles(spark, sf_dir).select(
        "id", "year", "category", F.explode(F.array(*[F.lit(r) for r in range(RUNS)])).alias("run")
    )
    own = F.col("category")
    shifted = F.col("id") + F.col("run")
    return runs.select(
        "id",
        "year",
        "category",
        "run",
        F.when(shifted % 13 == 0, None).otherwise(own * 2 + F.col("id") % 2).alias("cluster"),
        F.when(shifted % 11 == 0, None)
        .when((F.col("id") * 7 + F.col("run")) % 5 == 0, own % 25 + 1)
        .otherwise(own)
        .alias("consensus"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, year, language, category, text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        (F.lit(2015) + F.col("doc_id") % 5).alias("year"),
        F.col("lang").alias("language"),
        F.col("source").alias("category"),
        "text",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding, category."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").alias("category")
    )


def vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst among the vectors."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"))
    n = ids.agg(F.count("*")).scalar()
    return ids.withColumn("dst", (F.col("src") * 7 + 3) % n).filter("src <> dst")


# The same views for the SQL side of the checks.
VIEWS = {
    "articles": """
SELECT p_partkey AS id, p_name AS title, CAST(substr(p_brand, 7) AS INT) AS category, 1995 + p_size % 7 AS year,
       CASE WHEN 1995 + p_size % 7 <= 1999 THEN CAST(substr(p_brand, 7) AS INT) END AS known_category
FROM part""",
    "cites": """
SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight
FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey
GROUP BY a.l_partkey, b.l_partkey""",
    "has_topic": """
SELECT l_partkey AS id, l_suppkey AS topic, sum(l_quantity) AS weight FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "clusters": """
SELECT a.id, a.year, a.category, r.run,
       CASE WHEN (a.id + r.run) % 13 = 0 THEN NULL ELSE a.category * 2 + a.id % 2 END AS cluster,
       CASE WHEN (a.id + r.run) % 11 = 0 THEN NULL
            WHEN (a.id * 7 + r.run) % 5 = 0 THEN a.category % 25 + 1
            ELSE a.category END AS consensus
FROM articles a CROSS JOIN (SELECT 0 AS run UNION ALL SELECT 1 UNION ALL SELECT 2) r""",
    "docs": """
SELECT doc_id AS id, 2015 + doc_id % 5 AS year, lang AS language, source AS category, text FROM documents""",
    "vectors": "SELECT vec_id AS id, embedding, label AS category FROM embeddings",
    "vector_edges": """
SELECT e.vec_id AS src, (e.vec_id * 7 + 3) % n.c AS dst
FROM embeddings e CROSS JOIN (SELECT count(*) AS c FROM embeddings) n
WHERE e.vec_id <> (e.vec_id * 7 + 3) % n.c""",
}
VIEW_NEEDS = {"clusters": ("articles",)}
