"""Relational exploration of the citation graph: joins of edges with article attributes, and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_end(edges: DataFrame, nodes: DataFrame, end: str, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Add `<end>_<column>` from the node at one end of each edge."""
    side = nodes.select(F.col("id").alias(f"__{end}"), *[F.col(c).alias(f"{end}_{c}") for c in columns])
    return edges.join(side, edges[end] == side[f"__{end}"], how).drop(f"__{end}")


def with_ends(edges: DataFrame, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    return with_end(with_end(edges, nodes, "src", columns), nodes, "dst", columns)


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected match: every edge seen from either end (src, dst only)."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def cross_category_counts(edges: DataFrame, nodes: DataFrame, years: Sequence[str] = ()) -> DataFrame:
    """cited_category, citing_category[, years], citations between different categories.

    `years` may hold "dst_year" (cited) and "src_year" (citing).
    """
    ends = with_ends(edges, nodes, ["category", "year"]).filter("src_category <> dst_category")
    return ends.groupBy(
        F.col("dst_category").alias("cited_category"), F.col("src_category").alias("citing_category"), *years
    ).agg(F.count("*").alias("citations"))


def neighbouring_categories(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """id, connected_categories: distinct other categories met across the edges of the node at `end`."""
    ends = with_ends(edges, nodes, ["category"]).filter("src_category <> dst_category")
    other = "src" if end == "dst" else "dst"
    return ends.groupBy(F.col(end).alias("id")).agg(F.countDistinct(f"{other}_category").alias("connected_categories"))


def cumulative_year_sizes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """year, nodes, edges of the subgraph of articles up to each year.

    An edge enters in the later year of its ends, so one pass serves all years; the running sum is
    over one row per year.
    """
    n = nodes.filter("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n")).withColumn("m", F.lit(0))
    ends = with_ends(edges, nodes, ["year"])
    m = ends.groupBy(F.greatest("src_year", "dst_year").alias("year")).agg(F.count("*").alias("m")).withColumn("n", F.lit(0))
    yearly = n.unionByName(m).groupBy("year").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    upto = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return yearly.select("year", F.sum("n").over(upto).alias("nodes"), F.sum("m").over(upto).alias("edges"))


def threshold_profile(df: DataFrame, value: str, thresholds: Sequence[int]) -> DataFrame:
    """threshold, rows_above, share: one conditional pass instead of a scan per threshold."""
    above = [F.sum(F.when(F.col(value) > t, 1).otherwise(0)).alias(f"t{t}") for t in thresholds]
    wide = df.agg(F.count("*").alias("total"), *above)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("rows_above")) for t in thresholds
    ]))
    return wide.select("total", pairs.alias("p")).select(
        "p.threshold", "p.rows_above", F.try_divide(F.col("p.rows_above").cast("double"), F.col("total")).alias("share")
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (1..bins, 0 below, bins+1 from `high` on), rows."""
    return df.filter(F.col(value).isNotNull()).groupBy(
        F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int").alias("bin")
    ).agg(F.count("*").alias("rows"))


def rmse(left: DataFrame, right: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """One row: root mean square difference over the rows of `left`; a key missing on the right counts as 0."""
    other = right.select(*key, F.col(value).alias("__other"))
    gap = F.col(value) - F.coalesce(F.col("__other"), F.lit(0.0))
    return left.join(other, list(key), "left").agg(F.sqrt(F.avg(F.pow(gap, F.lit(2)))).alias("rmse"))


def lookup(df: DataFrame, names: dict[int, str], code: str, out: str, default: str) -> DataFrame:
    """Code to name by a literal map; codes without a name get `default`."""
    pairs: list[Column] = []
    for k, v in names.items():
        pairs += [F.lit(k), F.lit(v)]
    table = F.create_map(*pairs)
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(code)), F.lit(default)))
