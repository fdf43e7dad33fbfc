"""Agreement of clusterings, from contingency tables of pairs of runs.

`assigned` has run, id, cluster. A row without a cluster in one of the two runs is left out of that pair, or (`null_is_cluster`) the null
clusters are a cluster of their own. Rows meet once on their id and are counted with partial sums; all measures
come from the counts. Pairs of rows are counted exactly in decimals of 38 digits: n^2 of 1e10 rows overflows 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut


def contingency(assigned: DataFrame, null_is_cluster: bool = False) -> DataFrame:
    """run_a, run_b, a, b, n: rows that run_a puts into a and the later run_b into b; a and b are structs, so null is a value."""
    rows = assigned if null_is_cluster else assigned.filter("cluster IS NOT NULL")
    side = lambda s: rows.select("id", F.col("run").alias(f"run_{s}"), F.struct("cluster").alias(s))
    return side("a").join(side("b"), "id").filter("run_a < run_b").groupBy("run_a", "run_b", "a", "b").agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    n = n.cast("decimal(19,0)")
    return (n * (n - F.lit(1).cast("decimal(1,0)"))).cast("decimal(38,0)")


def _n_log_n(n: Column) -> Column:
    return n * F.log(n)


def agreement(table: DataFrame) -> DataFrame:
    """run_a, run_b, rows, rand, adjusted_rand, pair_jaccard, mutual_information, normalised_mutual_information, homogeneity, completeness.

    Homogeneity and completeness take run_a as the truth. Pairs of rows are ordered ones (twice the usual number, which cancels). Two clusterings that leave nothing to agree on (fewer than two rows, or both trivial) score 1.
    """
    table = cut(table)
    runs = ["run_a", "run_b"]
    cells = table.groupBy(*runs).agg(F.sum("n").alias("rows"), F.sum(_pairs(F.col("n"))).cast("decimal(38,0)").alias("both"), F.sum(_n_log_n(F.col("n"))).alias("hab"))

    def margin(side: str) -> DataFrame:
        sums = table.groupBy(*runs, side).agg(F.sum("n").alias("n"))
        return sums.groupBy(*runs).agg(F.sum(_pairs(F.col("n"))).cast("decimal(38,0)").alias(f"in_{side}"), F.sum(_n_log_n(F.col("n"))).alias(f"h{side}"))

    one = cells.join(margin("a"), runs).join(margin("b"), runs)
    every = _pairs(F.col("rows"))
    # in doubles from here on: exact counts, then ratios
    total, both, in_a, in_b = (c.cast("double") for c in (every, F.col("both"), F.col("in_a"), F.col("in_b")))
    apart = (every + F.col("both") + F.col("both") - F.col("in_a") - F.col("in_b")).cast("double")
    union = (F.col("in_a") + F.col("in_b") - F.col("both")).cast("double")
    expected = F.try_divide(in_a * in_b, total)
    log_n = F.log("rows")

    def entropy(c: str) -> Column:
        h = log_n - F.col(c) / F.col("rows")
        return F.when(h > 1e-12, h).otherwise(0.0)

    ha, hb = entropy("ha"), entropy("hb")
    mutual = F.greatest(ha + hb - entropy("hab"), F.lit(0.0))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(1.0))
    return one.select(
        *runs, "rows", ratio(apart, total).alias("rand"), ratio(both - expected, (in_a + in_b) / 2 - expected).alias("adjusted_rand"), ratio(both, union).alias("pair_jaccard"),
        mutual.alias("mutual_information"), ratio(mutual, (ha + hb) / 2).alias("normalised_mutual_information"), ratio(mutual, ha).alias("homogeneity"),
        ratio(mutual, hb).alias("completeness"))
