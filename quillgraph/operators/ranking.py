"""Ordering helpers that never put a whole group into one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 200_000
MAX_BUCKETS = 20_000


def range_buckets(df: DataFrame, order: str, name: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add an order-preserving bucket number with about `rows_per_bucket` rows each.

    The bounds are approximate quantiles of the key, so the bucket is a pure function of the key and
    stays the same when a lost task is run again. `order` must be numeric and (nearly) unique.
    """
    rows = df.agg(F.count(order).alias("n")).first()["n"]
    buckets = min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket)) if rows else 1
    if buckets <= 1:
        return df.withColumn(name, F.lit(0))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.approxQuantile(order, shares, 0.1 / buckets)))
    key = f"__{name}"
    cutter = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=key, outputCol=name)
    return cutter.transform(df.withColumn(key, F.col(order).cast("double"))).drop(key).withColumn(name, F.col(name).cast("int"))


def number_rows(df: DataFrame, order: str, within: Sequence[str] = (), name: str = "rn",
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """1-based position in `order` (unique numeric key) inside each group.

    Rows are numbered inside (group, range bucket), then shifted by the number of rows in earlier
    buckets of the group. A group that holds most rows is spread over its buckets.
    """
    within = list(within)
    cut_up = range_buckets(df, order, "__bucket", rows_per_bucket)
    groups = [F.col(c) for c in within] or [F.lit(0)]
    local = cut_up.withColumn(
        "__local", F.row_number().over(Window.partitionBy(*within, "__bucket").orderBy(order))
    )
    sizes = cut_up.groupBy(*within, "__bucket").agg(F.count("*").alias("__size"))
    before = (
        Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = sizes.select(
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(within)],
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__shift"),
    )
    match = F.col("__bucket") == F.col("__b")
    for i, c in enumerate(within):
        match = match & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return local.join(shift, match).select(
        *df.columns, (F.col("__shift") + F.col("__local")).alias(name)
    )


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First `k` rows of each group.

    The rank filter lets Catalyst keep at most `k` rows per group and task before the shuffle
    (WindowGroupLimit), so a hot group costs k rows per map task and not its whole size.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


SAMPLE_MODULUS = 2147483647
SAMPLE_FACTOR = 1103515245
SAMPLE_SHIFT = 12345


def sample_key(id_col: str | Column, seed: int) -> Column:
    """Deterministic shuffle key of an integer id; plain modular arithmetic, so SQL can repeat it."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(
        F.pmod(col, F.lit(SAMPLE_MODULUS)) * F.lit(SAMPLE_FACTOR) + F.lit((seed + 1) * SAMPLE_SHIFT), F.lit(SAMPLE_MODULUS)
    )


def sample_per_group(df: DataFrame, group: Sequence[str], id_col: str, k: int, seed: int = 0) -> DataFrame:
    """`k` pseudo-random rows per group, the same ones on every run."""
    keyed = df.withColumn("__key", sample_key(id_col, seed))
    return top_per_group(keyed, group, [F.col("__key"), F.col(id_col)], k, "__rank").drop("__key", "__rank")


def exact_quantile_rows(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row `value`: the exact quantile with linear interpolation, from a histogram of values.

    Equal values are counted first; the running count goes over range buckets of the distinct values.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    parts = range_buckets(hist, "v", "__b")
    sizes = parts.groupBy("__b").agg(F.sum("c").alias("__s"))
    start = sizes.select(
        F.col("__b").alias("__sb"),
        F.coalesce(
            F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__start"),
        F.sum("__s").over(Window.partitionBy(F.lit(0))).alias("__n"),
    )
    running = parts.withColumn("__run", F.sum("c").over(Window.partitionBy("__b").orderBy("v"))).join(
        start, F.col("__b") == F.col("__sb")
    )
    spot = (F.col("__n") - 1) * F.lit(share)
    last = F.col("__start") + F.col("__run") - 1
    first = last - F.col("c") + 1
    low, high = F.floor(spot), F.ceil(spot)
    return running.agg(
        F.max(F.when((first <= low) & (low <= last), F.col("v"))).alias("lo"),
        F.max(F.when((first <= high) & (high <= last), F.col("v"))).alias("hi"),
        F.max(spot - low).alias("part"),
    ).select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias(value))
