"""Mixing sources to target weights through histograms of hash buckets. Spark expressions only.

Each row gets a 60-bit number from a hash of its id and text. Tokens are summed by source and by the leading
BUCKET_BITS bits of that number; a running sum over those few buckets finds the bucket in which the source's
budget ends. Rows of smaller buckets are in, rows of larger ones are out, and only the rows of the boundary bucket are looked
at again, by their next bits, until the boundary is one hash value. The thresholds are nested: a larger budget
takes all that a smaller one takes. Nothing is sorted but the buckets, at most 2^BUCKET_BITS rows per source.

A source's target is its share by weight, at most `max_repeats` times its size; what is cut off is shared again by weight
among the others. A target above the source's size takes the whole source as often as it fits, and a part of it once more. The
row at the boundary is taken if that brings the sum nearer to the target, so a source misses its target by at
most half of that row's size (or of the tie group's).

Hot sources: the sums are pre-aggregated and spread over buckets. The table of thresholds has one row per source; Spark
broadcasts it if its measured size allows that and joins by a shuffle with skew handling otherwise.

Defined cases: a null text has size 0. A null source is a source of its own, the last one. Rows equal in id and text have equal
hashes and are taken together. Sources without words have target 0. An empty table gives an empty result. Extra columns, also
of clashing names, pass through `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD, free_name, store

HASH_BITS = 60
BUCKET_BITS = 10
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place_of(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash of id and text, the same in every engine."""
    own = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target from source and source_size (one row per source).

    Sources whose cap is low against their weight are capped first; the first source in that order that need not be
    capped fixes the level that it and all later ones get per unit of weight.
    """
    every = Window.partitionBy(F.lit(0))  # one row per source
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_repeats
    weighed = sizes.withColumn("w", weight.cast("bigint")).withColumn("cap", cap.cast("bigint"))
    order = every.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    leveled = weighed.withColumn("level", level)
    free = F.col("level") * F.col("w") <= F.col("cap")
    fixed = F.first(F.when(free, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("fixed", fixed).select(
        "source", "source_size",
        F.when(F.col("fixed").isNull(), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("fixed") * F.col("w"))).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, low, last: hashes below `low` are in, the hash `low` itself is in if `last`.

    rows: source, size, place. budgets: source, budget (less than the source's size, or the source is wholly out).
    """
    state = store(budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("bigint").alias("low"),
                                 F.lit(True).alias("open"), F.lit(False).alias("last")), "budgets")
    inside = rows
    for shift in range(HASH_BITS - BUCKET_BITS, -1, -BUCKET_BITS):
        bucket = F.shiftright("place", shift)
        sums = inside.groupBy(F.col("source").alias("s"), bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        run = sums.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
        joined = run.join(state.filter("open"), F.col("s").eqNullSafe(F.col("source")))
        edge = joined.filter("below <= left").groupBy("source").agg(F.max(F.struct("bucket", "below", "n")).alias("e"))
        edge = edge.select(F.col("source").alias("s"), "e.*")
        nearer = (F.col("left") - F.col("below")) * 2 > F.col("n")
        state = store(state.join(edge, F.col("s").eqNullSafe(F.col("source")), "left").select(
            "source", F.when(F.col("s").isNull(), F.col("left")).otherwise(F.col("left") - F.col("below")).alias("left"),
            F.coalesce(F.shiftleft("bucket", shift), "low").alias("low"),
            (F.col("open") & F.col("s").isNotNull()).alias("open"),
            (nearer if shift == 0 else F.lit(False)).alias("last")), "budgets")
        if shift == 0:
            break
        mine = state.filter("open").select(F.col("source").alias("s"), F.shiftright("low", shift).alias("b"))
        inside = store(inside.join(mine, F.col("s").eqNullSafe(F.col("source")) & (bucket == F.col("b")), "left_semi"), "boundary")
    return state.select("source", "low", F.coalesce("last", F.lit(False)).alias("last"))


def _rows(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return store(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"),
                             place_of(F.col(doc_id), F.col(text)).alias("place")), "sizes")


def _goals(rows: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """goal, source_size, target, whole, low, last: one row per source."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = store(targets(sums, weights, share, max_repeats), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    goal = goal.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    edges = thresholds(rows.select("source", "size", "place"), goal).withColumnRenamed("source", "goal")
    return store(goal.join(edges, F.col("goal").eqNullSafe(F.col("source"))).select(
        "goal", "source_size", "target", "whole", "low", "last"), "goals")


def copies(place: Column, max_repeats: int = MAX_REPEATS) -> Column:
    """How often a row is taken, from its place and its source's whole, low and last."""
    once = (place < F.col("low")) | ((place == F.col("low")) & F.col("last"))
    return F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.lit(max_repeats), F.col("whole") + once.cast("bigint"))).cast("bigint")


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per row of `docs`: doc_id, source, place, size, source_size, target, copies, taken."""
    rows = _rows(docs, doc_id, text, source)
    goals = _goals(rows, weights, share, max_repeats)
    return rows.join(goals, F.col("goal").eqNullSafe(F.col("source"))).withColumn("copies", copies(F.col("place"), max_repeats)).select(
        "doc_id", "source", "place", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixture: each row of `docs`, with all its columns, as often as it is taken; only thresholds are joined to the rows.

    Rows without words are taken by their hash like any other; a source without any words is left out.
    """
    goals = _goals(_rows(docs, doc_id, text, source), weights, share, max_repeats)
    names = {c: free_name(docs, f"mix_{c}") for c in docs.columns}
    packed = docs.select(F.struct(*[F.col(c).alias(n) for c, n in names.items()]).alias("row"), F.col(source).alias("own_source"),
                         place_of(F.col(doc_id), F.col(text)).alias("own_place"))
    joined = packed.join(goals, F.col("goal").eqNullSafe(F.col("own_source")))
    taken = joined.select("row", F.explode(F.array_repeat(F.lit(0), copies(F.col("own_place"), max_repeats).cast("int"))))
    return taken.select(*[F.col("row")[n].alias(c) for c, n in names.items()])
