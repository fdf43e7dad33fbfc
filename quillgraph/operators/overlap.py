"""Pairs of nodes whose neighbour sets have a Jaccard coefficient of at least a threshold, without comparing all pairs.

`sets` has one row per (owner, element). Owners of equal sets are one class, found by size and two hashes that add up over the elements, so
a million nodes that cite the same works are one row. Elements are ordered from rare to frequent. Sets with o common elements share one of their
first size - o + 1 elements, so classes are joined on these prefixes only, with bounds on sizes and on what can still be common behind the shared
element; candidates are then counted exactly, by rows and never in a cell. A pair meets once for each element that both prefixes hold, so few of these
leave too little room for what is behind the prefixes: most pairs that share an element are dropped when these meetings are added up, before their sets are looked up.

Hubs: an element in the prefixes of too many sets (more than `most` candidates) isn't joined by itself. Pairs for which it suffices alone are true
pairs; they are met by their exact sizes. All others share a second element of a prefix one longer, so the key grows by an element, and so on.
A hub's sets are never paired with each other unless the pair is in the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut

MOST = 50_000
#: A key grows only where its pairs are this many times the rows that growing makes; a family of large, nearly equal sets is joined as it is.
GAIN = 4


def ancestors(edges: DataFrame) -> DataFrame:
    """owner, element: the works an article cites."""
    return edges.select(F.col("src").alias("owner"), F.col("dst").alias("element")).distinct()


def children(edges: DataFrame) -> DataFrame:
    """owner, element: the articles that cite a work."""
    return edges.select(F.col("dst").alias("owner"), F.col("src").alias("element")).distinct()


def ancestors_of_children(edges: DataFrame) -> DataFrame:
    """owner, element: what else the articles cite that cite a work."""
    other = edges.select("src", F.col("dst").alias("element"))
    return edges.select("src", F.col("dst").alias("owner")).join(other, "src").filter("owner <> element").select("owner", "element").distinct()


def classes(sets: DataFrame) -> DataFrame:
    """owner, rep, size, copies: owners with equal sets have one representative, the least of them. `sets` has distinct rows."""
    signed = cut(sets.groupBy("owner").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("element")).alias("h"), F.bit_xor(F.xxhash64("element", F.lit(1))).alias("k")))
    least = signed.groupBy("size", "h", "k").agg(F.min("owner").alias("rep"), F.count("*").alias("copies"))
    return signed.join(least, ["size", "h", "k"]).select("owner", "rep", "size", "copies")


def _needed(threshold: float, size: Column) -> Column:
    """Common elements that a set of this size needs with any partner."""
    return F.ceil(F.lit(threshold) * size - 1e-9).cast("int")


def _enough(threshold: float, a: str, b: str) -> Column:
    """Common elements that two sets need."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (F.col(a) + F.col(b)) - 1e-9).cast("int")


def similar_sets(sets: DataFrame, threshold: float = 0.5, most: int = MOST) -> DataFrame:
    """a, b, size_a, size_b, common, jaccard: pairs a < b of class representatives with a coefficient of at least `threshold`; see `classes` for their members."""
    sets = cut(sets)
    reps = cut(classes(sets).filter("owner = rep").select("owner", F.col("size").cast("int").alias("size")))
    members = cut(sets.join(reps, "owner"))
    often = members.groupBy("element").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy("often", "element"))
    ordered = cut(members.join(often, "element").withColumn("place", place).select("owner", "size", "element", "place"))
    reach = lambda level: F.col("size") - _needed(threshold, F.col("size")) + level
    rows = cut(ordered.filter(F.col("place") <= reach(1)).select("owner", "size", F.array("element").alias("key"), "place"))
    level, found = 1, None
    while True:
        load = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(reach(level + 1) - F.col("place")).alias("more"))
        hot = cut(load.filter((F.col("n") * F.col("n") > most) & (F.col("n") * F.col("n") > GAIN * F.col("more"))).select("key"))
        some = not hot.isEmpty()
        cold = rows.join(hot, "key", "left_anti") if some else rows
        pairs = _sized(_roomy(cold, threshold), reps) if level == 1 else _candidates(cold, threshold, level)
        if some:
            full = cut(rows.join(hot, "key", "left_semi"))
            pairs = pairs.unionByName(_small(full, threshold, level))
        pairs = cut(pairs.distinct())
        found = pairs if found is None else found.unionByName(pairs)
        if not some:
            break
        more = ordered.filter(F.col("place") <= reach(level + 1)).select("owner", "element", F.col("place").alias("next"))
        rows = cut(full.join(more, "owner").filter("next > place").select("owner", "size", F.concat("key", F.array("element")).alias("key"), F.col("next").alias("place")))
        level += 1
    return _counted(found.distinct(), members, threshold)


def _sided(rows: DataFrame, s: str) -> DataFrame:
    return rows.select("key", F.col("owner").alias(s), F.col("size").alias(f"size_{s}"), F.col("place").alias(f"place_{s}"))


def _candidates(rows: DataFrame, threshold: float, level: int) -> DataFrame:
    """Pairs of one key that can still reach what they need."""
    a, b = _sided(rows, "a"), _sided(rows, "b")
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    fits = (F.col("a") < F.col("b")) & (F.col("size_a") >= _needed(threshold, F.col("size_b"))) & (F.col("size_b") >= _needed(threshold, F.col("size_a")))
    return a.join(b, "key").filter(fits & (level + left >= _enough(threshold, "size_a", "size_b"))).select("a", "b", "size_a", "size_b")


def _roomy(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs that can reach what they need, by the number of elements they share among `rows`, the first ones of each set.

    Elements are in one order, so whichever of two sets ends its rows first shares nothing else but its elements without a row.
    """
    kept = rows.groupBy("owner").agg(F.count("*").alias("kept"))
    rested = rows.join(kept, "owner").select("key", "owner", "size", (F.col("size") - F.col("kept")).alias("rest"))
    a, b = (rested.select("key", F.col("owner").alias(s), F.col("size").alias(f"size_{s}"), F.col("rest").alias(f"rest_{s}")) for s in "ab")
    fits = (F.col("a") < F.col("b")) & (F.col("size_a") >= _needed(threshold, F.col("size_b"))) & (F.col("size_b") >= _needed(threshold, F.col("size_a")))
    least = (_enough(threshold, "size_a", "size_b") - F.greatest("rest_a", "rest_b")).cast("int")
    met = a.join(b, "key").filter(fits).groupBy("a", "b").agg(F.count("*").alias("met"), F.max(least).alias("least"))
    return met.filter("met >= least").select("a", "b")


def _sized(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    for s in "ab":
        pairs = pairs.join(reps.select(F.col("owner").alias(s), F.col("size").alias(f"size_{s}")), s)
    return pairs.select("a", "b", "size_a", "size_b")


def _small(rows: DataFrame, threshold: float, level: int) -> DataFrame:
    """Pairs of one key that need no more than the `level` elements of the key: every one is in the result."""
    both = math.floor(level * (1 + threshold) / threshold + 1e-9)
    a = _sided(rows.filter(F.col("size") < both), "a").withColumn("size_b", F.explode(F.sequence(F.lit(1), F.lit(both) - F.col("size_a"))))
    pairs = a.join(_sided(rows, "b"), ["key", "size_b"]).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("size_a")).otherwise(F.col("size_b")).alias("size_a"),
                        F.when(F.col("a") < F.col("b"), F.col("size_b")).otherwise(F.col("size_a")).alias("size_b"))


def _counted(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Exact coefficients: the elements of the smaller set are looked up in the larger one."""
    swapped = F.col("size_a") > F.col("size_b")
    named = pairs.withColumn("small", F.when(swapped, F.col("b")).otherwise(F.col("a"))).withColumn("large", F.when(swapped, F.col("a")).otherwise(F.col("b")))
    elements = named.join(members.select(F.col("owner").alias("small"), "element"), "small")
    both = elements.join(members.select(F.col("owner").alias("large"), "element"), ["large", "element"])
    counted = both.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("common"))
    jaccard = F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
    return counted.withColumn("jaccard", jaccard).filter(F.col("jaccard") >= threshold - 1e-12)
