"""Personalised rank of many seeds at once, and scaling of scores.

A seed starts with mass 1 on its own node. Mass that waits at a node is pushed: a share 1 - damping stays as the node's score, the rest goes along the out-edges by
weight; at a node without out-edges it goes back to the seed. Only mass above the tolerance is pushed, so a seed's state has one row per
node that its mass has reached, never one per node of the graph. Score and waiting mass of a seed always add up to 1, so what waits at the
end (at most tolerance x rows) bounds the error.

All seeds share the rounds: one join with the stored edges, in which hot nodes are spread over slots, one sum with partial aggregates, and joins with
bucketed tables of earlier rounds, which stay where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.graph import Adjacency, Graph
from quillgraph.session import cut_bucketed, forget


def _shares(graph: Graph) -> DataFrame:
    """src, dst, share of the source's out-weight; a node that passes nothing on has one edge to null."""
    used = graph.edges.filter("weight > 0")
    total = used.groupBy("src").agg(F.sum("weight").alias("total"))
    ends = graph.nodes.select(F.col("id").alias("src")).distinct().join(total, "src", "left_anti")
    passed = used.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    return passed.unionByName(ends.select("src", F.lit(None).cast(dict(passed.dtypes)["dst"]).alias("dst"), F.lit(1.0).alias("share")))


#: Tables of rounds that a round meets at most.
MERGE_AFTER = 8


class _Push:
    """Rounds of pushes. A round's table has the rows that got mass in it (seed, id, waiting, score), waiting with all that was left there before.

    What is above the tolerance after a round is pushed in the next, so a later table tells all about a row, and older ones stay as they are: nothing but mass
    that was sent moves. The tables are bucketed by seed and id, so the rows sent meet them without moving them. After MERGE_AFTER rounds the
    older tables are added up to one.
    """

    def __init__(self, graph: Graph, seeds: DataFrame, damping: float, tolerance: float):
        graph = graph.stored()
        self.adjacency = Adjacency(_shares(graph), "src")
        self.damping, self.tolerance = damping, tolerance
        self.parts = int(graph.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        known = seeds.select("seed").distinct().join(graph.nodes.select(F.col("id").alias("seed")), "seed", "left_semi")
        self.tables = [self._keep(known.select("seed", F.col("seed").alias("id"), F.lit(1.0).alias("waiting"), F.lit(0.0).alias("score")))]

    def _keep(self, rows: DataFrame) -> DataFrame:
        return cut_bucketed(rows, self.parts, "seed", "id")

    def _above(self) -> Column:
        return F.col("waiting") > self.tolerance

    def _rest(self, column: str = "waiting") -> Column:
        """What waits after the next round's push; null where there is no row."""
        return F.when(F.col(column) > self.tolerance, 0.0).otherwise(F.col(column))

    def advance(self) -> bool:
        """Push what is above the tolerance; whether there was anything."""
        moving = self.tables[-1].filter(self._above())
        if moving.isEmpty():
            return False
        self._merge_older()
        met = self.adjacency.attach(moving.select("seed", "id", "waiting")).select(
            "seed", F.coalesce("dst", "seed").alias("id"), (F.lit(self.damping) * F.col("waiting") * F.col("share")).alias("got")).groupBy("seed", "id").agg(F.sum("got").alias("got"))
        names = [f"before{i}" for i in range(len(self.tables))]
        for name, table in zip(names, self.tables):
            met = met.join(table.select("seed", "id", F.col("waiting").alias(name)), ["seed", "id"], "left")
        left = F.coalesce(*[self._rest(name) for name in reversed(names)], F.lit(0.0))
        self.tables.append(self._keep(met.select("seed", "id", (F.col("got") + left).alias("waiting"), F.lit(0.0).alias("score"))))
        return True

    def _merge_older(self) -> None:
        if len(self.tables) <= MERGE_AFTER:
            return
        merged = self._keep(self._added(self.tables[:-1]))
        for table in self.tables[:-1]:
            forget(table)
        self.tables = [merged, self.tables[-1]]

    def _added(self, tables: list[DataFrame]) -> DataFrame:
        """seed, id, waiting, score after all of these tables' pushes."""
        pushed = F.when(self._above(), F.lit(1.0 - self.damping) * F.col("waiting")).otherwise(0.0)
        rows = [table.select("seed", "id", self._rest().alias("waiting"), (F.col("score") + pushed).alias("score"), F.lit(i).alias("turn")) for i, table in enumerate(tables)]
        return reduce(DataFrame.unionByName, rows).groupBy("seed", "id").agg(F.max_by("waiting", "turn").alias("waiting"), F.sum("score").alias("score"))

    def state(self) -> DataFrame:
        """seed, id, score, waiting; the last round's mass isn't pushed."""
        last = self.tables[-1].select("seed", "id", F.col("waiting").alias("last"))
        if len(self.tables) == 1:
            return last.select("seed", "id", F.lit(0.0).alias("score"), F.col("last").alias("waiting"))
        both = self._added(self.tables[:-1]).join(last, ["seed", "id"], "full")
        return both.select("seed", "id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("last", "waiting").alias("waiting"))

    def scores(self) -> DataFrame:
        """seed, id, score where there is one, after a push of what is above the tolerance."""
        pushed = F.col("score") + F.when(self._above(), F.lit(1.0 - self.damping) * F.col("waiting")).otherwise(0.0)
        rows = [table.select("seed", "id", pushed.alias("score")).filter("score > 0") for table in self.tables]
        return reduce(DataFrame.unionByName, rows).groupBy("seed", "id").agg(F.sum("score").alias("score"))


def push(graph: Graph, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """seed, id, score, waiting: every node that mass of a seed has reached. `seeds` has column seed; unknown seeds are left out.

    Ends after `rounds`, or when no node holds more than `tolerance` of a seed's mass.
    """
    run = _Push(graph, seeds, damping, tolerance)
    for _ in range(rounds):
        if not run.advance():
            break
    return run.state()


def personalised_rank(graph: Graph, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """seed, id, score of the nodes with a score. What the last round sends has no part in the scores and isn't sent."""
    run = _Push(graph, seeds, damping, tolerance)
    for _ in range(rounds - 1):
        if not run.advance():
            break
    return run.scores().filter(F.lit(rounds > 0))


SCALERS = ("min_max", "max", "mean", "log", "standard", "l1", "l2", "center")


def scale(scores: DataFrame, how: str, column: str = "score", within: tuple[str, ...] = (), offset: float = 0.0) -> DataFrame:
    """`scores` with the column scaled, over all rows or per group: one aggregate, joined back.

    min_max: to 0..1. max: by the largest absolute value. mean: (x - mean) / (max - min). log: ln(x + offset), null where that isn't defined.
    standard: by mean and population deviation. l1, l2: by the norm. center: minus the mean. Without spread or norm the result is 0; null stays null.
    """
    x = F.col(column).cast("double")
    if how == "log":
        return scores.withColumn(column, F.when(x + offset > 0, F.log(x + offset)))
    sums: dict[str, tuple[dict[str, Column], Column]] = {
        "min_max": ({"lo": F.min(x), "hi": F.max(x)}, (x - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))),
        "max": ({"hi": F.max(F.abs(x))}, x / F.nullif(F.col("hi"), F.lit(0.0))),
        "mean": ({"lo": F.min(x), "hi": F.max(x), "mid": F.avg(x)}, (x - F.col("mid")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))),
        "standard": ({"mid": F.avg(x), "dev": F.stddev_pop(x)}, (x - F.col("mid")) / F.nullif(F.col("dev"), F.lit(0.0))),
        "l1": ({"norm": F.sum(F.abs(x))}, x / F.nullif(F.col("norm"), F.lit(0.0))),
        "l2": ({"norm": F.sqrt(F.sum(x * x))}, x / F.nullif(F.col("norm"), F.lit(0.0))),
        "center": ({"mid": F.avg(x)}, x - F.col("mid")),
    }
    if how not in sums:
        raise ValueError(f"unknown scaler {how}")
    parts, value = sums[how]
    if within:
        whole = scores.groupBy(*within).agg(*[c.alias(n) for n, c in parts.items()])
        match = [F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}")) for c in within]
        joined = scores.alias("s").join(whole.alias("w"), match, "left").select("s.*", *[F.col(f"w.{n}").alias(n) for n in parts])
    else:
        joined = scores.join(F.broadcast(scores.agg(*[c.alias(n) for n, c in parts.items()])))  # one row
    return joined.withColumn(column, F.when(x.isNotNull(), F.coalesce(value, F.lit(0.0)))).select(*scores.columns)
