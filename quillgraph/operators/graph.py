"""Graph = nodes(id) + edges(src, dst, weight); projection, degrees, quality checks, message passing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut, keep_partitioned

NATURAL, REVERSE, UNDIRECTED = "natural", "reverse", "undirected"


@dataclass(frozen=True)
class Graph:
    """A projected graph. Extra node columns are kept; edges always have src, dst, weight (double)."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> "Graph":
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        return Graph(nodes, edges.select("src", "dst", w.alias("weight")))

    def stored(self) -> "Graph":
        """The same graph with its edges written once, for operators that read them several times."""
        return Graph(self.nodes, cut(self.edges))

    def oriented(self, orientation: str = NATURAL) -> DataFrame:
        """Edges as stored, turned round, or both (an undirected projection doubles the rows)."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        if orientation == NATURAL:
            return self.edges
        if orientation == REVERSE:
            return back
        if orientation == UNDIRECTED:
            return self.edges.unionByName(back)
        raise ValueError(f"unknown orientation {orientation}")

    def subgraph(self, node_filter: Column | str | None = None, edge_filter: Column | str | None = None) -> "Graph":
        """Induced subgraph: kept nodes, and kept edges with both ends kept."""
        nodes = self.nodes.filter(node_filter) if node_filter is not None else self.nodes
        edges = self.edges.filter(edge_filter) if edge_filter is not None else self.edges
        return Graph(nodes, restrict_edges(edges, nodes))

    def undirected_pairs(self, sum_weights: bool = True) -> DataFrame:
        """Each unordered pair once (a < b), loops dropped; weights of parallel edges added."""
        pairs = self.edges.filter("src <> dst").select(
            F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight"
        )
        return pairs.groupBy("a", "b").agg((F.sum("weight") if sum_weights else F.lit(1.0)).alias("weight"))


def restrict_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both in `nodes`."""
    ids = nodes.select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def degrees(graph: Graph, orientation: str = NATURAL, weighted: bool = False) -> DataFrame:
    """id, degree; 0 for isolated nodes. NATURAL counts outgoing edges."""
    measure = F.sum("weight") if weighted else F.count("*")
    counted = graph.oriented(orientation).groupBy(F.col("src").alias("id")).agg(measure.alias("degree"))
    zero = F.lit(0.0) if weighted else F.lit(0)
    return graph.nodes.select("id").join(counted, "id", "left").withColumn("degree", F.coalesce("degree", zero))


def all_degrees(graph: Graph) -> DataFrame:
    """id, out_degree, in_degree, degree from one pass over the edges and one shuffle."""
    ends = graph.edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("e")).select("e.*")
    none = graph.nodes.select("id", F.lit(0).alias("o"), F.lit(0).alias("i"))
    total = none.unionByName(ends).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return total.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def degree_distribution(graph: Graph, orientation: str = NATURAL) -> DataFrame:
    """degree, nodes."""
    return degrees(graph, orientation).groupBy("degree").agg(F.count("*").alias("nodes"))


def graph_stats(graph: Graph) -> DataFrame:
    """One row: node and edge counts, density, mean degree, least and greatest out-degree."""
    n = graph.nodes.agg(F.count("*")).scalar()
    m = graph.edges.agg(F.count("*")).scalar()
    return degrees(graph).agg(
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree")
    ).select(
        n.alias("nodes"), m.alias("edges"), (m / (n * (n - 1))).alias("density"), "mean_degree", "min_degree", "max_degree"
    )


# ---------------------------------------------------------------- quality checks

def duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("copies")).filter("copies > 1")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src = dst")


def reciprocal_edges(edges: DataFrame) -> DataFrame:
    """Edges whose reverse also exists."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return edges.join(back, ["src", "dst"], "left_semi")


def without_out_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def without_in_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return without_in_edges(without_out_edges(nodes, edges), edges)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def quality_report(graph: Graph) -> DataFrame:
    """check, found: one row per structural check."""
    graph = graph.stored()
    checks = {
        "duplicate_edges": duplicate_edges(graph.edges),
        "self_loops": self_loops(graph.edges),
        "reciprocal_edges": reciprocal_edges(graph.edges),
        "no_out_edges": without_out_edges(graph.nodes, graph.edges),
        "no_in_edges": without_in_edges(graph.nodes, graph.edges),
        "isolated": isolated_nodes(graph.nodes, graph.edges),
        "repeated_ids": repeated_keys(graph.nodes, "id"),
    }
    rows = [df.agg(F.count("*").alias("found")).select(F.lit(n).alias("check"), "found") for n, df in checks.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


# ---------------------------------------------------------------- message passing

FEW_PARTITIONS = 16
ROWS_PER_PARTITION = 50_000


class Adjacency:
    """Edges partitioned and sorted once by one end, and reused in every round of an iteration.

    A merge join with a state then neither moves nor sorts the edges again. There are as many partitions as the session
    asks for, but no more than one per ROWS_PER_PARTITION rows (and FEW_PARTITIONS).

    A key with more edges than a partition's share of all rows is hot. Its edges get a slot number for each such
    share and are spread over slots; its state row is copied once per slot. There are fewer hot keys than partitions, so
    the hot list is bounded and safe to broadcast, and no slot holds more than about one share.
    """

    def __init__(self, edges: DataFrame, key: str):
        spark = edges.sparkSession
        self.key = key
        other = "dst" if key == "src" else "src"
        degree = cut(edges.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("c")))
        self.rows = degree.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = min(wanted, max(FEW_PARTITIONS, math.ceil(self.rows / ROWS_PER_PARTITION)))
        share = max(1, math.ceil(self.rows / parts))
        hot = degree.filter(F.col("c") > share).select("__hot", F.ceil(F.col("c") / share).cast("int").alias("__slots"))
        self.hot: DataFrame | None = None
        if not hot.isEmpty():
            self.hot = cut(hot)
            edges = edges.join(F.broadcast(self.hot), edges[key] == self.hot["__hot"], "left").withColumn(
                "__slot", F.pmod(F.xxhash64(other), F.coalesce("__slots", F.lit(1))).cast("int")).drop("__hot", "__slots")
        keys = [key] if self.hot is None else [key, "__slot"]
        self.edges = keep_partitioned(edges, parts, *keys)

    def attach(self, state: DataFrame, on: str = "id") -> DataFrame:
        """Join every edge with the state row of its key end (columns of both; `on` is dropped)."""
        state = state.withColumnRenamed(on, "__on")
        if self.hot is None:
            return state.join(self.edges, self.edges[self.key] == state["__on"]).drop("__on")
        copies = state.join(F.broadcast(self.hot), F.col("__on") == F.col("__hot"), "left").withColumn(
            "__copy", F.explode(F.sequence(F.lit(0), F.coalesce("__slots", F.lit(1)) - 1))
        ).drop("__hot", "__slots")
        hit = (self.edges[self.key] == copies["__on"]) & (self.edges["__slot"] == copies["__copy"])
        return copies.join(self.edges, hit).drop("__on", "__slot", "__copy")
