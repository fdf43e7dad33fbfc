"""Rank-style centralities: repeated passes of messages along the edges.

Every pass is one co-partitioned join with the stored edges and one partially aggregated shuffle.
Each node also sends itself a zero message, so nodes without incoming edges stay in the state and
the state is read once per pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.graph import Adjacency, Graph
from quillgraph.session import cut, forget

PASSES_PER_CUT = 5


def with_self(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Edges plus one zero-valued self edge per node."""
    own = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias(value))
    return edges.select("src", "dst", value).unionByName(own)


def _propagate(adjacency: Adjacency, state: DataFrame, value: str, to: str) -> DataFrame:
    """Sum of value * share arriving at the `to` end."""
    sent = adjacency.attach(state).select(F.col(to).alias("id"), (F.col(value) * F.col("share")).alias("__m"))
    return sent.groupBy("id").agg(F.sum("__m").alias(value))


def _rank(graph: Graph, shares: DataFrame, damping: float, iterations: int, tolerance: float | None) -> DataFrame:
    base = 1.0 - damping
    adjacency = Adjacency(with_self(shares, graph.nodes, "share"), "src")
    kept = state = graph.nodes.select("id", F.lit(base).alias("score"))
    for i in range(1, iterations + 1):
        new = _propagate(adjacency, state, "score", "dst").select(
            "id", (F.lit(base) + F.lit(damping) * F.col("score")).alias("score"))
        if tolerance is not None:
            new = cut(new)
            gap = new.join(state.withColumnRenamed("score", "old"), "id").agg(
                F.max(F.abs(F.col("score") - F.col("old"))).alias("gap")).first()["gap"]
            forget(state)
            state = new
            if gap is None or gap < tolerance:
                break
        elif i % PASSES_PER_CUT == 0 and i < iterations:
            state = cut(new)
            forget(kept)
            kept = state
        else:
            state = new
    return state


def _out_totals(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("src").agg(F.sum("weight").alias("total"))


def pagerank(graph: Graph, damping: float = 0.85, iterations: int = 20, tolerance: float | None = None) -> DataFrame:
    """id, score; r = (1-d) + d * sum of r(u) * w / out-weight(u). The weight of a dangling node is dropped."""
    graph = graph.stored()
    shares = graph.edges.join(_out_totals(graph), "src").select(
        "src", "dst", F.try_divide("weight", "total").alias("share"))
    return _rank(graph, shares.fillna(0.0, ["share"]), damping, iterations, tolerance)


def articlerank(graph: Graph, damping: float = 0.85, iterations: int = 20, tolerance: float | None = None) -> DataFrame:
    """As pagerank, but the divisor is the node's out-weight plus the mean out-weight."""
    graph = graph.stored()
    n = graph.nodes.agg(F.count("*")).scalar()
    mean = graph.edges.agg(F.sum("weight")).scalar() / n
    shares = graph.edges.join(_out_totals(graph), "src").select(
        "src", "dst", (F.col("weight") / (F.col("total") + mean)).alias("share"))
    return _rank(graph, shares, damping, iterations, tolerance)


def _normalised(state: DataFrame, value: str) -> DataFrame:
    """Divide by the Euclidean norm; an all-zero vector stays zero. `state` must be materialised."""
    norm = state.agg(F.sqrt(F.sum(F.col(value) * F.col(value)))).scalar()
    return state.withColumn(value, F.coalesce(F.try_divide(F.col(value), norm), F.lit(0.0)))


def eigenvector(graph: Graph, iterations: int = 20) -> DataFrame:
    """id, score by power iteration along the edges.

    The step is linear, so scaling at the cuts gives the same direction as scaling every round.
    """
    graph = graph.stored()
    shares = graph.edges.select("src", "dst", F.lit(1.0).alias("share"))
    adjacency = Adjacency(with_self(shares, graph.nodes, "share"), "src")
    n = graph.nodes.agg(F.count("*")).scalar()
    state = graph.nodes.select("id", (F.lit(1.0) / n).alias("score"))
    for i in range(1, iterations + 1):
        state = _propagate(adjacency, state, "score", "dst")
        if i % PASSES_PER_CUT == 0 or i == iterations:
            state = _normalised(cut(state), "score")
    return state


def hits(graph: Graph, iterations: int = 20) -> DataFrame:
    """id, authority, hub; each vector has Euclidean norm 1."""
    graph = graph.stored()
    shares = with_self(graph.edges.select("src", "dst", F.lit(1.0).alias("share")), graph.nodes, "share")
    forward, backward = Adjacency(shares, "src"), Adjacency(shares, "dst")
    hub = graph.nodes.select("id", F.lit(1.0).alias("value"))
    authority = hub
    for i in range(1, iterations + 1):
        authority = _propagate(forward, hub, "value", "dst")
        if i == iterations:
            authority = cut(authority)
        hub = _propagate(backward, authority, "value", "src")
        if i % 3 == 0 or i == iterations:
            hub = _normalised(cut(hub), "value")
    authority = _normalised(authority, "value").withColumnRenamed("value", "authority")
    return authority.join(hub.withColumnRenamed("value", "hub"), "id")


def heterogeneous(parts: dict[str, DataFrame], links: list[tuple[str, str, DataFrame]]) -> Graph:
    """One graph over several node kinds. Ids become struct(kind, key), so kinds cannot collide.

    `parts` maps kind -> frame(id); `links` lists (source kind, target kind, frame(src, dst, weight)).
    """
    nodes = None
    for kind, df in parts.items():
        named = df.select(F.struct(F.lit(kind).alias("kind"), F.col("id").alias("key")).alias("id"))
        nodes = named if nodes is None else nodes.unionByName(named)
    edges = None
    for a, b, df in links:
        named = df.select(
            F.struct(F.lit(a).alias("kind"), F.col("src").alias("key")).alias("src"),
            F.struct(F.lit(b).alias("kind"), F.col("dst").alias("key")).alias("dst"),
            F.col("weight").cast("double").alias("weight"),
        )
        edges = named if edges is None else edges.unionByName(named)
    return Graph(nodes, edges)
