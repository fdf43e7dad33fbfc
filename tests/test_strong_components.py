"""Strong components: long chains, rings and rows of components in a bounded number of rounds; random graphs against reachability."""

import random

import pytest

from quillgraph.operators import components as co
from quillgraph.operators.graph import Graph


def graph(spark, nodes, edges, kind="bigint"):
    return Graph.of(spark.createDataFrame([(x,) for x in nodes], f"id {kind}"), spark.createDataFrame(edges, f"src {kind}, dst {kind}"))


def parts(g):
    return {r["id"]: r["component"] for r in co.strong_components(g).collect()}


def brute(nodes, edges):
    ahead = {x: [] for x in nodes}
    for a, b in edges:
        ahead[a].append(b)

    def reach(x):
        met, todo = {x}, [x]
        while todo:
            for y in ahead[todo.pop()]:
                if y not in met:
                    met.add(y)
                    todo.append(y)
        return met

    met = {x: reach(x) for x in nodes}
    return {x: min(y for y in met[x] if x in met[y]) for x in nodes}


def written(monkeypatch):
    """Counts the tables an operator writes, which grow with its rounds."""
    count = [0]
    real = co.cut
    monkeypatch.setattr(co, "cut", lambda df: (count.__setitem__(0, count[0] + 1), real(df))[1])
    return count


def test_path_and_ring_of_5000(spark, monkeypatch):
    n = 5000
    path = [(i, i + 1) for i in range(n)]  # 0 to 5000, which enters a ring, beside a ring that nothing enters
    ring = [(n + i, n + (i + 1) % n) for i in range(n)]
    free = [(2 * n + i, 2 * n + (i + 1) % n) for i in range(n)]
    count = written(monkeypatch)
    got = parts(graph(spark, range(3 * n), path + ring + free))
    assert got == {i: i if i < n else n if i < 2 * n else 2 * n for i in range(3 * n)}
    assert count[0] < 40


def test_row_of_components(spark, monkeypatch):
    """Pairs of nodes in a row, each pair twice linked to the next: no chains to take away."""
    k = 10
    edges = [(2 * i, 2 * i + 1) for i in range(k)] + [(2 * i + 1, 2 * i) for i in range(k)]
    edges += [(2 * i + a, 2 * i + 2 + a) for i in range(k - 1) for a in (0, 1)]
    count = written(monkeypatch)
    assert parts(graph(spark, range(2 * k), edges)) == {i: i // 2 * 2 for i in range(2 * k)}
    assert count[0] < 80


def test_random_graphs(spark):
    rnd = random.Random(7)
    nodes, edges, base = [], [], 0
    for _ in range(12):  # several graphs side by side in one table
        n = rnd.randint(5, 25)
        own = [base + i for i in range(n)]
        nodes += own
        edges += [(rnd.choice(own), rnd.choice(own)) for _ in range(round(n * rnd.choice((0.9, 1.2, 1.6))))]
        base += n
    edges += edges[:20]
    assert parts(graph(spark, nodes, edges)) == brute(nodes, edges)


@pytest.mark.parametrize("kind, key", [("string", str), ("int", int)])
def test_other_ids(spark, kind, key):
    edges = [(key(a), key(b)) for a, b in [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)]]
    nodes = [key(x) for x in range(1, 8)]
    assert parts(graph(spark, nodes, edges, kind)) == brute(nodes, edges)


def test_no_nodes_and_no_edges(spark):
    assert parts(graph(spark, [], [])) == {}
    assert parts(graph(spark, [3, -4], [])) == {3: 3, -4: -4}
