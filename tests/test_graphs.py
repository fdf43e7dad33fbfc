"""Hand-worked micro graphs and brute force on small random graphs."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import centrality as ce
from quillgraph.operators import community as cm
from quillgraph.operators import components as co
from quillgraph.operators import embedding as em
from quillgraph.operators import graph as gr
from quillgraph.operators import paths as pa
from quillgraph.operators import quality as qu
from quillgraph.operators import ranking as rk

PATH = [(1, 2), (2, 3), (3, 4), (4, 5)]
TRIANGLES = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4)]
CYCLE = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)]
STAR = [(1, i) for i in range(2, 7)]
DIAMOND = [(1, 2, 1), (2, 4, 1), (1, 3, 1), (3, 4, 1), (1, 4, 5)]


def table(df, key="id", value=None):
    value = value or [c for c in df.columns if c != key][0]
    return {r[key]: r[value] for r in df.collect()}


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def bfs(adj, s):
    dist, order, sigma, before = {s: 0}, [], {s: 1}, {}
    todo = deque([s])
    while todo:
        u = todo.popleft()
        order.append(u)
        for v in adj.get(u, ()):
            if v not in dist:
                dist[v] = dist[u] + 1
                todo.append(v)
            if dist[v] == dist[u] + 1:
                sigma[v] = sigma.get(v, 0) + sigma[u]
                before.setdefault(v, []).append(u)
    return dist, order, sigma, before


def brute_betweenness(nodes, edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    out = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        _, order, sigma, before = bfs(adj, s)
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, ()):
                dep[v] += sigma[v] / sigma[w] * (1 + dep[w])
            if w != s:
                out[w] += dep[w]
    return out


def test_path_measures(make):
    g = make(PATH)
    assert pa.diameter(g).first()[0] == 4
    assert table(pa.closeness(g)) == {1: 0.0, 2: 1.0, 3: 2 / 3, 4: 0.5, 5: 0.4}
    near = table(pa.harmonic(g))
    assert near[5] == pytest.approx((1 + 1 / 2 + 1 / 3 + 1 / 4) / 4)
    assert table(pa.betweenness(g)) == {1: 0, 2: 3, 3: 4, 4: 3, 5: 0}
    far = [tuple(r) for r in pa.longest_paths(g, 2).select("source", "target", "distance").collect()]
    assert far == [(1, 5, 4), (1, 4, 3)]


def test_distances_match_brute_force(spark, make):
    edges = random_edges(60, 110, 1)
    g = make(edges)
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    got = {(r["source"], r["id"]): r["distance"] for r in pa.bfs_distances(g, g.nodes).collect()}
    ids = [r["id"] for r in g.nodes.collect()]
    assert got == {(s, v): d for s in ids for v, d in bfs(adj, s)[0].items()}


@pytest.mark.parametrize("lanes", [3, 16])
def test_betweenness_matches_brute_force(make, lanes):
    edges = random_edges(40, 90, 2)
    g = make(edges)
    want = brute_betweenness([r["id"] for r in g.nodes.collect()], edges)
    got = table(pa.betweenness(g, lanes=lanes))
    assert got == pytest.approx(want)


def test_sampling_all_sources_is_exact(make):
    g = make(random_edges(25, 50, 3))
    assert table(pa.betweenness(g, samples=1000, seed=5)) == pytest.approx(table(pa.betweenness(g)))


def test_weighted_betweenness_counts_ties(make):
    assert table(pa.betweenness_weighted(make(DIAMOND))) == pytest.approx({1: 0.5, 2: 0.5, 3: 0.5, 4: 0.5})


def test_weighted_betweenness_with_equal_weights_is_unweighted(make):
    edges = [(a, b) for a, b in random_edges(25, 40, 4) if a < b]
    both = edges + [(b, a) for a, b in edges]
    g = make(edges)
    want = {k: v / 2 for k, v in brute_betweenness([r["id"] for r in g.nodes.collect()], both).items()}
    assert table(pa.betweenness_weighted(g)) == pytest.approx(want)


def test_components(make):
    g = make(CYCLE, nodes=[9])
    assert table(co.weak_components(g)) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9}
    assert table(co.strong_components(g)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 9: 9}


def test_strong_components_match_brute_force(make):
    edges = random_edges(50, 70, 6)
    g = make(edges)
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    ids = [r["id"] for r in g.nodes.collect()]
    reach = {s: set(bfs(adj, s)[0]) for s in ids}
    want = {s: min(v for v in reach[s] if s in reach[v]) for s in ids}
    assert table(co.strong_components(g)) == want


def test_long_chain_weak_components(make):
    g = make([(i, i + 1) for i in range(60)])
    assert set(table(co.weak_components(g)).values()) == {0}


def test_triangles(make):
    got = {r["id"]: (r["triangles"], r["coefficient"]) for r in co.local_clustering(make(TRIANGLES)).collect()}
    assert got[1] == (1, 1.0) and got[3] == (1, pytest.approx(1 / 3))
    assert set(table(co.local_clustering(make(STAR)), value="coefficient").values()) == {0.0}


def test_rank_scores(make):
    star = make(STAR)
    rank = table(ce.pagerank(star))
    assert rank[1] == pytest.approx(0.15) and rank[2] == pytest.approx(0.15 + 0.85 * 0.15 / 5)
    assert table(ce.pagerank(star, tolerance=1e-9)) == pytest.approx(rank)
    article = table(ce.articlerank(star))
    assert article[2] == pytest.approx(0.15 + 0.85 * 0.15 / (5 + 5 / 6))
    scores = {r["id"]: r for r in ce.hits(star).collect()}
    assert scores[1]["hub"] == pytest.approx(1) and scores[2]["authority"] == pytest.approx(5 ** -0.5)
    assert set(table(ce.eigenvector(make(PATH))).values()) == {0.0}


def test_degrees(make):
    g = make([(1, 2), (1, 2), (2, 1), (8, 8)], nodes=[7])
    assert {r["id"]: (r["out_degree"], r["in_degree"]) for r in gr.all_degrees(g).collect()} == {
        1: (2, 1), 2: (1, 2), 7: (0, 0), 8: (1, 1)}
    found = {r["check"]: r["found"] for r in gr.quality_report(g).collect()}
    assert found == {"duplicate_edges": 1, "self_loops": 1, "reciprocal_edges": 4, "no_out_edges": 1,
                     "no_in_edges": 1, "isolated": 1, "repeated_ids": 0}


def test_hot_key_is_split_and_keeps_every_edge(spark, make):
    edges = [(0, i) for i in range(1, 400)] + [(i, 0) for i in range(1, 50)]
    g = make(edges)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        adjacency = gr.Adjacency(g.edges, "src")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["__hot"] for r in adjacency.hot.collect()] == [0]
    spread = adjacency.edges.filter("src = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) >= 6 and max(r["count"] for r in spread) <= 399 / 3
    state = g.nodes.select("id", (F.col("id") * 2).alias("x"))
    got = sorted((r["src"], r["dst"], r["x"]) for r in adjacency.attach(state).collect())
    assert got == sorted((a, b, 2 * a) for a, b in edges)


def test_label_propagation(spark, make):
    g = make(TRIANGLES)
    seeds = spark.createDataFrame([(1, 7), (6, 9)], "id bigint, label int")
    both = gr.Graph(g.nodes, g.oriented(gr.UNDIRECTED))
    label = table(cm.label_propagation(both, seeds))
    assert label[1] == label[2] == 7 and label[5] == label[6]


@pytest.mark.parametrize("method", [cm.louvain, cm.leiden])
def test_modularity_communities(make, method):
    found, q = method(make(TRIANGLES))
    assert table(found) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert q == pytest.approx(2 * (3 / 7 - (7 / 14) ** 2))


@pytest.mark.parametrize("far", [1e16])
def test_a_heavy_edge_elsewhere_changes_nothing(make, far):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)] + ([(7, 8, far)] if far else [])
    for method in (cm.louvain, cm.leiden, cm.modularity_optimization):
        groups = {}
        for r in method(make(edges))[0].collect():
            groups.setdefault(r["community"], set()).add(r["id"])
        assert {frozenset(v) for v in groups.values()} == {frozenset({1, 2, 3}), frozenset({4, 5, 6})} | ({frozenset({7, 8})} if far else set())


def test_louvain_beats_single_level(make):
    edges = random_edges(60, 90, 8)
    g = make(edges)
    labels, q = cm.louvain(g)
    label, pairs = table(labels), [tuple(sorted(e)) for e in edges]
    k = {}
    for a, b in pairs:
        k[a] = k.get(a, 0) + 1
        k[b] = k.get(b, 0) + 1
    m = len(pairs)
    inner = sum(label[a] == label[b] for a, b in pairs) / m
    volume = {}
    for v, d in k.items():
        volume[label[v]] = volume.get(label[v], 0) + d
    assert q == pytest.approx(inner - sum((x / (2 * m)) ** 2 for x in volume.values()))
    assert q >= cm.modularity_optimization(g)[1] - 1e-9


def test_majority_label(spark):
    rows = [(1, 1, 5), (2, 1, 5), (3, 1, 6), (4, 2, None), (5, None, 7), (6, 3, 8), (7, 3, 4)]
    df = spark.createDataFrame(rows, "id bigint, cluster int, known_category int")
    assert table(cm.majority_label(df), value="consensus") == {1: 5, 2: 5, 3: 5, 4: -1, 5: None, 6: 4, 7: 4}


def test_ordered_pair_counts_of_large_and_uneven_groups(spark):
    """Groups below and above a part, ids that crowd into one part, repeated and null ids; sums over groups."""
    rows = [("few", i, i % 3) for i in range(0, 90, 3)] + [("even", 7 * i, i % 4) for i in range(300)] + [(None, 1, 0), (None, 2, 1), ("few", None, 1)]
    rows += [("crowd", i, i % 2) for i in range(400)] + [("crowd", 10**12, 5), ("few", 3, 9), ("few", 3, None)]
    want = {}
    for g, x, a in rows:
        for h, y, b in rows:
            if g is not None and g == h and x is not None and y is not None and x < y:
                want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame([(1, *r) for r in rows], "run int, g string, id bigint, cluster int")
    got = {(r["a"], r["b"]): r["pairs"] for r in qu.ordered_pair_counts(df, ["run", "g"], keep=["run"]).collect()}
    assert got == want


def test_shared_ancestors(spark):
    edges = spark.createDataFrame([(1, 100), (2, 100), (1, 101), (3, 101), (4, 102)], "src bigint, dst bigint")
    kept = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 0, 2), (4, 0, 2)], "id bigint, run int, cluster int")
    got = {(r["a"], r["b"]): r["shared"] for r in qu.shared_ancestors(edges, kept).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.25, (2, 2): 0.0}
    assert table(qu.nss(qu.shared_ancestors(edges, kept)), "cluster", "nss") == {1: 1.0 / 1.25}


def test_ordered_pairs_match_naive(spark):
    rng = random.Random(9)
    rows = [(g, i, rng.randrange(4)) for g in range(3) for i in rng.sample(range(1000), 40)]
    got = {(r["g"], r["a"], r["b"]): r["pairs"] for r in qu.ordered_pair_counts(
        spark.createDataFrame(rows, "g int, id bigint, cluster int"), ["g"]).collect()}
    want = {}
    for (g, x, a), (h, y, b) in itertools.permutations(rows, 2):
        if g == h and x < y:
            want[(g, a, b)] = want.get((g, a, b), 0) + 1
    assert got == want


def test_number_rows_over_many_buckets(spark):
    rng = random.Random(3)
    rows = [(i * 7, "hot" if rng.random() < 0.8 else "cold") for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, g string")
    got = {r["id"]: r["rn"] for r in rk.number_rows(df, "id", ["g"], rows_per_bucket=40).collect()}
    seen, want = {}, {}
    for i, g in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert got == want
    total = {r["id"]: r["rn"] for r in rk.number_rows(df, "id", rows_per_bucket=40).collect()}
    assert total == {i * 7: i + 1 for i in range(500)}


def test_exact_quantile_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(rk, "ROWS_PER_BUCKET", 10)
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 9, 3, 7, 7, 2, 8]], "x double")
    assert rk.exact_quantile_rows(df, "x", 0.5).first()[0] == 6.0


def test_category_similarity_matches_pairs(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)] if i else [0.0] * 4, i % 3) for i in range(12)]
    got = {(r["category_a"], r["category_b"]): r["similarity"] for r in em.category_similarity(
        spark.createDataFrame(rows, "id bigint, embedding array<double>, category int")).collect()}

    def cos(u, v):
        n = (sum(x * x for x in u) * sum(x * x for x in v)) ** 0.5
        return sum(x * y for x, y in zip(u, v)) / n if n else 0.0

    for a in range(3):
        for b in range(3):
            pairs = [cos(u, v) for i, u, ca in rows for j, v, cb in rows if i != j and ca == a and cb == b]
            assert got[(a, b)] == pytest.approx(sum(pairs) / len(pairs))


def test_fast_rp_is_repeatable_and_isolated_nodes_are_zero(make):
    g = make(TRIANGLES, nodes=[9])
    one, two = table(em.fast_rp(g, 8)), table(em.fast_rp(g, 8))
    assert one == two and one[9] == [0.0] * 8 and len(one[1]) == 8


def test_cluster_flow_sends_no_node_table_to_all_tasks(spark):
    edges, assigned = spark.range(9).selectExpr("id AS src", "id + 1 AS dst"), spark.range(10).selectExpr("id", "0 AS run", "id % 2 AS cluster")
    plan = qu.cluster_flow(edges, assigned)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2
    assert sorted(map(tuple, qu.cluster_flow(edges, assigned).collect())) == [(0, 0, 1, 5), (0, 1, 0, 4)]
