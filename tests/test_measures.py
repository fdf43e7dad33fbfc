"""Neighbour graphs, geometry and agreement of clusterings against plain versions on small inputs."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import agreement as ag
from quillgraph.operators import cohesion as co
from quillgraph.operators import neighbours as ne
from quillgraph.sources import tables as t


def vectors_of(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, embedding array<double>")


def test_all_pairs_over_blocks(spark, monkeypatch):
    """Queries stay distributed, ties go to the lesser id, and blocks don't show."""
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (60, 3)).tolist()
    x[7] = x[8] = x[40]
    df = vectors_of(spark, x)
    for name in ("ROWS", "ASKED", "CELLS"):
        monkeypatch.setattr(ne, name, 16)
    got = {}
    for r in ne.all_pairs(df, df.filter("id % 2 = 0"), 4).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in enumerate(x) if any(v)}
    want = {}
    for i in unit:
        if i % 2 == 0:
            near = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in unit if j != i)[:4]
            want[i] = [(n + 1, j) for n, (_, j) in enumerate(near)]
    assert {i: sorted(v) for i, v in got.items()} == want


def test_neighbours_leave_tasks_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ne, "CELLS", 50)
    rows = [([(10 * b + i, [1.0, float(i)]) for i in range(10)],) for b in range(20)]
    blocks = pa.record_batch([pa.array([r[0] for r in rows], pa.list_(pa.struct([("id", pa.int64()), ("v", pa.list_(pa.float64()))])))], names=["rows"])

    class Frame:
        def mapInArrow(self, run, schema):
            return list(run(iter([blocks])))

    sizes = [b.num_rows for b in ne._nearest_in_blocks(Frame(), 5)]
    assert sum(sizes) == 20 * 10 * 5 and max(sizes) <= 100


def test_recall_of_neighbours(spark):
    vectors = t.vectors(spark, "/root/testdata/sf0.1")
    truth = ne.all_pairs(vectors, vectors, 10).select("id", "neighbour")
    found = ne.knn_graph(vectors, 10)
    assert truth.join(found, ["id", "neighbour"], "left_semi").count() >= 0.95 * truth.count()


def test_blocks_hold_no_hot_group(spark):
    rnd = np.random.default_rng(1)
    x = [*np.tile(rnd.normal(size=8), (300, 1)), *rnd.normal(size=(200, 8))]
    coded = ne._coded(ne.unit_vectors(vectors_of(spark, x)), 4, 12, 0)
    blocks = ne.blocks_of(coded, 12, 16)
    sizes = blocks.groupBy("band", "level", "key", "chunk").count()
    assert blocks.count() == 4 * 500 and sizes.agg(F.max("count")).first()[0] <= 20
    found = ne.knn_graph(vectors_of(spark, x), 5, bands=4, bits=12, most=16, rounds=1).collect()
    near = {}
    for r in found:
        near.setdefault(r["id"], []).append(r)
    assert len(near) == 500 and all(len(v) == 5 and len({r.neighbour for r in v}) == 5 and all(r.neighbour != r["id"] for r in v) for v in near.values())
    assert all(r.similarity == 1 for i in range(300) for r in near[i])


def test_neighbours_of_awkward_rows(spark):
    x = [[1, 0], None, [0, 0], [2, 0], [], [0, 1]]
    got = {(r["id"], r.neighbour, r.similarity, r["rank"]) for r in ne.knn_graph(vectors_of(spark, x).filter("id <> 4"), 2).collect()}
    assert got == {(0, 3, 1.0, 1), (0, 5, 0.0, 2), (3, 0, 1.0, 1), (3, 5, 0.0, 2), (5, 0, 0.0, 1), (5, 3, 0.0, 2)}
    assert ne.knn_graph(vectors_of(spark, []), 2).count() == 0 and ne.knn_graph(vectors_of(spark, [[1, 2]]), 2).count() == 0


def plain_silhouette(x, c):
    out = []
    for i in range(len(x)):
        mean = {}
        for j in range(len(x)):
            if i != j:
                mean.setdefault(c[j], []).append(((x[i] - x[j]) ** 2).sum())
        mean = {k: sum(v) / len(v) for k, v in mean.items()}
        a, b = mean.pop(c[i], None), min(mean.values(), default=None)
        out.append(0 if a is None or b is None or max(a, b) == 0 else (b - a) / max(a, b))
    return out


@pytest.mark.parametrize("numbers", [1 << 21, 1])
def test_geometry(spark, numbers, monkeypatch):
    monkeypatch.setattr(co, "BLOCK_NUMBERS", numbers)
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 5))
    c = [int(k) for k in rnd.integers(0, 5, 60)]
    c[7], c[8], x[9] = 99, None, x[10]
    assigned = spark.createDataFrame(list(enumerate(c)), "id bigint, cluster bigint")
    rows = co.placed(vectors_of(spark, x), assigned)
    x, c = np.delete(x, 8, 0), c[:8] + c[9:]
    got = {r["id"]: r.silhouette for r in co.silhouette_rows(rows).collect()}
    assert [got[i] for i in sorted(got)] == pytest.approx(plain_silhouette(x, c))
    groups = {k: x[[i for i, v in enumerate(c) if v == k]] for k in set(c)}
    centre = {k: g.mean(axis=0) for k, g in groups.items()}
    gap = {k: np.linalg.norm(g - centre[k], axis=1) for k, g in groups.items()}
    worst = [max((gap[a].mean() + gap[b].mean()) / np.linalg.norm(centre[a] - centre[b]) for b in groups if a != b) for a in groups]
    assert co.davies_bouldin(rows).first().davies_bouldin == pytest.approx(np.mean(worst))
    within = sum((g ** 2).sum() for g in gap.values())
    between = sum(len(g) * ((centre[k] - x.mean(axis=0)) ** 2).sum() for k, g in groups.items())
    assert co.calinski_harabasz(rows).first().calinski_harabasz == pytest.approx((between / (len(groups) - 1)) / (within / (len(x) - len(groups))))
    found = {r.cluster: (r.n, r.mean_distance, r.rms_distance, r.max_distance) for r in co.mean_centroid_distance(rows).collect()}
    for k, g in gap.items():
        assert found[k] == pytest.approx((len(g), g.mean(), math.sqrt((g ** 2).mean()), g.max()), abs=1e-7)


def test_geometry_of_one_and_no_cluster(spark):
    one = co.placed(vectors_of(spark, [[0, 1], [1, 0], [1, 1]]), spark.createDataFrame([(i, 1) for i in range(3)], "id bigint, cluster bigint"))
    assert [r.silhouette for r in co.silhouette_rows(one).collect()] == [0, 0, 0]
    assert co.calinski_harabasz(one).first().calinski_harabasz is None and co.davies_bouldin(one).first().davies_bouldin == 0
    none = one.filter("id < 0")
    assert co.silhouette(none).first().rows == 0 and co.calinski_harabasz(none).first().rows == 0 and co.mean_centroid_distance(none).count() == 0


def plain_agreement(a, b):
    pairs = list(itertools.combinations(range(len(a)), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    pa, pb = sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
    expected = pa * pb / len(pairs)
    return (len(pairs) + 2 * both - pa - pb) / len(pairs), (both - expected) / ((pa + pb) / 2 - expected), both / (pa + pb - both)


@pytest.mark.parametrize("nulls", [False, True])
def test_agreement_against_pairs(spark, nulls):
    rnd = np.random.default_rng(3)
    a, b = ([None if v == 0 else int(v) for v in rnd.integers(0, 4, 50)] for _ in range(2))
    rows = [(7, i, v) for i, v in enumerate(a)] + [(9, i, v) for i, v in enumerate(b)]
    r = ag.agreement(ag.contingency(spark.createDataFrame(rows, "run int, id bigint, cluster int"), nulls)).first()
    if not nulls:
        keep = [i for i in range(50) if a[i] is not None and b[i] is not None]
        a, b = [a[i] for i in keep], [b[i] for i in keep]
    assert (r.run_a, r.run_b, r.rows) == (7, 9, len(a))
    assert (r.rand, r.adjusted_rand, r.pair_jaccard) == pytest.approx(plain_agreement(a, b))
    n = len(a)
    h = lambda v: -sum(v.count(x) / n * math.log(v.count(x) / n) for x in set(v))
    mutual = h(a) + h(b) - h(list(zip(a, b)))
    assert (r.mutual_information, r.normalised_mutual_information, r.homogeneity, r.completeness) == pytest.approx((mutual, 2 * mutual / (h(a) + h(b)), mutual / h(a), mutual / h(b)))


def test_trivial_and_huge_agreement(spark):
    table = lambda rows: ag.agreement(spark.createDataFrame(rows, "run_a int, run_b int, a int, b int, n bigint")).first()
    same = table([(0, 1, 1, 1, 5)])
    assert (same.rand, same.adjusted_rand, same.normalised_mutual_information) == (1, 1, 1)
    half = 10 ** 11
    huge = table([(0, 1, 1, 1, half), (0, 1, 2, 2, half), (0, 1, 1, 2, 1)])
    assert 0.99999 < huge.adjusted_rand <= 1 and huge.rows == 2 * half + 1
    even = table([(0, 1, a, b, 10 ** 10) for a in (1, 2) for b in (1, 2)])
    assert abs(even.adjusted_rand) < 1e-9 and abs(even.normalised_mutual_information) < 1e-12
