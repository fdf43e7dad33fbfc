"""Personalised rank against a linear system, scaling against plain formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import personal as pe


def exact(n, edges, seed, d=0.85):
    p = np.zeros((n, n))
    for a, b, w in edges:
        p[a, b] += w
    for a in range(n):
        if p[a].sum() == 0:
            p[a, seed] = 1
        p[a] /= p[a].sum()
    start = np.zeros(n)
    start[seed] = 1
    return np.linalg.solve(np.eye(n) - d * p.T, (1 - d) * start)


def test_many_seeds(spark, make):
    rnd = np.random.default_rng(4)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rnd.integers(0, 28, 90), rnd.integers(0, 30, 90), rnd.integers(1, 5, 90))]
    edges += [(k, 0, 1.0) for k in range(1, 28)] + [(0, k, 1.0) for k in range(1, 28)]  # a hub in both directions
    graph = make(edges, range(30))
    seeds = spark.createDataFrame([(0,), (5,), (29,), (5,), (777,)], "seed bigint")
    state = pe.push(graph, seeds, tolerance=1e-9).collect()
    assert {r.seed for r in state} == {0, 5, 29}
    for seed in (0, 5, 29):
        mine = [r for r in state if r.seed == seed]
        assert sum(r.score + r.waiting for r in mine) == pytest.approx(1, abs=1e-12)
        got = np.zeros(30)
        for r in mine:
            got[r["id"]] = r.score
        assert got == pytest.approx(exact(30, edges, seed), abs=1e-6)


def test_state_holds_touched_nodes_only(make, spark):
    graph = make([(i, i + 1) for i in range(50)])
    state = pe.push(graph, spark.createDataFrame([(10,), (49,)], "seed bigint"), rounds=3)
    assert sorted((r.seed, r["id"]) for r in state.collect()) == [(10, 10), (10, 11), (10, 12), (10, 13), (49, 49), (49, 50)]
    assert pe.push(graph, spark.createDataFrame([], "seed bigint")).count() == 0


@pytest.mark.parametrize("how", pe.SCALERS)
def test_scalers(spark, how):
    x = np.array([3.0, -1.0, 0.5, 8.0, 8.0])
    want = {"min_max": (x + 1) / 9, "max": x / 8, "mean": (x - x.mean()) / 9, "standard": (x - x.mean()) / x.std(), "l1": x / abs(x).sum(), "l2": x / np.sqrt((x * x).sum()),
            "center": x - x.mean(), "log": np.log(x + 2)}[how]
    rows = [(i, "a", float(v)) for i, v in enumerate(x)] + [(5, "a", None), (6, None, 4.0), (7, None, 4.0)]
    df = spark.createDataFrame(rows, "id int, kind string, score double")
    got = {r["id"]: r.score for r in pe.scale(df, how, within=("kind",), offset=2.0).collect()}
    assert [got[i] for i in range(5)] == pytest.approx(list(want)) and got[5] is None
    flat = {"min_max": 0, "max": 1, "mean": 0, "standard": 0, "l1": 0.5, "l2": 0.5 ** 0.5, "center": 0, "log": np.log(6)}[how]
    assert got[6] == got[7] == pytest.approx(flat)
    assert pe.scale(df.filter("id < 5"), how, offset=2.0).orderBy("id").select(F.collect_list("score")).first()[0] == pytest.approx(list(want))
    assert pe.scale(df.filter("id > 9"), how).count() == 0


def test_unknown_scaler(spark):
    with pytest.raises(ValueError):
        pe.scale(spark.range(1).select(F.lit(1.0).alias("score")), "cube")


@pytest.mark.parametrize("merge_after", [1, 8])
def test_a_round_stores_only_rows_that_got_mass(spark, make, monkeypatch, merge_after):
    """Many leaves get a little at first and stay as they are while mass goes round a ring."""
    monkeypatch.setattr(pe, "MERGE_AFTER", merge_after)
    edges = [(0, k, 0.001) for k in range(10, 60)] + [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)]
    graph, seeds = make(edges, range(60)), spark.createDataFrame([(0,)], "seed bigint")
    sizes, keep = [], pe.cut_bucketed

    def counted(rows, *how):
        kept = keep(rows, *how)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(pe, "cut_bucketed", counted)
    state = {r["id"]: (r["score"], r["waiting"]) for r in pe.push(graph, seeds, tolerance=1e-3, rounds=6).collect()}
    if merge_after == 8:
        assert sizes == [1, 51, 1, 1, 1, 1, 1]
    assert sum(a + b for a, b in state.values()) == pytest.approx(1, abs=1e-12)
    score, waiting = {0: 1 - 0.85}, 0.85 / 1.05
    for step in range(5):
        node = 1 + step % 3
        score[node] = score.get(node, 0.0) + 0.15 * waiting
        waiting *= 0.85
    assert {k: a for k, (a, _) in state.items() if a} == pytest.approx(score)
    assert state[3][1] == pytest.approx(waiting) and state[40][1] == pytest.approx(0.85 * 0.001 / 1.05)
    ranked = {r["id"]: r["score"] for r in pe.personalised_rank(graph, seeds, tolerance=1e-3, rounds=6).collect()}
    assert ranked == pytest.approx(score)
    assert pe.personalised_rank(graph, seeds, rounds=0).count() == 0
