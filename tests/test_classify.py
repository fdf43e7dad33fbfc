"""Node classification against plain gradient steps and on separable rows."""

import numpy as np
import pytest

from quillgraph.operators import classify as cl


def frame(spark, x, labels):
    rows = [(i, None if v is None else [float(c) for c in v], k) for i, (v, k) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>, label string")


def plain(x, y, labels, steps, rate, penalty, batches):
    w = np.zeros((len(labels), x.shape[1] + 1))
    x1 = np.column_stack([x, np.ones(len(x))])
    for s in range(steps):
        mine = [i for i in range(len(x)) if i % batches == s % batches and y[i] is not None]
        p = np.exp(x1[mine] @ w.T)
        p /= p.sum(axis=1, keepdims=True)
        for r, i in enumerate(mine):
            p[r, labels.index(y[i])] -= 1
        shrink = penalty * w
        shrink[:, -1] = 0
        w = w - rate * (p.T @ x1[mine] / len(mine) + shrink)
    return w


def test_steps(spark):
    rnd = np.random.default_rng(6)
    x, y = rnd.normal(size=(40, 3)), [["a", "b", "c", None][k] for k in rnd.integers(0, 4, 40)]
    model = cl.fit(frame(spark, x, y).repartition(3), 6, 0.5, 0.1, 3)
    assert model.labels == ["a", "b", "c"]
    assert model.weights == pytest.approx(plain(x, y, model.labels, 6, 0.5, 0.1, 3))


def test_separable_classes(spark):
    rnd = np.random.default_rng(7)
    y = [int(k) for k in rnd.integers(0, 3, 300)]
    x = np.eye(3)[y] * 4 + rnd.normal(size=(300, 3)) * 0.5
    rows = frame(spark, x, [f"k{k}" if i % 5 else None for i, k in enumerate(y)])
    got = {r["id"]: r for r in cl.predict(rows, cl.fit(rows, 30)).collect()}
    hidden = range(0, 300, 5)
    assert np.mean([got[i].predicted == f"k{y[i]}" for i in hidden]) > 0.95 and all(1 / 3 <= r.probability <= 1 for r in got.values())


def test_missing_rows(spark, monkeypatch):
    rows = frame(spark, [[1, 2], None, [3, 4]], [None, "a", None])
    none = cl.fit(rows, 3)
    assert none.labels == [] and [r.predicted for r in cl.predict(rows, none).collect()] == [None, None]
    assert cl.predict(rows.filter("id > 9"), cl.fit(frame(spark, [[1, 2]], ["a"]), 2)).count() == 0
    monkeypatch.setattr(cl, "MAX_NUMBERS", 3)
    with pytest.raises(ValueError):
        cl.fit(frame(spark, [[1, 2], [2, 3]], ["a", "b"]), 1)
