"""Similar neighbour sets against all pairs, with and without hubs split."""

import numpy as np
import pytest

from quillgraph.operators import overlap as ov


def random_sets(rnd):
    sets = {k: {int(x) for x in rnd.integers(0, 40, rnd.integers(1, 12))} for k in range(60)}
    for k in range(60, 110):  # sets around one hub
        sets[k] = {1000, *(int(x) for x in rnd.integers(0, 60, k % 4))}
    for k in range(110, 130):
        sets[k] = {1000, 1001, *(int(x) for x in rnd.integers(0, 9, k % 3))}
    for k in range(130, 150):
        base = list(range(100 + k // 5 * 30, 100 + k // 5 * 30 + 25))
        sets[k] = set(base) - {int(x) for x in rnd.choice(base, k % 5)}
    return sets


@pytest.mark.parametrize(("threshold", "most"), [(0.5, 50_000), (0.5, 8), (0.3, 30), (0.8, 4), (1.0, 2)])
def test_pairs(spark, threshold, most):
    sets = random_sets(np.random.default_rng(5))
    df = spark.createDataFrame([(k, e) for k, s in sets.items() for e in s], "owner bigint, element bigint")
    rep = {k: min(j for j, u in sets.items() if u == s) for k, s in sets.items()}
    want = {}
    for a in set(rep.values()):
        for b in set(rep.values()):
            common = len(sets[a] & sets[b])
            if a < b and common and common / len(sets[a] | sets[b]) >= threshold:
                want[a, b] = (common, pytest.approx(common / len(sets[a] | sets[b])))
    got = {(r.a, r.b): (r.common, r.jaccard) for r in ov.similar_sets(df, threshold, most).collect()}
    assert got == want and (want or threshold == 1)
    assert {(r.owner, r.rep, r.size, r.copies) for r in ov.classes(df).collect()} == {(k, rep[k], len(s), list(rep.values()).count(rep[k])) for k, s in sets.items()}


def test_hub_forms_no_false_pairs(spark, monkeypatch):
    rows = [(k, e) for k in range(300) for e in (9999, k, 1000 + k)]
    formed = []
    inner = ov._counted
    monkeypatch.setattr(ov, "_counted", lambda pairs, *a: formed.append(pairs.count()) or inner(pairs, *a))
    assert ov.similar_sets(spark.createDataFrame(rows, "owner bigint, element bigint"), 0.5, 100).count() == 0
    assert formed == [0]


def test_empty(spark):
    assert ov.similar_sets(spark.createDataFrame([], "owner bigint, element bigint")).count() == 0


def test_few_pairs_are_looked_up(spark, monkeypatch):
    """Sets that share an element or two by chance are dropped by the number of their meetings, with and without hubs; no similar pair is lost."""
    rnd = np.random.default_rng(8)
    sets = {k: {int(x) for x in rnd.integers(0, 1500, 20)} | ({5000, 5001} if k % 3 == 0 else set()) for k in range(300)}
    sets |= {300 + k: set(list(sets[k])[:6 + k % 9]) | {int(x) for x in rnd.integers(2000, 2500, k % 12)} for k in range(40)}
    df = spark.createDataFrame([(k, e) for k, s in sets.items() for e in s], "owner bigint, element bigint")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.15 and sets[a] != sets[b]}
    formed = []
    inner = ov._counted
    monkeypatch.setattr(ov, "_counted", lambda pairs, *a: formed.append(pairs.count()) or inner(pairs, *a))
    for most in (50_000, 900):
        assert {(r.a, r.b) for r in ov.similar_sets(df, 0.15, most).collect()} == want
    assert len(want) > 30 and formed[0] < 3 * len(want)


@pytest.mark.parametrize(("threshold", "most"), [(0.15, 50_000), (0.15, 20), (0.2, 100)])
def test_loose_pairs(spark, threshold, most):
    test_pairs(spark, threshold, most)
