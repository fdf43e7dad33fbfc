"""Ancestors some citations away against plain loops, in runs and parts of any size."""

import numpy as np
import pytest

from quillgraph.operators import quality as qu


@pytest.mark.parametrize(("run", "part"), [(1 << 20, 1 << 22), (7, 20)])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_hops(spark, monkeypatch, run, part, kind):
    monkeypatch.setattr(qu, "PAIRS_PER_RUN", run)
    monkeypatch.setattr(qu, "PAIRS_PER_PART", part)
    rnd = np.random.default_rng(3)
    of = int if kind == "bigint" else str
    edges = [(of(a), of(b)) for a, b in rnd.integers(0, 40, (150, 2))] + [(of(k), of(99)) for k in range(40)] + [(of(99), of(k)) for k in range(30)]
    edges += [(None, of(3)), (of(4), None), edges[0], edges[0]]
    found = set(edges)
    for hops in (1, 2, 3):
        got = [tuple(r) for r in qu.k_hop_ancestors(spark.createDataFrame(edges, f"src {kind}, dst {kind}"), hops).select("child", "ancestor").collect()]
        assert len(got) == len(set(got)) and set(got) == found
        found = {(a, d) for a, b in found for c, d in edges if b is not None and b == c}


def test_pairs_move_in_runs(spark):
    """No row per pair is shuffled, and nothing is lost where there is nothing to follow."""
    df = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "src bigint, dst bigint")
    plan = qu.k_hop_ancestors(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[child" not in plan and "MapInArrow" in plan
    assert qu.k_hop_ancestors(df.filter("src = 1"), 2).isEmpty() and qu.k_hop_ancestors(df.limit(0), 2).isEmpty()
