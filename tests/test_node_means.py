"""Means of neighbours' vectors, added up by parts and slices."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quillgraph.operators import embedding as em
from quillgraph.operators import node_means as nm


@pytest.fixture
def narrow(monkeypatch):
    for name, value in {"VERTICES_PER_PART": 8, "SLICE": 3, "RUN": 4, "PIECE": 2}.items():
        monkeypatch.setattr(nm, name, value)


@pytest.mark.parametrize("weighted", [False, True])
def test_parts_and_slices_give_the_mean_over_the_edges(spark, narrow, weighted):
    """Several parts and slices, a hub, a parallel edge, an end without a vector, a repeated id, null ends; on the driver only sizes."""
    rng = np.random.default_rng(1)
    x = {i: rng.normal(size=7).tolist() for i in range(30)}
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.integers(1, 4, 150))] + [(5, i, 1.0) for i in range(30)] + [(5, 6, 2.0), (5, 6, 2.0)]
    rows = [*x.items(), (7, x[8])]
    nodes = spark.createDataFrame(rows, "id bigint, x array<double>").select("id", array_to_vector("x").alias("vector"))
    frame = spark.createDataFrame([*edges, (None, 3, 1.0), (3, None, 1.0)], "src bigint, dst bigint, weight double")
    got = {r["id"]: r["v"] for r in em._neighbour_mean(frame, nodes, weighted).select("id", vector_to_array("vector").alias("v")).collect()}
    met = {}
    for a, b, w in edges:
        met.setdefault(a, []).extend((w if weighted else 1.0, v) for i, v in rows if i == b)
    want = {a: np.average([v for _, v in m], axis=0, weights=[w for w, _ in m]) for a, m in met.items() if m}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[a], want[a]) for a in want)


def test_no_edge_meets_a_vector_before_the_matrices(spark):
    """A vector is shuffled by part and slice, not joined to each of its edges."""
    nodes = spark.range(64)
    edges = nodes.crossJoin(nodes.withColumnRenamed("id", "dst")).select(F.col("id").alias("src"), "dst", F.lit(1.0).alias("weight"))
    plan = em._neighbour_mean(edges, em.random_rows(nodes, "id", 32, 0), False)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert plan.count("MapInArrow") == 3 and joins and not any("src" in x and "vector" in x for x in joins) and "Aggregate" in plan and "summar" not in plan.lower()


def test_few_values_are_sent_as_bytes():
    cells = np.array([[0.0, 3 ** 0.5, -3 ** 0.5]] * 50)
    assert len(nm._packed(cells)) < cells.nbytes / 4
    for x in (cells, np.random.default_rng(0).normal(size=(5, 3))):
        assert np.array_equal(nm._unpacked(nm._packed(x), len(x)), x)
