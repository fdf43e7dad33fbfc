import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quillgraph.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Graph from an edge list; nodes default to the ends."""
    from quillgraph.operators.graph import Graph

    def build(edges, nodes=()):
        ids = sorted({x for e in edges for x in e[:2]} | set(nodes))
        rows = [(a, b, float(w[0]) if w else 1.0) for a, b, *w in edges]
        return Graph(spark.createDataFrame([(i,) for i in ids], "id bigint"),
                     spark.createDataFrame(rows, "src bigint, dst bigint, weight double"))

    return build
