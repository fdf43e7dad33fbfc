"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names, comma-separated).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import quillgraph.plans.all  # noqa: E402,F401
from quillgraph.plans.registry import REGISTRY  # noqa: E402
from quillgraph.session import get_session  # noqa: E402

HEADLINE = (
    "graph_counts category_citation_matrix degree_all_orientations coverage modularity_directed conductance "
    "accuracy_per_category confusion_matrix shared_ancestors pagerank eigenvector hits closeness "
    "betweenness_two_sources weak_components strong_components triangle_count label_propagation "
    "fast_rp edge_similarity category_similarity term_counts term_tfidf cooccurrence_by_year "
    "distinctiveness prevalence extract_keywords detect_language kmeans_text_vectors document_vectors topic_keywords"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["graph_counts"].run(spark, sf_dir).collect()  # warm-up
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
