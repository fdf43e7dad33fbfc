"""Run registered queries in Spark and their SQL in DuckDB, and compare rows.

usage: python tools/check.py [sf dir] [name or prefix ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from quillgraph.plans.registry import REGISTRY  # noqa: E402
from quillgraph.session import get_session  # noqa: E402
import quillgraph.plans.all  # noqa: E402,F401

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def compare(spark, con, entry, sf_dir):
    t0 = time.time()
    df = entry.run(spark, sf_dir)
    got, cols = rows_of(df.columns, df.collect())
    t1 = time.time()
    if entry.sql is None:
        return f"rows only: {len(got)}", t1 - t0, 0.0, len(got) > 0
    res = con.execute(entry.sql)
    names = [c[0] for c in res.description]
    want, wcols = rows_of(names, res.fetchall())
    t2 = time.time()
    if cols != wcols:
        return f"COLUMNS {cols} vs {wcols}", t1 - t0, t2 - t1, False
    if got == want and [type(x) for r in got[:50] for x in r] == [type(x) for r in want[:50] for x in r]:
        return f"equal {len(got)}", t1 - t0, t2 - t1, True
    sg, sw = set(got), set(want)
    return (f"DIFFER rows {len(got)} vs {len(want)}; only spark {len(sg - sw)} {sorted(sg - sw, key=repr)[:3]}; "
            f"only sql {len(sw - sg)} {sorted(sw - sg, key=repr)[:3]}; types {got[:1]} {want[:1]}"), t1 - t0, t2 - t1, False


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = get_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for name, entry in REGISTRY.items():
        if wanted and not any(name.startswith(w) or w in entry.covers or entry.run.__module__.endswith("." + w) for w in wanted):
            continue
        con = duck(sf_dir)
        try:
            msg, a, b, ok = compare(spark, con, entry, sf_dir)
        except Exception as e:  # report and go on with the next query
            msg, a, b, ok = f"ERROR {type(e).__name__} {str(e)[:600]}", 0, 0, False
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name:45s} spark {a:6.2f}s sql {b:6.2f}s {msg}", flush=True)
        spark.catalog.clearCache()
    print("bad:", bad)


if __name__ == "__main__":
    main()
