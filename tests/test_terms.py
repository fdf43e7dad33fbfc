"""Counted pairs of words against plain loops."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.operators import terms as te

ROWS = [(2001, ["b", "a", "a", "c", "b", "a"]), (2001, ["a", "b"]), (2002, ["b", "a", None, "ü"]), (None, ["b", "a"]), (2002, []), (2002, None), (2001, ["c"])]


def loops(rows, window, by, drop_self):
    found = Counter()
    for year, words in rows:
        for i, a in enumerate(words or []):
            for b in (words or [])[i + 1 : i + window]:
                ends = [x for x in (a, b) if x is not None]
                pair = (max(ends).encode(), min(ends).encode()) if ends else (None, None)
                if not drop_self or pair[0] != pair[1]:
                    found[(*([year] if by else []), *pair)] += 1
    return found


@pytest.mark.parametrize("by", [(), ("year",)])
@pytest.mark.parametrize("drop_self", [True, False])
@pytest.mark.parametrize("run", [2, 1 << 20])
def test_cooccurrence(spark, monkeypatch, by, drop_self, run):
    monkeypatch.setattr(te, "PAIRED_TOKENS", run)
    df = spark.createDataFrame(ROWS, "year bigint, tokens array<string>")
    for least in (0, 1):
        got = te.cooccurrence(df, 3, by, least, drop_self).collect()
        known = {k: n for k, n in loops(ROWS, 3, by, drop_self).items() if n > least}
        assert {(*([r["year"]] if by else []), *(x.encode() if x is not None else None for x in (r["first"], r["second"]))): r["weight"] for r in got} == known
        assert len(got) == len(known) and all(r["inverse_weight"] == 1 / r["weight"] for r in got)


def test_trigrams(spark, monkeypatch):
    """Every trigram of a row is counted, in any number of runs; a text moves and is stored as counted numbers only."""
    texts = ["abcabcABC", "xé\U0001F600é\U0001F600é", "ab", "", None, "aaaa", "   ", "abcab"]
    docs = spark.createDataFrame([(i % 6, None if i == 1 else "en", x) for i, x in enumerate(texts)], "id bigint, language string, text string").coalesce(1)
    wanted = Counter()
    for i, x in enumerate(texts):
        low = (x or "").lower()
        wanted.update((i % 6, None if i == 1 else "en", sum(ord(c) << 21 * (2 - n) for n, c in enumerate(low[k : k + 3]))) for k in range(len(low) - 2))
    for run in (1, 4, 1 << 20):
        monkeypatch.setattr(te, "PAIRED_TOKENS", run)
        found = te.trigrams(docs)
        got = Counter()
        for r in found.collect():
            got[(r["id"], r["language"], r["gram"])] += r["c"]
        assert got == wanted and dict(found.dtypes)["gram"] == "bigint"
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_leave_tasks_counted():
    """A run of equal documents costs one entry a pair, not one row an occurrence."""
    batch = pa.record_batch([pa.array([[5, 7, 5]] * 1000, pa.list_(pa.int64()))], names=["codes"])
    rows = list(te._pair_counter(7, 0, 3, True)([batch]))
    entries = [(h, l, n) for b in rows for r in b.to_pylist() for h, l, n in zip(r["high"], r["low"], r["weight"], strict=True)]
    assert entries == [(7, 5, 2000)]


def test_pairs_of_one_mixed_number(monkeypatch):
    """Pairs are told apart when their mixed numbers are equal."""
    pairs = [(0, 3 ^ (0x9E3779B97F4A7C1)), (1, 3)]
    batch = pa.record_batch([pa.array([h for h, _ in pairs] * 2).cast(pa.int64()), pa.array([x for _, x in pairs] * 2)], names=["h", "l"])
    lists = [pa.array([c.to_pylist()], pa.list_(pa.int64())) for c in (*batch.columns, pa.array([1, 10, 100, 1000]))]
    mixed = {(h * 0x9E3779B97F4A7C1) ^ x for h, x in pairs}
    assert len(mixed) == 1
    out = pa.Table.from_batches(te._pair_adder(0, 0)([pa.record_batch(lists, names=["high", "low", "weight"])])).to_pylist()
    assert {(r["high"], r["low"]): r["weight"] for r in out} == {pairs[0]: 101, pairs[1]: 1010}
    assert np.array_equal(te._changes(np.array([1, 1, 2]), order=np.arange(3)), [0, 2])
