"""Fill-in-the-middle rewriting against a regular expression and exact round trips."""

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import fim, words
from tests.llm import brute

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def rewritten(i, text, seed=42, share=50, spm=80):
    text = text or ""
    units = re.findall(UNIT, text)
    h = [int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= share:
        return len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return len(units), form, len(p), len(m), out


def test_marks_against_regular_expression():
    rnd = np.random.default_rng(8)
    alphabet = ["a", "é", "日", "😀", " ", "\t", "\n", "\x0b", "\x1f", "\x0e", "\x08", "\x00", "\x89", "\xa0", "!"]
    texts = ["".join(rnd.choice(alphabet, rnd.integers(0, 40))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0] + [len(r) for r in raw])
    x = fim.as_words(np.frombuffer(b"".join(raw), np.uint8))
    filled = np.array([b for a, b in zip(bounds, bounds[1:]) if b > a])
    units, points = fim.Marks(fim.unit_ends(x, filled - 1)), fim.Marks(fim.code_points(x))
    k = 0
    for t, a, b in zip(texts, bounds, bounds[1:]):
        ends = [int(a) + len(t[:m.end()].encode()) for m in re.finditer(UNIT, t)]
        assert int(units.rank(np.array([b]))[0] - units.rank(np.array([a]))[0]) == len(ends)
        assert [int(p) + 1 for p in units.select(np.arange(k, k + len(ends)))] == ends
        assert int(points.rank(np.array([b]))[0] - points.rank(np.array([a]))[0]) == len(t)
        k += len(ends)


def test_rewriting(spark, awkward, monkeypatch):
    rows, df = awkward
    more = [(100 + k, t) for k, t in enumerate(["<P>", "a <S> b", "x<M", "< P>y <", "<<P <S<M q>", "end  ", "\n", "ab\x0bcd 日 é"] * 8)]
    df = df.select("doc_id", "text", F.lit("x").alias("Output"), F.lit(1).alias("n"), "lang").unionByName(
        spark.createDataFrame([(*m, "x", 1, None) for m in more], "doc_id bigint, text string, Output string, n int, lang string"))
    monkeypatch.setattr(words, "PIECE_BYTES", 100)
    for share, spm in ((50, 80), (100, 50), (0, 0)):
        made = fim.transform(df, rewritten=share, spm=spm)
        assert made.columns == ["doc_id", "text", "lang", *fim.ADDED]
        got = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
        want = Counter((i, t, *rewritten(i, t, 42, share, spm)) for i, t in [r[:2] for r in rows] + more)
        assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
        assert all(r.back == (r.text or "") for r in got)
        assert {r.form for r in got} >= ({"plain", "spm", "psm"} if share else {"plain"})


def test_empty(nothing):
    assert fim.transform(nothing).count() == 0 and brute.sha("") == hashlib.sha256(b"").hexdigest()
