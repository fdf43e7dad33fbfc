"""Spelling variants against all pairs of words, with and without refined chunks."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import spelling
from tests.llm import brute


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def variants(rows, letters=5, times=3, typo=97, ratio=2):
    count = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = brute.lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if typo and h % typo == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= letters and c >= times}
    out, form = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = len(close)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, n[w], out[w], form[w], n.get(form[w]), root


def check(df, rows, **options):
    got = spelling.group_variants(df, **options).select("word", "n", "n_near", "form", "form_n", "root").collect()
    options.pop("most", None)
    assert sorted(map(tuple, got)) == sorted(variants(rows, **options))
    return got


@pytest.mark.parametrize("most", [20_000, 3])
def test_near_words(spark, most):
    rnd = random.Random(1)
    stems = ["".join(rnd.choice("abcé") for _ in range(k)) for k in (5, 5, 6, 7, 8, 9, 11, 17) for _ in range(6)]
    words = set(stems) | {"aaaaa", "aaaaaa", "aaaaaaa", "ababa", "babab", "ababab", "ÀÉ×÷ÿ", "é" * 300}
    for s in stems:
        for _ in range(8):
            k = rnd.randrange(len(s) + 1)
            words.add(rnd.choice([s[:k] + rnd.choice("abcé") + s[k:], s[:k] + s[k + 1:], s[:k] + rnd.choice("abc") + s[k + 1:]]))
    text = [(k, " ".join(rnd.choices(sorted(words), [4 ** (k % 6) for k in range(len(words))], k=400)), "x", "y") for k in range(30)]
    df = spark.createDataFrame(text, "doc_id bigint, text string, word string, n string")
    got = check(df, [t[:2] for t in text], most=most, times=2)
    assert sum(r.n_near for r in got) > 100 and any(r.root != r.form and r.form for r in got)


def test_awkward_rows_and_typos(awkward):
    rows, df = awkward
    check(df, [r[:2] for r in rows])
    check(df, [r[:2] for r in rows], typo=2, letters=1, times=1)


def test_edits_at_every_place(spark):
    word = "abcdefghi"
    words = [word] + [word[:k] + word[k + 1:] for k in range(9)] + [word[:k] + "z" + word[k:] for k in range(10)] + [word[:k] + "z" + word[k + 1:] for k in range(9)]
    df = spark.createDataFrame([(w, 1) for w in dict.fromkeys(words)], "word string, n bigint")
    for most in (20_000, 0):
        got = Counter(frozenset((r.a, r.b)) for r in spelling.near_words(df, most).collect())
        want = Counter(frozenset((a, b)) for k, a in enumerate(words) for b in words[:k] if near(a, b))
        assert got == want


def test_empty(nothing):
    assert spelling.group_variants(nothing).count() == 0
    assert spelling.vocabulary(nothing.withColumn("word", F.lit("x"))).count() == 0
