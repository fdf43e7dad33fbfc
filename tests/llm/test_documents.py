"""Operators on documents against brute force, on awkward rows and on the smallest table."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import components, decontaminate, exact_dedup, fm_dedup, mixing, ngram_lm, simhash
from quillgraph.llm.common import remainder
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


@pytest.fixture(scope="module")
def small(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return [tuple(r) for r in df.collect()], df


@pytest.fixture(params=["awkward", "small"])
def documents(request):
    return request.getfixturevalue(request.param)


def test_exact_decisions(documents):
    rows, df = documents
    got = exact_dedup.decide(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    same([tuple(r) for r in got], brute.exact(pairs(rows)))


def test_exact_survivors(awkward):
    rows, df = awkward
    got = exact_dedup.survivors(df)
    assert got.columns == df.columns
    kept = {(i, t) for (i, t), d in zip(pairs(rows), brute.exact(pairs(rows))) if d[3]}
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(dict.fromkeys(kept, 1))


def test_simhash(documents):
    rows, df = documents
    got = simhash.near_duplicates(df).select("doc_id", simhash.hex_print(F.col("fp")), "component_id").collect()
    same([tuple(r) for r in got], brute.near(pairs(rows)))


def test_simhash_survivors(awkward):
    rows, df = awkward
    got = simhash.survivors(df)
    assert got.columns == df.columns
    want = {c for _, _, c in brute.near(pairs(rows))}
    assert Counter(r.doc_id for r in got.collect()) == Counter(want)


def test_simhash_survivors_of_repeated_and_missing_ids(spark):
    base, other = " ".join(f"w{i % 17}x{i}" for i in range(200)), " ".join(f"v{i % 13}y{i}" for i in range(200))
    copies = [base.replace("w3x3 ", f"new{k} ", 1) for k in range(8)]
    close = [t for t in copies if 0 < bin(brute.fingerprint(t) ^ brute.fingerprint(base)).count("1") <= 3]
    assert close
    rows = [(7, base), (7, other), (9, "plain words here")]
    got = simhash.survivors(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(rows)
    got = simhash.survivors(spark.createDataFrame([(None, t) for t in (base, close[0], other)], "doc_id bigint, text string")).collect()
    assert len(got) == 2 and other in {r.text for r in got}


def test_xxh64_and_bucket_search():
    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 256, 4000, dtype=np.uint8)
    start = rnd.integers(0, 3900, 300)
    end = start + rnd.integers(0, 60, 300)
    got = simhash.xxh64(data, start, end)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(start, end)]
    assert len(simhash.bucket_masks()) == 20


def connected(fps, links):
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(int(a))] = find(int(b))
    return {frozenset(x for x in root if find(x) == r) for r in {find(x) for x in root}}


def test_large_buckets_are_linked_like_small_ones():
    rnd = np.random.default_rng(2)
    centres = rnd.integers(0, 1 << 62, 12, dtype=np.uint64)
    flips = np.array([[1 << int(b) for b in rnd.integers(0, 62, 3)] for _ in range(240)], np.uint64)
    fps = np.unique(np.repeat(centres, 20) ^ np.bitwise_xor.reduce(flips, axis=1))
    want = connected(fps, [(a, b) for a in fps for b in fps if bin(int(a) ^ int(b)).count("1") <= 3])
    assert connected(fps, zip(*simhash.close_in_bucket(fps))) == want
    assert connected(fps, zip(*simhash._by_shared_neighbours(fps))) == want


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7)]
    got = components.roots(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 60)}


def test_decontamination(spark, documents):
    rows, df = documents
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 25]
    items = [(1, texts[0]), (2, texts[-1].lower()), (2, "été straße"), (3, "nothing of this"), (None, "naïve café"), (5, None), (6, ""), (7, texts[1] + " more")]
    items = items[:-1] + [(7, " ".join((texts[1] + " more").split()[-14:]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute.contaminated(pairs(rows), items)
    got = [tuple(r) for r in decontaminate.judge(df, bench).drop("row_key").collect()]
    same(got, want)
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(w[0] for w in want if not w[5])


def test_test_items_in_blocks(spark, documents, monkeypatch):
    rows, df = documents
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 25][:6]
    items = [(k, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    got = decontaminate.judge(df, spark.createDataFrame(items, "item_id bigint, text string")).drop("row_key").collect()
    same([tuple(r) for r in got], brute.contaminated(pairs(rows), items))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a b"), (4, "c a q q q q b")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, "a b c")], "item_id bigint, text string")
    index = decontaminate.build_index(docs)
    got = {tuple(r) for r in decontaminate.near(index, bench, 5).collect()}
    assert got == {(1, 9, 0, 5), (2, 9, 0, 3)}
    assert {tuple(r) for r in decontaminate.near(index, bench, 3).collect()} == {(2, 9, 0, 3)}


@pytest.mark.parametrize("hot", [50_000, 3])
def test_substrings(documents, hot, monkeypatch):
    monkeypatch.setattr(fm_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(fm_dedup, "SHARD_WORDS", 2000)
    rows, df = documents
    got = fm_dedup.dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same([tuple(r) for r in got], brute.substrings(pairs(rows)))


def language_model(rows, held, mu):
    import re

    count, two, texts = Counter(), Counter(), []
    for (i, t), out in zip(rows, held):
        words = re.findall(brute.WORD, brute.lower(t)) + ["<end>"]
        texts.append(words)
        if not out:
            count.update(words)
            two.update(zip(["<end>", *words], words))
    total, distinct = sum(count.values()), len(count)
    for (i, _), out, words in zip(rows, held, texts):
        prior = lambda w: (count[w] + 1) / (total + distinct + 1)
        yield (i, out, len(words), sum(count[w] > 0 for w in words), total, sum(math.log10(prior(w)) for w in words),
               sum(math.log10((two[v, w] + mu * prior(w)) / (count[v] + mu)) for v, w in zip(["<end>", *words], words)))


@pytest.mark.parametrize("shard", [2_000_000, 2000])
def test_language_model(documents, shard, monkeypatch):
    import zlib

    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard)
    rows, df = documents
    rows = pairs(rows)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    want = sorted(language_model(rows, held, ngram_lm.MU), key=repr)
    got = sorted((tuple(r) for r in ngram_lm.score(df, remainder("doc_id", 7) == 2).collect()), key=repr)
    key = lambda r: (repr(r[:5]), round(r[5], 3))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-3)


def test_model_probabilities_sum_to_one():
    rnd = np.random.default_rng(3)
    words = np.unique(rnd.integers(1, 1 << 62, 30, dtype=np.uint64))
    n = len(words)
    pair, count = np.unique(rnd.integers(0, n * n, 300), return_counts=True)
    by_word = np.bincount(pair % n, count, n).astype(int)
    context = np.bincount(pair // n, count, n).astype(int)
    known = ngram_lm.Vocabulary(int(count.sum()), n, words, by_word, 10.0)
    contexts = words & ngram_lm.CONTEXT_MASK
    order = np.lexsort((contexts[pair // n], pair % n))
    trie = known.trie(words, by_word, (pair % n)[order], contexts[(pair // n)[order]], count[order])
    for v in range(n):
        p = 10 ** trie.lookup(np.arange(n), np.full(n, contexts[v])) / (context[v] + 10.0)
        unseen = 10.0 / (known.total + known.distinct + 1) / (context[v] + 10.0)
        assert p.sum() + unseen == pytest.approx(1, abs=1e-3)


def test_mixing(documents):
    rows, df = documents
    three = [(r[0], r[1], r[3]) for r in rows]
    want = brute.mixing(three)
    got = mixing.plan(df).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    close = lambda r: (*r[:4], round(r[4], 6), r[5])
    same([close(tuple(r)) for r in got], [close((r[0], r[2], *w)) for r, w in zip(three, want)])
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    times = Counter()
    for r, w in zip(three, want):
        times[r[0], r[1], r[2]] += w[3]
    assert Counter((r.doc_id, r.text, r.source) for r in mixed.collect()) == +times


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    by = mixing.plan(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert by and all(abs(r.taken - r.target) <= r.most / 2 for r in by)


def test_native_plans(spark, awkward):
    from quillgraph.llm import chat_format

    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    for df in (mixing.plan(awkward[1]), mixing.mix(awkward[1]), chat_format.format_chats(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_tables(spark, nothing):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    for df in (exact_dedup.decide(nothing), exact_dedup.survivors(nothing), simhash.near_duplicates(nothing), simhash.survivors(nothing),
               decontaminate.judge(nothing, bench), decontaminate.clean(nothing, bench), fm_dedup.dedup(nothing), mixing.plan(nothing), mixing.mix(nothing),
               ngram_lm.score(nothing, remainder("doc_id", 7) == 2)):
        assert df.count() == 0
