"""Terms of documents: counts, tf-idf, co-occurrence, brand score, key phrases, language."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import STOP_WORDS, marks_and_words, sentences
from quillgraph.operators.graph import Graph
from quillgraph.operators.paths import betweenness_weighted
from quillgraph.operators.ranking import top_per_group
from quillgraph.session import cut


def term_counts(tokens: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys..., word, weight from frames with an array column `tokens`."""
    return tokens.select(*keys, F.explode("tokens").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("weight"))


def lemmatize(rows: DataFrame, lemmas: DataFrame, column: str = "word") -> DataFrame:
    """Replace `column` by its lemma; forms missing from lemmas(form, lemma) stay."""
    return rows.join(lemmas, rows[column] == lemmas["form"], "left").withColumn(
        column, F.coalesce("lemma", column)).drop("form", "lemma")


PAIRED_TOKENS, PAIRS_PER_PART = 1 << 20, 1 << 22
#: Parts are so many times the partitions, which evens these out.
SPLIT = 4
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def group_rows(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of each group of equal values (nulls are equal), and the group of each row."""
    first, group = np.zeros(1, np.int64), np.zeros(rows, np.int64)
    for c in columns:
        part = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) + 1
        _, first, group = np.unique(group * (int(part.max()) + 1) + part, return_index=True, return_inverse=True)
    return first, group


def _pair_counter(window: int, groups: int, parts: int, drop_self: bool) -> Batches:
    """Batch function: group columns, part, and lists high, low, weight of the pairs of codes that fall into the part, from runs of about PAIRED_TOKENS tokens."""

    def count(rows: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
        lists = rows.column(groups).flatten()
        codes, code = np.unique(lists.fill_null(0).to_numpy(zero_copy_only=False), return_inverse=True)
        codes, code = np.concatenate([[0], codes]), np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, code + 1)  # place 0: a null token
        bits, owner = len(codes).bit_length(), np.repeat(np.arange(len(size)), size)
        first_row, group = group_rows(rows.columns[:groups], len(size))
        keys = [np.zeros(0, np.int64)]
        for k in range(1, window):
            same = np.flatnonzero(owner[k:] == owner[:-k])
            a, b = code[same], code[same + k]
            high, low = np.maximum(a, b), np.minimum(a, b)
            low = np.where(low == 0, high, low)  # as greatest and least, passes over nulls
            key = (group[owner[same]] << 2 * bits) | (high << bits) | low
            keys.append(key[high != low] if drop_self else key)
        key, weight = np.unique(np.concatenate(keys), return_counts=True)
        of, high, low = key >> 2 * bits, (key >> bits) & ((1 << bits) - 1), key & ((1 << bits) - 1)
        part = ((codes[high] * 31 + codes[low]).view(np.uint64) >> np.uint64(20)) % np.uint64(parts)
        cell = of * parts + part.astype(np.int64)
        order = np.argsort(cell.astype(np.uint16) if len(first_row) * parts <= 1 << 16 else cell, kind="stable")  # numpy sorts short numbers by their digits
        of, part, high, low, weight = of[order], part[order].astype(np.int32), high[order], low[order], weight[order]
        start = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        ends = pa.array(np.append(start, len(of)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, t, mask=m)) for x, t, m in (
            (codes[high], pa.int64(), high == 0), (codes[low], pa.int64(), low == 0), (weight, pa.int64(), None))]
        return pa.record_batch([*(c.take(pa.array(first_row[of[start]])) for c in rows.columns[:groups]), pa.array(part[start]), *lists],
                               names=[*rows.schema.names[:groups], "part", "high", "low", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(groups)), 0).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.diff((np.cumsum(size) - size) // PAIRED_TOKENS, prepend=0, append=-1))
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                if end > begin:
                    yield count(batch.slice(begin, end - begin), size[begin:end])

    return run


def _changes(*columns: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places in `order` whose row differs from the one before."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _pair_adder(groups: int, min_weight: int) -> Batches:
    """Batch function over a whole part: group columns, high, low, weight of the pairs whose weights add up to more than `min_weight`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(found).combine_chunks() if (found := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        size = pc.list_value_length(rows["weight"]).to_numpy()
        values = [rows[c].combine_chunks().flatten() for c in ("high", "low", "weight")]
        null = [v.is_null().to_numpy(zero_copy_only=False) for v in values[:2]]
        high, low, weight = (v.fill_null(0).to_numpy(zero_copy_only=False) for v in values)
        columns = [rows.column(c).combine_chunks() for c in range(groups)]
        first_row, group = group_rows(columns, len(size))
        group = np.repeat(group, size) * 2 + null[0]  # both ends are null or none
        mixed = (high * 0x9E3779B97F4A7C1 ^ low) * 0x2545F4914F6CDD1D + group
        order = np.argsort(mixed)
        mixed, start = mixed[order], _changes(high, low, group, order=order)
        if len(start) > 1 + np.count_nonzero(mixed[1:] != mixed[:-1]):  # two pairs of one mixed number
            order = np.lexsort((low, high, group))
            start = _changes(high, low, group, order=order)
        group, high, low = group[order], high[order], low[order]
        total = np.add.reduceat(weight[order], start)
        start, total = start[total > min_weight], total[total > min_weight]
        group, no = np.divmod(group[start], 2)
        for at in range(0, len(start), PAIRED_TOKENS):
            s = slice(at, at + PAIRED_TOKENS)
            yield pa.record_batch([*(c.take(pa.array(first_row[group[s]])) for c in columns), pa.array(high[start[s]], mask=no[s] == 1), pa.array(low[start[s]], mask=no[s] == 1),
                                   pa.array(total[s], pa.int64())], names=[*rows.schema.names[:groups], "high", "low", "weight"])

    return run


def word_codes(tokens: DataFrame) -> tuple[DataFrame, int]:
    """(code, word) of all words, and the seed of the digest that tells them apart."""
    words = cut(tokens.select(F.explode("tokens").alias("word")).filter("word IS NOT NULL").distinct())
    seed = 0
    while True:
        vocabulary = words.groupBy(F.xxhash64("word", F.lit(seed)).alias("code")).agg(F.min("word").alias("word"), F.count("*").alias("n"))
        if vocabulary.filter("n > 1").isEmpty():
            return vocabulary.select("code", "word"), seed
        seed += 1


def coded_pairs(tokens: DataFrame, window: int, by: tuple[str, ...], min_weight: int, drop_self: bool) -> tuple[DataFrame, DataFrame]:
    """by..., high, low, weight: pairs of `cooccurrence` as digests of the words; and code, word of all words."""
    tokens = cut(tokens.select(*by, "tokens"))
    vocabulary, seed = word_codes(tokens)
    codes = tokens.select(*by, F.transform("tokens", lambda w: F.when(w.isNotNull(), F.xxhash64(w, F.lit(seed)))).alias("codes"))
    most = (tokens.agg(F.sum(F.size("tokens"))).first()[0] or 0) * (window - 1)
    parts = max(tokens.sparkSession.sparkContext.defaultParallelism, math.ceil(most / PAIRS_PER_PART))
    kinds, size = dict(tokens.dtypes), len(by)
    keys = "".join(f"`{c}` {kinds[c]}, " for c in by)
    runs = codes.mapInArrow(_pair_counter(window, size, SPLIT * parts, drop_self), f"{keys}part int, high array<bigint>, low array<bigint>, weight array<bigint>")
    counted = runs.repartition(parts, "part").select(*by, "high", "low", "weight").mapInArrow(_pair_adder(size, min_weight), f"{keys}high bigint, low bigint, weight bigint")
    return counted, vocabulary


def cooccurrence(tokens: DataFrame, window: int = 7, by: tuple[str, ...] = (), min_weight: int = 16,
                 drop_self: bool = True) -> DataFrame:
    """by..., first, second, weight, inverse_weight: unordered word pairs fewer than `window` tokens apart.

    Words are counted as 64-bit digests, which are checked to be different. Tasks pair the token array with itself shifted by 1..window-1 and count equal
    pairs, so a document of n tokens costs (window - 1) * n numbers. Counts move as lists by a digest of the pair, in as many parts as PAIRS_PER_PART asks
    for, and are added up inside the part. Words come back for pairs above `min_weight`.
    """
    counted, vocabulary = coded_pairs(tokens, window, by, min_weight, drop_self)
    for end in ("high", "low"):
        counted = counted.join(vocabulary.select(F.col("code").alias(end), F.col("word").alias(f"{end}_word")), end, "left")
    return counted.select(*by, F.greatest("high_word", "low_word").alias("first"), F.least("high_word", "low_word").alias("second"), "weight",
                          (1.0 / F.col("weight")).alias("inverse_weight"))


def with_idf(links: DataFrame, documents: Column, item: str) -> DataFrame:
    """Adds df and idf = 1 + ln(documents / (1 + df)); one row per (id, item) expected."""
    df = links.groupBy(item).agg(F.count("*").alias("df"))
    return links.join(df, item).withColumn("idf", 1.0 + F.ln(documents / (1 + F.col("df"))))


def term_tfidf(links: DataFrame, documents: Column) -> DataFrame:
    """id, word, tf, idf, tfidf from id, word, weight; tf is the share of the document's terms."""
    total = links.groupBy("id").agg(F.sum("weight").alias("terms"))
    scored = with_idf(links, documents, "word").join(total, "id").withColumn("tf", F.col("weight") / F.col("terms"))
    return scored.select("id", "word", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def keyword_tfidf(links: DataFrame, documents: Column) -> DataFrame:
    """id, word, tf (1 / number of keywords), idf, tfidf, wtfidf (score-weighted) from id, word, score."""
    total = links.groupBy("id").agg(F.count("*").alias("keywords"))
    scored = with_idf(links, documents, "word").join(total, "id").withColumn("tf", 1.0 / F.col("keywords"))
    tfidf = F.col("tf") * F.col("idf")
    return scored.select("id", "word", "tf", "idf", tfidf.alias("tfidf"), (F.col("score") * tfidf).alias("wtfidf"))


# ---------------------------------------------------------------- word graphs and the brand score

def word_degrees(cooc: DataFrame, by: tuple[str, ...] = ("year",)) -> DataFrame:
    """by..., word, degree, strength (sum of incident weights). A self pair counts at both ends."""
    return _ends(cooc, by).groupBy(*by, "word").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def _ends(cooc: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by..., word, other, weight: each pair seen from both words."""
    return cooc.select(*by, F.explode(F.array(
        F.struct(F.col("first").alias("word"), F.col("second").alias("other")),
        F.struct(F.col("second").alias("word"), F.col("first").alias("other")))).alias("e"), "weight").select(*by, "e.*", "weight")


def distinctiveness(cooc: DataFrame, by: tuple[str, ...] = ("year",), variant: str = "library") -> DataFrame:
    """by..., word, value: sum over neighbours of log10((n - 1) / degree), or log10(n / degree) for "stem".

    n is the number of words of the group's graph; graphs of at most 3 words are left out.
    """
    deg = word_degrees(cooc, by)
    size = deg.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 3")
    top = F.col("n") - 1 if variant == "library" else F.col("n")
    factor = deg.join(size, list(by)).select(*by, F.col("word").alias("other"), F.log10(top / F.col("degree")).alias("factor"))
    return _ends(cooc, by).join(factor, [*by, "other"]).groupBy(*by, "word").agg(F.sum("factor").alias("value"))


def neighbour_degree(cooc: DataFrame, by: tuple[str, ...] = ("year",)) -> DataFrame:
    """by..., word, neighbour_degree: sum of the neighbours' degrees (both directions)."""
    deg = word_degrees(cooc, by).select(*by, F.col("word").alias("other"), "degree")
    return _ends(cooc, by).join(deg, [*by, "other"]).groupBy(*by, "word").agg(F.sum("degree").alias("neighbour_degree"))


def word_betweenness(cooc: DataFrame, weighted: bool = True) -> DataFrame:
    """year, word, value: betweenness inside each year's word graph; years are parts of one graph, so all run at once."""
    node = lambda c: F.struct("year", F.col(c).alias("word"))
    weight = F.col("inverse_weight") if weighted else F.lit(1.0)
    edges = cooc.select(node("first").alias("src"), node("second").alias("dst"), weight.alias("weight"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return betweenness_weighted(Graph(nodes, edges)).select("id.year", "id.word", F.col("betweenness").alias("value"))


def prevalence(counts: DataFrame) -> DataFrame:
    """year, word, value: total term count per word and year."""
    return counts.groupBy("year", "word").agg(F.sum("weight").cast("double").alias("value"))


def yearly_stats(measure: DataFrame) -> DataFrame:
    """year, mean, spread (population)."""
    return measure.groupBy("year").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))


def normalised(measure: DataFrame, name: str) -> DataFrame:
    """Value / yearly mean / yearly spread; a zero divisor gives null."""
    scaled = F.try_divide(F.try_divide(F.col("value"), F.col("mean")), F.col("spread"))
    return measure.join(yearly_stats(measure), "year").select("year", "word", scaled.alias(name))


def brand_score(*measures: DataFrame) -> DataFrame:
    """year, word, score: sum of the normalised measures; a word missing from one measure is left out."""
    out = None
    for i, m in enumerate(measures):
        part = normalised(m, f"m{i}")
        out = part if out is None else out.join(part, ["year", "word"])
    return out.select("year", "word", sum((F.col(f"m{i}") for i in range(1, len(measures))), F.col("m0")).alias("score"))


# ---------------------------------------------------------------- key phrases

#: Scores are ranked by 12 digits; what may round to the last kept score stays a candidate.
ROUNDED = 2e-12


def _distinct(group: np.ndarray, groups: int, values: np.ndarray) -> np.ndarray:
    """Number of different values from 0 of each group."""
    return np.bincount(np.unique(group * (int(values.max(initial=0)) + 1) + values) // (int(values.max(initial=0)) + 1), minlength=groups)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _word_scores(owner: np.ndarray, sentence: np.ndarray, code: np.ndarray, stop: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Score of each token's word in its document, NaN for marks (code 0) and stop words; tokens are in order."""
    at = np.flatnonzero(code)
    words, begin, group = np.unique(owner[at] * len(stop) + code[at], return_index=True, return_inverse=True)
    of, word = np.divmod(words, len(stop))
    tf = np.bincount(group, minlength=len(words))
    first, spread = sentence[at[begin]], _distinct(group, len(words), sentence[at])
    variety = np.zeros(len(words))
    for step in (-1, 1):
        near = np.clip(at + step, 0, len(code) - 1)
        side = np.flatnonzero((near == at + step) & (line[near] == line[at]) & (code[near] > 0))
        variety += _share(_distinct(group[side], len(words), code[near[side]]), np.bincount(group[side], minlength=len(words)))
    docs = int(owner[-1]) + 1
    top, lines = np.zeros(docs), np.zeros(docs)
    np.maximum.at(top, of, tf)
    np.maximum.at(lines, owner, sentence + 1)
    said = ~stop[word]
    number = np.bincount(of[said], minlength=docs)
    mean = _share(np.bincount(of[said], tf[said], docs), number)
    sd = np.sqrt(_share(np.bincount(of[said], (tf[said] - mean[of[said]]) ** 2, docs), number))
    rel = 1.0 + variety * tf / top[of]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = rel * np.log(np.log(first + 3.0)) / (tf / (mean[of] + sd[of]) / rel + spread / lines[of] / rel)
    scores = np.full(len(code), np.nan)
    scores[at] = np.where(said, score, np.nan)[group]
    return scores


def _phrase_finder(least: int, most: int, keep: int) -> Batches:
    """Batch function over id and the words of its texts, by text and sentence (null: a mark): id, keyword, score of what may be among its `keep` best phrases."""

    def found(ids: pa.Array, texts: pa.ListArray) -> Iterator[pa.RecordBatch]:
        of_id = texts.value_lengths().to_numpy()
        lines, owner = texts.flatten(), np.repeat(np.arange(len(texts)), of_id)
        tokens, size = lines.flatten(), lines.value_lengths().to_numpy()
        within = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner, sentence = np.repeat(owner, size), within(size)
        words, size = tokens.flatten().dictionary_encode(), tokens.value_lengths().to_numpy()
        if not len(words.dictionary):
            return
        owner, sentence, pos = np.repeat(owner, size), np.repeat(sentence, size), within(size)
        code = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1  # 0: a mark
        if of_id.max() > 1:  # texts of one id are read side by side
            order = np.lexsort((pos, sentence, owner))
            owner, sentence, code = owner[order], sentence[order], code[order]
        stop = np.concatenate([[True], pc.is_in(words.dictionary, pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)])
        line = np.cumsum((np.diff(owner, prepend=-1) != 0) | (np.diff(sentence, prepend=-1) != 0))
        score = _word_scores(owner, sentence, code, stop, line)
        at, group, product, total = np.flatnonzero(~stop[code]), owner[~stop[code]] * len(stop) + code[~stop[code]], score[~stop[code]], score[~stop[code]]
        phrases = []
        for n in range(2, most + 1):
            fits = np.flatnonzero(at + n - 1 < len(code))
            fits = fits[(line[at[fits] + n - 1] == line[at[fits]]) & (code[at[fits] + n - 1] > 0)]
            at, last = at[fits], at[fits] + n - 1
            group = np.unique(group[fits], return_inverse=True)[1] * len(stop) + code[last]
            product, total = product[fits] * np.where(stop[code[last]], 1.0, score[last]), total[fits] + np.where(stop[code[last]], 0.0, score[last])
            ends = np.flatnonzero(~stop[code[last]])
            if n < least or not len(ends):
                continue
            _, first, of, tf = np.unique(group[ends], return_index=True, return_inverse=True, return_counts=True)
            low_product, low_total = np.full(len(tf), np.inf), np.full(len(tf), np.inf)
            np.minimum.at(low_product, of, product[ends])
            np.minimum.at(low_total, of, total[ends])
            phrases.append((at[ends[first]], np.full(len(tf), n), low_product / (tf * (1.0 + low_total))))
        if not phrases:
            return
        at, n, value = (np.concatenate(x) for x in zip(*phrases, strict=True))
        order = np.lexsort((value, owner[at]))
        at, n, value = at[order], n[order], value[order]
        begin = np.searchsorted(owner[at], owner[at])
        last = value[np.minimum(begin + keep, np.searchsorted(owner[at], owner[at], side="right")) - 1]
        unnamed = ids.is_null().to_numpy(zero_copy_only=False)[owner[at]]
        near = (value <= last + ROUNDED + 1e-15 * np.abs(last)) | unnamed
        at, n, value, unnamed = at[near], n[near], value[near], unnamed[near]
        for k in range(2, most + 1):
            some = np.flatnonzero(n == k)
            for a in range(0, len(some), PAIRED_TOKENS):
                of = some[a:a + PAIRED_TOKENS]
                keyword = pc.binary_join_element_wise(*[words.dictionary.take(pa.array(code[at[of] + j] - 1)) for j in range(k)], " ")
                yield pa.record_batch([ids.take(pa.array(owner[at[of]])), keyword, pa.array(value[of], pa.float64(), mask=unnamed[of])], names=["id", "keyword", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.diff((np.cumsum(size) - size) // PAIRED_TOKENS, prepend=0, append=-1))
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                if end > begin:
                    yield from found(batch.column("id")[begin:end], batch.column("texts")[begin:end])

    return run


def extract_keywords(docs: DataFrame, least: int = 2, most: int = 5, keep: int = 10) -> DataFrame:
    """id, keyword, score (lower is better), rank.

    Word features per document: relative frequency, first sentence, share of sentences, variety of left
    and right neighbours. A phrase scores the product of its content words over tf * (1 + their sum).
    A text moves once, to the other texts of its id; words and phrases are counted where it is, and only phrases that may be kept leave the task. Without an id there is no score.
    """
    word = lambda x: F.when(x.rlike(r"^[\p{L}\p{N}]"), F.lower(x))
    lines = lambda text: F.transform(sentences(text), lambda line: F.transform(marks_and_words(line), word))
    rows = docs.groupBy("id").agg(F.collect_list("text").alias("texts"))
    read = rows.select("id", F.aggregate("texts", F.lit(0).cast("long"), lambda n, text: n + F.length(text)).alias("size"), F.transform("texts", lines).alias("texts"))
    found = read.mapInArrow(_phrase_finder(least, most, keep), f"id {dict(docs.dtypes)['id']}, keyword string, score double")
    return top_per_group(found, ["id"], [F.round("score", 12), F.col("keyword")], keep)


# ---------------------------------------------------------------- language

FIT_PARTS, HELD_OUT_PART = 4, 2


def _gram_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batch function over id, language, text: the trigrams of each row, counted, in runs of rows of about PAIRED_TOKENS characters."""
    for batch in batches:
        length = pc.utf8_length(batch.column(2)).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff((np.cumsum(length) - length) // PAIRED_TOKENS, prepend=0, append=-1))
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):
            if end == begin:
                continue
            chars = np.frombuffer("".join(batch.column(2)[begin:end].to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(begin, end), length[begin:end])
            inside = np.flatnonzero(owner[2:] == owner[:-2])
            grams, gram = np.unique((chars[inside] << 42) | (chars[inside + 1] << 21) | chars[inside + 2], return_inverse=True)
            key, count = np.unique(owner[inside] * max(1, len(grams)) + gram, return_counts=True)
            row, gram = np.divmod(key, max(1, len(grams)))
            row = pa.array(row)
            yield pa.record_batch([batch.column(0).take(row), batch.column(1).take(row), pa.array(grams[gram]), pa.array(count, pa.int64())], names=["id", "language", "gram", "c"])


def trigrams(docs: DataFrame) -> DataFrame:
    """id, language, gram (its three code points, 21 bits each), c: stored once, for profiles and for detection.

    A row's trigrams are counted where its text is, so no text and no occurrence moves; rows of one id are not added up.
    """
    rows = docs.select("id", "language", F.lower("text").alias("text")).filter(F.length("text") >= 3)
    return cut(rows.mapInArrow(_gram_counter, f"id {dict(rows.dtypes)['id']}, language string, gram bigint, c bigint"))


def language_profiles(grams: DataFrame, parts: int = FIT_PARTS, held_out: int = HELD_OUT_PART) -> DataFrame:
    """language, gram, gain, base: log smoothed frequency of every trigram of the labelled texts, relative to an unseen one.

    Texts with id % parts = held_out are not learned from.
    """
    fit = grams.filter(F.col("language").isNotNull() & (F.pmod("id", F.lit(parts)) != held_out))
    counts = fit.groupBy("language", "gram").agg(F.sum("c").alias("c"))
    total = counts.groupBy("language").agg((F.sum("c") + F.count("*")).alias("t"))
    return cut(counts.join(total, "language").select(
        "language", "gram", F.ln((F.col("c") + 1).cast("double")).alias("gain"), (-F.ln(F.col("t").cast("double"))).alias("base")))


def detect_language(docs: DataFrame, grams: DataFrame, profiles: DataFrame) -> DataFrame:
    """id, detected: the language with the greatest log likelihood of the document's trigrams (ties: least name).

    A text without trigrams (null, or under three characters) has a null label. A text's own sums are combined per language
    before they meet, and compared inside one row that has an entry per language.
    """
    hits = grams.join(profiles.select("language", "gram", "gain").withColumnRenamed("language", "guess"), "gram").groupBy("id", "guess").agg(
        F.sum(F.col("c") * F.col("gain")).alias("s"))
    sums = hits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("guess", "s"))).alias("sums"))  # one entry per language
    lengths = docs.select("id", (F.length(F.lower("text")) - 2).alias("n")).filter("n > 0")
    options = profiles.groupBy("language").agg(F.first("base").alias("base")).agg(F.collect_list(F.struct("language", "base")).alias("o")).scalar()
    scored = lengths.join(sums, "id", "left").withColumn("options", options).select("id", F.array_min(F.transform("options", lambda o: F.struct(
        (-(F.coalesce(F.try_element_at(F.col("sums"), o["language"]), F.lit(0.0)) + F.col("n") * o["base"])).alias("s"), o["language"].alias("language")))).alias("b"))
    return docs.select("id").join(scored.select("id", F.col("b.language").alias("detected")), "id", "left")
