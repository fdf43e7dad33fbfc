"""Bigram language model in Elias-Fano tries, trained and queried in one shuffle.

The model is p(w | v) = (c(v, w) + MU p(w)) / (c(v) + MU) with p(w) = (c(w) + 1) / (N + V + 1); every text begins after and
ends with the boundary symbol. Its logarithm is a sum in which the numerator needs only counts of w and (v, w), and the
denominator only counts of v. So the shard of a word knows all that its tokens add: the numerator of each, and minus the denominator for the
token that follows it. No count has to be sent back to another token.

1. Words of the training texts are counted: N, V, and the frequent words.
2. Pairs of two hot words (each more than a thousandth of all tokens, so at most HOT_WORDS words) are counted and their trie is
   broadcast: at most HOT_WORDS^2 pairs. Their tokens are scored where they are.
3. All other tokens go, packed per piece of text and shard, to the shard of their word; tokens of words that alone would
   overload a shard are split by the word before. A shard counts its pairs, builds the trie (`elias_fano.Trie`: pointers, context
   ranks made monotone, 16-bit values) in mapped memory, looks every distinct pair up and returns one partial sum per document.
4. Partial sums of a piece meet the piece's documents.

Training and scoring use every token; nothing is pruned. Words are told apart by 64-bit hashes, contexts inside a word by
40 bits of theirs. The order is two: a third word's smoothed value would need counts from two shards.

Defined cases: a null or empty text is the boundary alone. A null id counts as empty text for the split. Words never seen in training have
p(w) = 1 / (N + V + 1). Without training texts all counts are 0. Repeated rows are scored each (and count each). Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import store
from quillgraph.llm.elias_fano import Trie
from quillgraph.llm.words import Words, hash_words, mix, words_of

MU = 100.0
SHARD_TOKENS = 2_000_000
HOT_WORDS = 1000
SPLIT_WORDS = 1_000_000
_U = np.uint64
BOUNDARY = _U(0x5DEECE66D1234567)
_STEP = _U(0x9E3779B97F4A7C15)
CONTEXT_BYTES = 5
CONTEXT_MASK = _U((1 << (8 * CONTEXT_BYTES)) - 1)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, hash before and row of every token of a piece, boundaries included."""
    n = np.diff(w.first) + 1
    row = np.repeat(np.arange(w.n), n)
    word = np.full(len(row), BOUNDARY)
    inside = np.ones(len(row), bool)
    inside[np.cumsum(n) - 1] = False
    word[inside] = hash_words(w)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(n) - n] = BOUNDARY  # also the end of the text before it
    return word, before, row


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: counts of all tokens of `docs` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column(0), lower=True):
                values, n = np.unique(tokens(w)[0], return_counts=True)
                yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What every task knows: N, V, and hash and count of the frequent words; the first `hot` flags are of hot ones."""

    def __init__(self, total: int, distinct: int, words: np.ndarray, counts: np.ndarray, mu: float):
        self.total, self.distinct, self.words, self.counts, self.mu = total, distinct, words, counts, mu
        self.hot = counts > total / HOT_WORDS

    def parts(self) -> tuple:
        return self.total, self.distinct, self.words, self.counts, self.mu

    def place(self, word: np.ndarray) -> np.ndarray:
        """Number among the frequent words, or -1."""
        if not len(self.words):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at, -1)

    def prior(self, counts: np.ndarray) -> np.ndarray:
        """MU p(w)."""
        return self.mu * (counts + 1.0) / (self.total + self.distinct + 1.0)

    def trie(self, words: np.ndarray, counts: np.ndarray, pair_word: np.ndarray, pair_context: np.ndarray, pair_count: np.ndarray) -> Trie:
        prior = self.prior(counts)
        return Trie.build(words, counts, pair_word, pair_context, np.log10(pair_count + prior[pair_word]), np.log10(prior))

    def gains(self, trie: Trie, number: np.ndarray, context: np.ndarray) -> np.ndarray:
        """What tokens of (word number, context) add to the log10 probability of their text."""
        return trie.lookup(number, context) - np.log10(trie.counts[number] + self.mu)


def vocabulary(counted: DataFrame, mu: float) -> Vocabulary:
    """From a stored table of word counts. At most SPLIT_WORDS words are collected."""
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = min(total / HOT_WORDS, max(SHARD_TOKENS / 4, total / SPLIT_WORDS))
    rows = counted.filter(F.col("c") > least).toPandas()
    words, counts = rows["word"].to_numpy(np.int64).view(_U), rows["c"].to_numpy(np.int64)
    order = np.argsort(words)
    return Vocabulary(int(total), int(distinct), words[order], counts[order], mu)


def hot_trie(docs: DataFrame, known: Vocabulary) -> Trie:
    """Trie of the pairs of two hot words, from all training texts."""
    shared = docs.sparkSession.sparkContext.broadcast(known.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Vocabulary(*shared.value)
        size = len(mine.words)
        for batch in batches:
            for w in words_of(batch.column(0), lower=True):
                word, before, _ = tokens(w)
                a, b = mine.place(word), mine.place(before)
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
                both = mine.hot[a] & mine.hot[b]
                values, n = np.unique(a[both] * size + b[both], return_counts=True)
                yield pa.record_batch([pa.array(values, pa.int64()), pa.array(n, pa.int64())], names=["pair", "c"])

    size = max(1, len(known.words))
    rows = docs.select("text").mapInArrow(run, "pair bigint, c bigint").groupBy("pair").agg(F.sum("c").alias("c")).toPandas() if len(known.words) else None
    pair = rows["pair"].to_numpy(np.int64) if rows is not None else np.zeros(0, np.int64)
    count = rows["c"].to_numpy(np.int64) if rows is not None else np.zeros(0, np.int64)
    word, context = pair // size, known.words[pair % size] & CONTEXT_MASK if len(pair) else np.zeros(0, _U)
    order = np.lexsort((context, word))
    return known.trie(known.words, known.counts, word[order], context[order], count[order])


_BLOCK = "shard bigint, piece bigint, words binary, ends binary, before binary, rows binary, wide boolean, sums array<double>, bases array<double>, n_known array<bigint>"
_SUMS = ("sums", "bases", "n_known")


def route(docs: DataFrame, known: Vocabulary, trie: Trie, shards: int) -> DataFrame:
    """Blocks of tokens for the shards, and per piece one row with its documents and what their hot pairs add.

    docs: text, doc_id, held_out. A token is stored with its document's number times two, plus one if it is a training token.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known.parts(), trie.image()))
    info = docs.select(F.array("doc_id").alias("doc_ids"), F.array("held_out").alias("held"), F.array(F.lit(0).cast("bigint")).alias("n_tokens")).schema
    names = [*info.names, *(x.split()[0] for x in _BLOCK.split(", "))]
    schema = f"{info.simpleString()[7:-1].replace(':', ' ', 1).replace(',held:', ', held ').replace(',n_tokens:', ', n_tokens ')}, {_BLOCK}"
    arrow = {"shard": pa.int64(), "piece": pa.int64(), "words": pa.binary(), "ends": pa.binary(), "before": pa.binary(), "rows": pa.binary(), "wide": pa.bool_(),
             "sums": pa.list_(pa.float64()), "bases": pa.list_(pa.float64()), "n_known": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "n_tokens": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, image = shared.value
        mine, hot = Vocabulary(*parts), Trie.view(image).mapped()
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for w in words_of(batch.column(0), lower=True):
                word, before, row = tokens(w)
                a, b = mine.place(word), mine.place(before)
                near = (a >= 0) & (b >= 0)
                near[near] = mine.hot[a[near]] & mine.hot[b[near]]
                values, inverse = np.unique(a[near] * max(1, len(mine.words)) + b[near], return_inverse=True)
                number, other = np.divmod(values, max(1, len(mine.words)))
                gain = mine.gains(hot, number, mine.words[other] & CONTEXT_MASK)[inverse] if len(values) else np.zeros(0)
                sums = np.bincount(row[near], gain, w.n)
                bases = np.bincount(row[near], np.log10(mine.counts[a[near]] + 1.0), w.n)
                n_known = np.bincount(row[near], minlength=w.n)
                ids, mark = batch.column(1).slice(w.row, w.n), held[w.row:w.row + w.n]
                one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, w.n], pa.int32()), pa.array(x, t))
                lists = {"doc_ids": pa.ListArray.from_arrays(pa.array([0, w.n], pa.int32()), ids), "held": one(mark, pa.bool_()),
                         "n_tokens": one(np.diff(w.first) + 1, pa.int64()), "sums": one(sums, pa.float64()), "bases": one(bases, pa.float64()),
                         "n_known": one(n_known, pa.int64()), "shard": pa.array([-1 - piece], pa.int64()), "piece": pa.array([piece], pa.int64())}
                yield pa.record_batch([lists[n] if n in lists else pa.nulls(1, arrow[n]) for n in names], names=names)

                far = np.flatnonzero(~near)
                word, before, row, a = word[far], before[far], row[far], a[far]
                key = np.where(a >= 0, word ^ mix(before), word)
                shard = (((mix(key) >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)
                order = np.argsort((shard.astype(_U) << _U(44)) | (word >> _U(20)), kind="stable")
                word, before, shard = word[order], before[order], shard[order]
                wide = w.n >= 1 << 15
                marked = (row[order] * 2 + ~mark[row[order]]).astype(np.uint32 if wide else np.uint16)
                packed = np.ascontiguousarray(before.view(np.uint8).reshape(-1, 8)[:, :CONTEXT_BYTES])
                new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (shard[1:] != shard[:-1])])) if len(word) else far
                ends = np.append(new[1:], len(word))
                cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                stops = np.append(cuts[1:], len(word))
                first, last = np.searchsorted(new, cuts), np.searchsorted(new, stops)
                columns = {
                    "shard": pa.array(shard[cuts]), "piece": pa.array(np.full(len(cuts), piece)), "wide": pa.array(np.full(len(cuts), wide)),
                    "words": pa.array([word[new[i:j]].tobytes() for i, j in zip(first, last)], pa.binary()),
                    "ends": pa.array([(ends[i:j] - c).astype(np.uint32).tobytes() for i, j, c in zip(first, last, cuts)], pa.binary()),
                    "before": pa.array([packed[i:j].tobytes() for i, j in zip(cuts, stops)], pa.binary()),
                    "rows": pa.array([marked[i:j].tobytes() for i, j in zip(cuts, stops)], pa.binary())}
                yield pa.record_batch([columns.get(n, pa.nulls(len(cuts), arrow.get(n) or pa.list_(ids.type))) for n in names], names=names)
                piece += 1

    return docs.select("text", "doc_id", "held_out").mapInArrow(run, schema)


def score_shard(part: pa.Table, known: Vocabulary) -> pa.Table:
    """What the tokens of one shard add to each document: rows (document numbers) and sums per piece."""
    piece = part.column("piece").to_numpy()
    words, context, row, block, train = [], [], [], [], []
    for i in range(part.num_rows):
        got = {c: part.column(c)[i].as_buffer() for c in ("words", "ends", "before", "rows")}
        ends = np.frombuffer(got["ends"], np.uint32).astype(np.int64)
        words.append(np.repeat(np.frombuffer(got["words"], _U), np.diff(ends, prepend=0)))
        packed = np.zeros((len(words[-1]), 8), np.uint8)
        packed[:, :CONTEXT_BYTES] = np.frombuffer(got["before"], np.uint8).reshape(-1, CONTEXT_BYTES)
        context.append(packed.view(_U).ravel())
        marked = np.frombuffer(got["rows"], np.uint32 if part.column("wide")[i].as_py() else np.uint16)
        row.append((marked >> 1).astype(np.int32))
        train.append((marked & 1).astype(bool))
        block.append(np.full(len(marked), i, np.int32))
    word, number = np.unique(np.concatenate(words), return_inverse=True)
    del words
    context, row, train, block = (np.concatenate(x) for x in (context, row, train, block))
    order = np.lexsort((context, number))
    number, context, train = number[order], context[order], train[order]
    new = np.concatenate([[True], (number[1:] != number[:-1]) | (context[1:] != context[:-1])])
    pair = np.cumsum(new) - 1
    pair_number, pair_context = number[new], context[new]
    pair_count = np.bincount(pair, train).astype(np.int64)
    counts = np.bincount(number, train, len(word)).astype(np.int64)
    place = known.place(word)
    counts[place >= 0] = known.counts[place[place >= 0]]
    del context, train, number
    seen = pair_count > 0
    trie = known.trie(word, counts, pair_number[seen], pair_context[seen], pair_count[seen]).mapped()
    gain = known.gains(trie, pair_number, pair_context)[pair]
    base = np.log10(counts + 1.0)[pair_number][pair]
    has = (counts > 0)[pair_number][pair]
    owner = block[order].astype(np.int64) << 32 | row[order]
    docs, inverse = np.unique(owner, return_inverse=True)
    sums, bases, n_known = np.bincount(inverse, gain), np.bincount(inverse, base), np.bincount(inverse, has)
    cuts = np.flatnonzero(np.diff(docs >> 32, prepend=-1))
    stops = np.append(cuts[1:], len(docs))
    cut = lambda x, t: pa.array([x[i:j].astype(t).tobytes() for i, j in zip(cuts, stops)], pa.binary())
    return pa.table({"piece": pa.array(piece[docs[cuts] >> 32]), "rows": cut(docs & 0xFFFFFFFF, np.uint32), "sums": cut(sums, np.float32),
                     "bases": cut(bases, np.float64), "n_known": cut(n_known, np.uint32)})


def merge_piece(part: pa.Table, total: int, distinct: int) -> pa.Table:
    """One row per document of a piece, from its own row and the sums of all shards."""
    own = next(i for i in range(part.num_rows) if part.column("doc_ids")[i].is_valid)
    ids = part.column("doc_ids")[own].values
    n_tokens = part.column("n_tokens")[own].values.to_numpy().copy()
    got = {}
    for name, kind in (("sums", np.float32), ("bases", np.float64), ("n_known", np.uint32)):
        out = part.column("own_" + name)[own].values.to_numpy().astype(float)
        for rows, values in zip(part.column("rows"), part.column(name)):
            if rows.is_valid:
                out[np.frombuffer(rows.as_buffer(), np.uint32)] += np.frombuffer(values.as_buffer(), kind)
        got[name] = out
    return pa.table({"doc_id": ids, "held_out": part.column("held")[own].values, "n_tokens": pa.array(n_tokens), "n_known": pa.array(got["n_known"].astype(np.int64)),
                     "train_tokens": pa.array(np.full(len(ids), total)), "base_score": pa.array(got["bases"] - n_tokens * np.log10(total + distinct + 1.0)),
                     "score": pa.array(got["sums"])})


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`; rows that aren't held out are learned from."""
    base = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), held_out.alias("held_out"))
    train = base.filter(~F.col("held_out"))
    known = vocabulary(store(count_words(train), "words"), mu)
    hot = hot_trie(train, known)
    shards = max(1, -(-known.total // SHARD_TOKENS))
    blocks = route(base, known, hot, shards)
    shared = docs.sparkSession.sparkContext.broadcast(known.parts())
    doc_type = blocks.schema["doc_ids"].dataType.simpleString()
    own = f"doc_ids {doc_type}, held array<boolean>, n_tokens array<bigint>, own_sums array<double>, own_bases array<double>, own_n_known array<bigint>"
    answer = "piece bigint, rows binary, sums binary, bases binary, n_known binary"

    def run(part: pa.Table) -> pa.Table:
        fields = {"piece": pa.int64(), "rows": pa.binary(), "sums": pa.binary(), "bases": pa.binary(), "n_known": pa.binary()}
        docs_of = {"doc_ids": part.schema.field("doc_ids").type, "held": pa.list_(pa.bool_()), "n_tokens": pa.list_(pa.int64()),
                   "own_sums": pa.list_(pa.float64()), "own_bases": pa.list_(pa.float64()), "own_n_known": pa.list_(pa.int64())}
        if part.column("shard")[0].as_py() < 0:  # documents of one piece pass
            got = {"piece": part.column("piece"), "doc_ids": part.column("doc_ids"), "held": part.column("held"), "n_tokens": part.column("n_tokens")}
            got |= {"own_" + n: part.column(n) for n in _SUMS}
        else:
            table = score_shard(part, Vocabulary(*shared.value))
            got = {n: table.column(n) for n in table.column_names}
        n = len(got["piece"])
        return pa.table({c: got[c] if c in got else pa.nulls(n, t) for c, t in (fields | docs_of).items()})

    scored = blocks.groupBy("shard").applyInArrow(run, f"{answer}, {own}")
    total, distinct = known.total, known.distinct
    schema = base.select("doc_id", "held_out", *(F.lit(0).cast(t).alias(n) for n, t in (
        ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")))).schema
    return scored.groupBy("piece").applyInArrow(lambda part: merge_piece(part, total, distinct), schema)
