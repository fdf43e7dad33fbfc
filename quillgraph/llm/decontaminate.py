"""Benchmark decontamination with a positional inverted index of the training tokens.

`build_index` keeps, for every shard of about PIECE_BYTES of whole texts, its terms and for each term the sorted
positions of all its tokens (delta-coded). The index is split by documents: it is made and searched without a shuffle,
a hot term is a long list in many shards instead of one long list, and it is stored once for any number of searches.

`search` finds exact phrases. A phrase's terms are taken from the rarest on; their lists, moved by the term's offset in the
phrase, are intersected until nothing is left. Positions leave a gap between documents, so no phrase crosses
them. `near` finds proximity matches: all terms of a phrase within a number of words, in any order.

Test items come in blocks of BLOCK_BYTES (a measured bound of what is collected and broadcast); each block is one pass over the
stored index. With several blocks the hits of a document are merged by its place in the index.

Defined cases: words are runs of ASCII digits and letters and of all non-ASCII characters, A-Z in lower case. Null and empty
texts have no words; items without words match nothing. Items with a null id mark words but are not listed. Repeated rows are
answered each; equal item ids count once. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillgraph.llm.common import free_name, row_key, store
from quillgraph.llm.words import NO_LETTER, hash_words, words_of

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Shards are a few megabytes each; small row groups keep what a writer and a reader buffer small.
ROW_GROUP_BYTES = 16 << 20
_INDEX = "shard bigint, row_keys array<bigint>, first binary, terms binary, term_ends binary, list_ends binary, deltas binary"
_U4 = np.uint32


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored index: one row per shard, with doc_ids and row_keys of its documents in order.

    first: position of each document's first word, and the end. terms, term_ends: term bytes one after the other.
    list_ends, deltas: positions of each term, the first one and then the steps.
    """
    frame = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"))
    schema = frame.select(F.array("doc_id").alias("doc_ids")).schema.simpleString()[7:-1].replace("doc_ids:", "doc_ids ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for w in words_of(batch.column(0), lower=True, breaks=NO_LETTER):
                h = hash_words(w)
                order = np.argsort(h, kind="stable")
                new = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]])) if len(h) else np.zeros(0, np.int64)
                position = (np.arange(len(h)) + np.repeat(np.arange(w.n), np.diff(w.first))).astype(_U4)[order]
                deltas = np.diff(position, prepend=_U4(0))
                deltas[new] = position[new]
                words = [w.bytes_of(i) for i in order[new]]
                parts = batch.slice(w.row, w.n)
                one = np.zeros(1, np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(np.append(one, w.n), pa.int32()), parts.column(c)) for c in (1, 2)]
                yield pa.record_batch([lists[0], pa.array([shard]), lists[1], *(pa.array([x.tobytes() if isinstance(x, np.ndarray) else x], pa.binary()) for x in (
                    (w.first + np.arange(w.n + 1)).astype(_U4), b"".join(words), np.cumsum([len(x) for x in words]).astype(_U4),
                    np.append(new[1:], len(h)).astype(_U4) if len(new) else new.astype(_U4), deltas))],
                    names=["doc_ids", "shard", "row_keys", "first", "terms", "term_ends", "list_ends", "deltas"])
                shard += 1

    return store(frame.mapInArrow(run, f"{schema}, {_INDEX}"), "index", **{"parquet.block.size": str(ROW_GROUP_BYTES)})


class Postings:
    """One shard's lists for the terms asked for."""

    def __init__(self, row: dict, asked: pa.Array):
        ends = np.frombuffer(row["term_ends"], _U4).astype(np.int32)
        known = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(np.zeros(1, np.int32), ends)), pa.py_buffer(row["terms"])])
        self.where = pc.fill_null(pc.index_in(asked, value_set=known), -1).to_numpy(zero_copy_only=False)
        stops = np.frombuffer(row["list_ends"], _U4).astype(np.int64)
        self.stop, self.start = stops, np.append(np.zeros(1, np.int64), stops[:-1])[:len(stops)]
        self.deltas = np.frombuffer(row["deltas"], _U4)
        self.first = np.frombuffer(row["first"], _U4).astype(np.int64)
        self.cache: dict[int, np.ndarray] = {}

    def counts(self) -> np.ndarray:
        """Number of tokens of each term asked for."""
        there = self.where >= 0
        out = np.zeros(len(self.where), np.int64)
        out[there] = (self.stop - self.start)[self.where[there]]
        return out

    def positions(self, term: int) -> np.ndarray:
        if term not in self.cache:
            at = self.where[term]
            self.cache[term] = np.cumsum(self.deltas[self.start[at]:self.stop[at]], dtype=np.int64)
        return self.cache[term]

    def phrase(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Start positions of an exact phrase."""
        order = np.argsort(counts[terms], kind="stable")
        found = self.positions(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            other = self.positions(terms[k])
            at = np.searchsorted(other, found + k)
            found = found[other[np.minimum(at, len(other) - 1)] == found + k]
        return found

    def within(self, terms: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Shortest spans (start, end) of at most `words` words of one document that end at one of the terms and hold all of them."""
        terms = np.unique(terms)
        rare = self.positions(terms[np.argmin(counts[terms])])
        ends = np.unique(np.concatenate([self.positions(t) for t in terms]))
        at = np.searchsorted(rare, ends, "right") - 1
        ends = ends[(at >= 0) & (ends - rare[np.maximum(at, 0)] < words)]
        start = ends.copy()
        for t in terms:
            at = np.searchsorted(self.positions(t), ends, "right") - 1
            start = np.where(at >= 0, np.minimum(start, self.positions(t)[np.maximum(at, 0)]), -words)
        same = np.searchsorted(self.first, start, "right") == np.searchsorted(self.first, ends, "right")
        good = (start >= 0) & (ends - start < words) & same
        return start[good], ends[good] + 1


class Queries:
    """Phrases of one block of test items: term numbers, and the items each phrase comes from."""

    def __init__(self, items: list[tuple], window: int | None):
        ids: dict[bytes, int] = {}
        phrases: dict[tuple, set] = {}
        for item, text in items:
            for w in words_of(pa.array([text], pa.string()), lower=True, breaks=NO_LETTER):
                terms = [ids.setdefault(w.bytes_of(i), len(ids)) for i in range(len(w.start))]
                size = min(window or len(terms), len(terms))
                for i in range(len(terms) - size + 1 if terms else 0):
                    phrases.setdefault(tuple(terms[i:i + size]), set()).add(item)
        self.terms = list(ids)
        self.phrases = [np.array(p) for p in phrases]
        self.items = [sorted(x, key=lambda v: (v is None, v)) for x in phrases.values()]

    def possible(self, counts: np.ndarray) -> np.ndarray:
        """Phrases all of whose terms occur."""
        if not self.phrases:
            return np.zeros(0, np.int64)
        flat, sizes = np.concatenate(self.phrases), np.array([len(p) for p in self.phrases])
        return np.flatnonzero(np.logical_and.reduceat(counts[flat] > 0, np.cumsum(sizes) - sizes))


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int | None) -> Iterator[Queries]:
    """The test items, in blocks of about BLOCK_BYTES of text."""
    rows = benchmark.select(F.col(item_id).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    for i in range(n):
        yield Queries([(r["item"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()], window)


def search(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per indexed document: doc_id, row_key, n_words, spans (words inside occurrences), items (ids with an occurrence).

    A query is each run of `window` words of an item, or the whole of a shorter one.
    """
    item_type = benchmark.schema[item_id].dataType.simpleString()
    doc_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"shard bigint, place int, doc_id {doc_type}, row_key bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<{item_type}>"

    arrow_item = to_arrow_type(benchmark.schema[item_id].dataType)

    def one_pass(q: Queries) -> DataFrame:
        shared = index.sparkSession.sparkContext.broadcast((q.terms, q.phrases, q.items))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Queries.__new__(Queries)
            mine.terms, mine.phrases, mine.items = shared.value
            asked = pa.array(mine.terms, pa.binary())
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_buffer() for c in ("first", "terms", "term_ends", "list_ends", "deltas")}
                    post = Postings(row, asked)
                    yield _answer(batch.slice(k, 1), post, mine, arrow_item)

        return index.mapInArrow(run, schema)

    found = [one_pass(q) for q in blocks(benchmark, item_id, text, window)]
    if len(found) == 1:
        return found[0].drop("shard", "place")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("shard", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("row_key").alias("row_key"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")).drop("shard", "place")


def _answer(shard: pa.RecordBatch, post: Postings, q: Queries, item_type: pa.DataType) -> pa.RecordBatch:
    counts = post.counts()
    first = post.first
    docs = len(first) - 1
    edge = np.zeros(int(first[-1]) + 2, np.int32)
    pairs: list[tuple[np.ndarray, int]] = []
    for p in q.possible(counts):
        at = post.phrase(q.phrases[p], counts)
        if len(at):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + len(q.phrases[p]), -1)
            pairs.append((np.unique(np.searchsorted(first, at, "right") - 1), p))
    inside = np.concatenate([[False], np.cumsum(edge) > 0])
    step = np.diff(inside.astype(np.int8))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    owner = np.searchsorted(first, begin, "right") - 1
    spans = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(docs + 1)).astype(np.int32), pa.StructArray.from_arrays(
        [pa.array(begin - first[owner], pa.int64()), pa.array(end - first[owner], pa.int64())], ["start", "end"]))
    items: list[set] = [set() for _ in range(docs)]
    for hit, p in pairs:
        for d in hit:
            items[d].update(q.items[p])
    listed = [sorted(x for x in s if x is not None) for s in items]
    ids, keys = shard.column("doc_ids").flatten(), shard.column("row_keys").flatten()
    number = np.repeat(shard.column("shard").to_numpy(zero_copy_only=False), docs)
    return pa.record_batch([pa.array(number), pa.array(np.arange(docs), pa.int32()), ids, keys, pa.array(np.diff(first) - 1, pa.int64()), spans,
                            pa.array(listed, pa.list_(item_type))], names=["shard", "place", "doc_id", "row_key", "n_words", "spans", "items"])


def near(index: DataFrame, benchmark: DataFrame, words: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item, start, end: spans of at most `words` words that hold all terms of an item, in any order."""
    item_type = benchmark.schema[item_id].dataType.simpleString()
    doc_type = index.schema["doc_ids"].dataType.elementType.simpleString()

    def one_pass(q: Queries) -> DataFrame:
        shared = index.sparkSession.sparkContext.broadcast((q.terms, q.phrases, q.items))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Queries.__new__(Queries)
            mine.terms, mine.phrases, mine.items = shared.value
            asked = pa.array(mine.terms, pa.binary())
            for batch in batches:
                for k in range(batch.num_rows):
                    post = Postings({c: batch.column(c)[k].as_buffer() for c in ("first", "terms", "term_ends", "list_ends", "deltas")}, asked)
                    counts, ids = post.counts(), batch.column("doc_ids").slice(k, 1).flatten()
                    for p in mine.possible(counts):
                        start, end = post.within(mine.phrases[p], counts, words)
                        owner = np.searchsorted(post.first, start, "right") - 1
                        for item in mine.items[p] if len(start) else ():
                            yield pa.record_batch([ids.take(pa.array(owner)), pa.array([item] * len(start)), pa.array(start - post.first[owner], pa.int64()),
                                                   pa.array(end - post.first[owner], pa.int64())], names=["doc_id", "item", "start", "end"])

        return index.mapInArrow(run, f"doc_id {doc_type}, item {item_type}, start bigint, end bigint")

    out = None
    for q in blocks(benchmark, item_id, text, None):
        out = one_pass(q) if out is None else out.unionByName(one_pass(q))
    return out


def covered(spans):
    """Words inside at least one of the spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(F.array_sort(spans), start, lambda acc, s: F.struct(
        F.greatest(acc["to"], s["end"]).alias("to"), (acc["n"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(acc["to"], s["start"]))).alias("n")), lambda acc: acc["n"])


def judge(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = search(build_index(docs, doc_id, text), benchmark, window=window)
    names = F.array_sort(F.array_distinct(F.transform("items", lambda x: x.cast("string"))))
    return found.withColumn("n_hit", covered(F.col("spans"))).withColumn("names", names).select(
        "doc_id", "row_key", "n_words", "n_hit", F.size("names").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without any occurrence, with all their columns. Only the keys of contaminated rows are joined."""
    key = free_name(docs, "row_key")
    bad = store(judge(docs, benchmark, doc_id, text, window).filter("contaminated").select(F.col("row_key").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, row_key(doc_id, text)).join(bad, key, "left_anti").select(*docs.columns)
