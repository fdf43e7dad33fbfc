"""Substring dedup: words covered by a window of WINDOW words that also starts earlier, found with FM-indexes.

Each window of WINDOW words has an anchor: the least hash of the ANCHOR-word runs inside it. Equal windows have equal anchors, so
neighbouring windows with one anchor form a segment, and all segments of an anchor go to one shard. Anchors are counted first (a
row per distinct anchor and piece of text); only segments whose anchor is at another place, too, by a Bloom filter of those anchors, are sent on. A false
positive costs a segment, never a result.

A shard of about SHARD_WORDS words builds an FM-index of its distinct segments and reads its segments backward through it: every window
has the interval of its occurrences, and with it the earliest place (document id, then word) where it starts. A window is
repeated if that is earlier than its own place; the words of repeated windows are reported as spans. No window is compared by hash: shards
number real words.

Hot anchors (at more than HOT_SEGMENTS places) would overload a shard. Their windows are sent one by one under a hash of the whole window,
pre-aggregated to the earliest place, and joined back by `join_hot`; that way is exact too and has no bound.

Spans come back as one row per document; documents and spans meet in one shuffle of the texts.

Defined cases: words are runs of bytes outside white space, unchanged. Null and empty texts have none. Places are ordered by document
id (null last) and word; rows with equal ids count as one document, so neither is earlier than the other at the same word. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bloom import bloom_bits, contains
from quillgraph.llm.common import join_hot, row_key, store
from quillgraph.llm.fm_index import FMIndex
from quillgraph.llm.words import Words, hash_words, joined, mix, words_of

WINDOW = 20
ANCHOR = 8
SHARD_WORDS = 1_000_000
HOT_SEGMENTS = 50_000
MOST_WINDOWS = 256
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
ABSENT = np.iinfo(np.int64).max


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on; size is a power of two."""
    out, have = h, 1
    while have < size:
        after = np.zeros_like(out)
        after[:max(0, len(out) - have)] = out[have:]
        out = mix(out * _STEP + after)
        have *= 2
    return out


def least_within(g: np.ndarray, size: int) -> np.ndarray:
    """Least of the `size` values from each place on."""
    have, out = 1, g
    while have * 2 <= size:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = size - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def segments(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first word, number of windows and anchor of each segment of a piece; and the anchor of every place that is one."""
    n = len(w.start)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none.astype(_U), none.astype(_U)
    width = WINDOW - ANCHOR + 1
    runs = run_hashes(hash_words(w), ANCHOR)
    anchor = least_within(runs, width)[:n - WINDOW + 1]
    row = np.repeat(np.arange(w.n), np.diff(w.first))
    at = np.flatnonzero(row[:n - WINDOW + 1] == row[WINDOW - 1:])
    if not len(at):
        return none, none, none.astype(_U), none.astype(_U)
    # a place is an anchor if a window over it has its hash as the least one: the greatest of those leasts equals it
    here = np.zeros(n + width - 1, _U)
    here[at + width - 1] = anchor[at]
    placed = runs[~least_within(~here, width)[:n] == runs]
    anchor = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    size = np.diff(np.append(new, len(at)))
    if size.max() > MOST_WINDOWS:  # long runs of one anchor: cut, so that patterns stay short
        parts = -(-size // MOST_WINDOWS)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(new, parts) + number * MOST_WINDOWS
        size = np.minimum(MOST_WINDOWS, np.repeat(new + size, parts) - begin)
        new = begin
    return at[new], size, anchor[new], placed


def count_anchors(docs: DataFrame, text: str = "text") -> DataFrame:
    """anchor, n (places), words (of segments): all anchors at more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column(0)):
                _, size, anchor, placed = segments(w)
                if len(anchor):
                    values, n = np.unique(placed, return_counts=True)
                    words = np.bincount(np.searchsorted(values, anchor), size + WINDOW - 1, len(values))
                    yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(words.astype(np.int32))],
                                          names=["anchor", "n", "words"])

    counted = docs.select(text).mapInArrow(run, "anchor bigint, n int, words int").groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    return store(counted.filter("n > 1"), "anchors")


def routed(docs: DataFrame, repeated: np.ndarray, hot: np.ndarray | None, shards: int, only_hot: bool = False) -> DataFrame:
    """shard, doc_id, row_key, start, n_words, content of the segments whose anchor may be repeated; hot ones as single windows of shard -1."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((repeated, hot))
    schema = docs.select(F.lit(0).cast("bigint").alias("shard"), "doc_id", "row_key", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit("").alias("content")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot_bits = shared.value
        for batch in batches:
            for w in words_of(batch.column(0)):
                at, size, anchor, _ = segments(w)
                keep = contains(bits, anchor)
                if hot_bits is not None:
                    burning = contains(hot_bits, anchor)
                    keep &= burning if only_hot else ~burning
                at, size, anchor = at[keep], size[keep], anchor[keep]
                if not len(at):
                    continue
                n_words = size + WINDOW - 1
                if only_hot:
                    at = np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    n_words = np.full(len(at), WINDOW)
                    shard = np.full(len(at), -1)
                else:
                    shard = (((mix(anchor) >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)
                data, place = joined(w)
                flat = data.tobytes()
                last = at + n_words - 1
                a, b = place[at].tolist(), (place[last] + w.end[last] - w.start[last]).tolist()
                content = pa.array([flat[x:y] for x, y in zip(a, b)], pa.binary()).view(pa.string())
                row = np.searchsorted(w.first, at, "right") - 1
                mine = pa.array(row + w.row)
                yield pa.record_batch([pa.array(shard), batch.column(1).take(mine), batch.column(2).take(mine),
                                       pa.array((at - w.first[row]).astype(np.int32)), pa.array(n_words.astype(np.int32)), content], names=schema.names)

    return docs.select("text", "doc_id", "row_key").mapInArrow(run, schema)


def shard_spans(part: pa.Table) -> pa.Table:
    """row_key and spans (packed starts and ends of words) to remove, for the segments of one shard."""
    ids = part.column("doc_id").combine_chunks()
    start = part.column("start").to_numpy().astype(np.int64)
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    sorted_ids = ids.take(pa.array(order))
    step = np.ones(len(order), bool)
    if len(order) > 1:
        same = pc.equal(sorted_ids[1:], sorted_ids[:-1]).to_numpy(zero_copy_only=False)
        both_null = (~sorted_ids.is_valid().to_numpy(zero_copy_only=False))
        step[1:] = ~(np.where(same == None, False, same).astype(bool) | (both_null[1:] & both_null[:-1]))  # noqa: E711
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    value = (rank << 32) + start
    content = part.column("content").combine_chunks()
    whole = next(words_of(content, piece=1 << 62))
    numbers = np.unique(hash_words(whole), return_inverse=True)[1].astype(np.int64) + 1
    size = np.diff(whole.first)
    # equal segments are one, at its earliest place
    code = pc.dictionary_encode(content).indices.to_numpy()
    first = np.full(code.max() + 1, ABSENT)
    np.minimum.at(first, code, value)
    sample = np.empty(len(first), np.int64)
    sample[code] = np.arange(len(code))
    begin = np.concatenate([[0], np.cumsum(size[sample] + 1)])
    text = np.zeros(begin[-1], np.int64)
    place = np.full(len(text), ABSENT)
    spread = np.arange(size[sample].sum()) - np.repeat(np.cumsum(size[sample]) - size[sample], size[sample])
    target = np.repeat(begin[:-1], size[sample]) + spread
    text[target] = numbers[np.repeat(whole.first[:-1][sample], size[sample]) + spread]
    fits = spread <= np.repeat(size[sample] - WINDOW, size[sample])
    place[target[fits]] = (np.repeat(first, size[sample]) + spread)[fits]
    index = FMIndex(text, WINDOW, place)
    earliest = index.least_of_windows(text, begin[:-1], begin[1:] - 1, ABSENT)
    repeated = (earliest < place) & (place < ABSENT)
    edge = np.zeros(len(text) + 1, np.int32)
    at = np.flatnonzero(repeated)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    inside = np.concatenate([[False], np.cumsum(edge) > 0])
    change = np.diff(inside.astype(np.int8))
    run_start, run_end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    owner = np.searchsorted(begin, run_start, "right") - 1
    # the earliest occurrence loses its runs, every later one all its words
    later = np.flatnonzero(value > first[code])
    leading = np.flatnonzero(value == first[code])
    lead_code = code[leading]
    from_run, to_run = np.searchsorted(owner, lead_code), np.searchsorted(owner, lead_code, "right")
    n = to_run - from_run
    which = np.repeat(from_run, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = np.repeat(start[leading] - begin[:-1][lead_code], n)
    keys = part.column("row_key").to_numpy()
    key = np.concatenate([keys[later], np.repeat(keys[leading], n)])
    lo = np.concatenate([start[later], base + run_start[which]])
    hi = np.concatenate([start[later] + size[later], base + run_end[which]])
    return pack(key, lo, hi)


def pack(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    """One row per key with its spans as 32-bit numbers; spans that touch are one."""
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    if len(key):
        reach = np.maximum.accumulate(hi + (np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) << 40))
        group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) << 40
        new = np.concatenate([[True], (lo + group)[1:] > reach[:-1]])
        at = np.flatnonzero(new)
        key, lo, hi = key[at], lo[at], np.maximum.reduceat(hi, at)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    flat = np.stack([lo, hi], axis=1).astype(np.uint32)
    packed = [flat[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(key)))]
    return pa.table({"row_key": pa.array(key[first], pa.int64()), "spans": pa.array(packed, pa.binary())})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """row_key, spans (several rows per key) of the words to remove from `docs` (doc_id, text, row_key)."""
    anchors = count_anchors(docs)
    total = anchors.agg(F.sum("words"), F.max("n")).first()
    shards = max(1, -(-(total[0] or 0) // SHARD_WORDS))
    repeated = bloom_bits(anchors.select("anchor"))
    hot = bloom_bits(anchors.filter(F.col("n") > HOT_SEGMENTS).select("anchor")) if (total[1] or 0) > HOT_SEGMENTS else None
    found = routed(docs, repeated, hot, shards).groupBy("shard").applyInArrow(shard_spans, "row_key bigint, spans binary")
    return found if hot is None else found.unionByName(hot_spans(docs, repeated, hot, shards))


def hot_spans(docs: DataFrame, repeated: np.ndarray, hot: np.ndarray, shards: int) -> DataFrame:
    """The same for windows of hot anchors, one window at a time."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("start").alias("start"))
    windows = store(routed(docs, repeated, hot, shards, only_hot=True).select(
        F.sha2(F.col("content").cast("binary"), 256).alias("window"), place.alias("place"), "row_key"), "hot_windows")
    firsts = store(windows.groupBy("window").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1"), "hot_firsts")
    later = join_hot(windows, firsts, "window", "n").filter("place > first").select("row_key", F.col("place.start").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = batch.column(1).to_numpy().astype(np.int64)
            yield from pack(batch.column(0).to_numpy(), lo, lo + WINDOW).to_batches()

    return later.mapInArrow(run, "row_key bigint, spans binary")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, n_words, n_removed, kept_sha256 (of the kept words joined by one space), removed (spans)."""
    base = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"))
    spans = repeated_spans(base).groupBy("row_key").agg(F.collect_list("spans").alias("spans"))
    schema = base.select("doc_id", "row_key", F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.lit("").alias("kept_sha256"),
                         F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))).alias("removed")).schema
    joined_rows = base.join(spans, "row_key", "left").select("text", "doc_id", "row_key", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, at = batch.column(3), 0
            for w in words_of(batch.column(0)):
                data, place = joined(w)
                flat, stop = data.tobytes(), place + (w.end - w.start)
                removed, digest, cut = [], [], []
                for i in range(w.n):
                    got = lists[at].values
                    at += 1
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    runs = _union(got)
                    edges = [a, *(x + a for r in runs for x in r), b]
                    kept = [flat[place[x]:stop[y - 1]] for x, y in zip(edges[::2], edges[1::2]) if x < y]
                    digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    removed.append(sum(y - x for x, y in runs))
                    cut.append([{"start": int(x), "end": int(y)} for x, y in runs])
                yield pa.record_batch([batch.column(1).slice(w.row, w.n), batch.column(2).slice(w.row, w.n), pa.array(np.diff(w.first), pa.int64()),
                                       pa.array(removed, pa.int64()), pa.array(digest), pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                                      names=schema.names)

    return joined_rows.mapInArrow(run, schema)


def _union(parts: pa.Array | None) -> list[tuple[int, int]]:
    """Disjoint runs in order from packed spans."""
    if parts is None or not len(parts):
        return []
    spans = np.concatenate([np.frombuffer(p.as_buffer(), np.uint32).reshape(-1, 2) for p in parts])
    out: list[list[int]] = []
    for lo, hi in spans[np.argsort(spans[:, 0], kind="stable")].tolist():
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]
