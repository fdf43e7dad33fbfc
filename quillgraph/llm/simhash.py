"""SimHash fingerprints, pigeonhole block joins and components of near copies.

Fingerprints are made inside tasks from whole texts with numpy. Equal fingerprints are one class. The 64 bits are cut
into BLOCKS blocks; two fingerprints with at most `distance` differing bits agree on at least BLOCKS - distance of
them, so classes are joined on every choice of that many blocks (20 keys of 31 to 33 bits for 6 blocks and distance
3) and each pair of a bucket is verified by its Hamming distance.

Buckets hold 8-byte fingerprints of different classes only, never rows or texts, so thousands of copies are one entry. In a
bucket a breadth-first search links what is close: one link per class instead of all pairs. Buckets above
LARGE_BUCKET use shared neighbours instead, whose work is linear in the bucket: x and y differ in at most 3 bits
exactly if a value within 1 bit of x lies within 2 bits of y. No bucket is capped.

Defined cases: a null text has no words; texts without words have fingerprint 0 and are linked like any other. Rows with a
null id take part; a component without any id has a null component_id. Repeated rows are one class. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import free_name, join_hot, row_key, store
from quillgraph.llm.components import roots
from quillgraph.llm.words import Words, joined, loads, words_of

SEED = 42
SHINGLE = 3
DISTANCE = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
LARGE_BUCKET = 1 << 16
_U = np.uint64
# The primes of XXH64.
P1, P2, P3, P4, P5 = (_U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: A byte as eight counters of eight bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of spans of bytes; spans under 32 bytes are hashed together, longer ones one by one."""
    size = end - start
    h = size.astype(_U) + (_U(seed) + P5)
    at = start.copy()
    at8 = loads(data)
    left = np.where(size < 32, size, 0)
    rows = np.flatnonzero(left >= 8)
    while len(rows):
        k = _rotl(at8[at[rows]] * P2, 31) * P1
        h[rows] = _rotl(h[rows] ^ k, 27) * P1 + P4
        at[rows] += 8
        left[rows] -= 8
        rows = rows[left[rows] >= 8]
    rows = np.flatnonzero(left >= 4)
    h[rows] = _rotl(h[rows] ^ ((at8[at[rows]] & _U(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[rows] += 4
    left[rows] -= 4
    rows = np.flatnonzero(left > 0)
    while len(rows):
        h[rows] = _rotl(h[rows] ^ (data[at[rows]].astype(_U) * P5), 11) * P1
        at[rows] += 1
        left[rows] -= 1
        rows = rows[left[rows] > 0]
    h = (h ^ (h >> _U(33))) * P2
    h = (h ^ (h >> _U(29))) * P3
    h ^= h >> _U(32)
    for i in np.flatnonzero(size >= 32):
        h[i] = xxhash.xxh64_intdigest(data[start[i]:end[i]].tobytes(), seed)
    return h


def shingle_hashes(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle in text order, and the row each belongs to."""
    n = np.diff(w.first)
    row = np.repeat(np.arange(w.n), n)
    i = np.arange(len(w.start))
    stop = w.first[1:][row]
    chosen = np.flatnonzero((i + size <= stop) | ((i == w.first[:-1][row]) & (n[row] < size)))
    last = np.minimum(chosen + size, stop[chosen]) - 1
    data, place = joined(w)
    return xxh64(data, place[chosen], place[last] + (w.end[last] - w.start[last])), row[chosen]


def fold(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Fingerprint of each row: bits set in over half of its hashes."""
    out = np.zeros(rows, _U)
    if not len(h):
        return out
    first = np.flatnonzero(np.diff(row, prepend=-1))
    n = np.diff(np.append(first, len(row)))
    parts = -(-n // 255)
    begin = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    lanes = np.add.reduceat(LANES[h.view(np.uint8).reshape(-1, 8)], begin, axis=0)  # at most 255 a part: no counter overflows
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(parts) - parts, axis=0)
    bits = (2 * counts > n[:, None]).astype(np.uint8)
    out[row[first]] = np.packbits(bits, axis=1, bitorder="little").view(_U).ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and bigint fp (the fingerprint's 64 bits)."""
    frame = docs.select(text, *keep)
    schema = docs.select(*keep).withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fold(*shingle_hashes(w), w.n) for w in words_of(batch.column(0), lower=True)]
            fp = np.concatenate(parts) if parts else np.zeros(0, _U)
            yield pa.record_batch([*batch.columns[1:], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return frame.mapInArrow(run, schema)


def bucket_masks(blocks: tuple[int, ...] = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Signed 64-bit masks of every choice of len(blocks) - distance blocks."""
    edges = np.cumsum((0, *blocks))
    each = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(m) for m in combinations(each, len(blocks) - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_in_bucket(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected by pairs within `distance` bits, at most one per fingerprint."""
    if len(fps) > LARGE_BUCKET and distance == 3:
        return _by_shared_neighbours(fps)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    left = fps
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                front.extend(found)
    none = fps[:0]
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _by_shared_neighbours(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links for distance 3 in linear work: values within 1 bit of some x, looked up from all within 2 bits of y."""
    one = np.concatenate([[0], _U(1) << np.arange(64, dtype=_U)]).astype(_U)
    two = np.unique((one[:, None] ^ one[None, :]).ravel())
    hubs = np.concatenate([fps ^ m for m in one])
    owner = np.tile(fps, len(one))
    order = np.argsort(hubs, kind="stable")
    hubs, owner = hubs[order], owner[order]
    first = np.flatnonzero(np.diff(hubs, prepend=hubs[:1] ^ _U(1)))
    hubs, owner = hubs[first], np.minimum.reduceat(owner, first)  # all owners of a value are within 2 bits of each other
    a, b = [], []
    for m in two:
        want = fps ^ m
        at = np.minimum(np.searchsorted(hubs, want), len(hubs) - 1)
        hit = (hubs[at] == want) & (owner[at] != fps)
        pairs = np.unique(np.stack([owner[at][hit], fps[hit]]), axis=1)
        a.append(pairs[0])
        b.append(pairs[1])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return pairs[0], pairs[1]


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links between different fingerprints; `classes` has one row per fingerprint in column fp."""
    masks = bucket_masks(distance=distance)
    keyed = classes.select("fp", F.inline(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("v")) for t, m in enumerate(masks)])))
    buckets = keyed.groupBy("t", "v").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            at = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).view(_U)
            size = np.diff(at)
            a, b = [], []
            pair = at[:-1][size == 2]
            x, y = values[pair], values[pair + 1]
            near = np.bitwise_count(x ^ y) <= distance
            a.append(x[near])
            b.append(y[near])
            for i in np.flatnonzero(size > 2):
                x, y = close_in_bucket(values[at[i]:at[i + 1]], distance)
                a.append(x)
                b.append(y)
            yield pa.record_batch([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    return buckets.mapInArrow(run, "a bigint, b bigint").distinct()


def rooted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, fp, component_id (least doc_id reachable by links), root (tells components apart)."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("row_key"))
    prints = store(fingerprints(base, "text", ("doc_id", "row_key")), "fingerprints")
    classes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    linked = roots(links(classes.select("fp"), distance))
    members = store(classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
                    .select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")), "members")
    whole = store(members.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")), "components")
    named = store(join_hot(members, whole, "root", "size").select("fp", "component_id", "root", "n"), "named")
    return join_hot(prints, named, "fp", "n").select("doc_id", "row_key", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, fp, component_id (least doc_id reachable by links)."""
    return rooted(docs, doc_id, text, distance).drop("root")


def hex_print(fp) -> object:
    """A bigint fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` of which each component keeps one: that with the least id (of rows without any id, one)."""
    return one_of_each(docs, rooted(docs, doc_id, text), doc_id, text)


def one_of_each(docs: DataFrame, grouped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each root; `grouped` has doc_id, row_key and root of every row. Ids needn't be unique or present."""
    found = store(grouped.select("doc_id", "row_key", "root"), "near")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row_key").alias("k"))
    best = found.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.k").alias("k")).distinct()
    key = free_name(docs, "row_key")
    marked = docs.withColumn(key, row_key(doc_id, text))
    kept = marked.join(best.withColumnRenamed("k", key), key, "left_semi")
    twins = found.groupBy("row_key").count().filter("count > 1").select(F.col("row_key").alias(key))
    twins = store(twins, "twins")
    if twins.isEmpty():
        return kept.select(*docs.columns)
    one = kept.join(twins, key, "left_semi").dropDuplicates([key])
    return kept.join(twins, key, "left_anti").unionByName(one).select(*docs.columns)
