"""k-nearest-neighbour graph over vectors by cosine, without comparing all pairs.

Every row gets one code per band: the signs of its dot products with random planes. Rows that share the first bits of a code (as many bits
as make a block of about `most` / 2 rows) form a block, and each row keeps its nearest rows of the block. A block of more than `most` rows takes all
bits of the code; what is still too large, such as copies of one vector, is dealt out by id into blocks of about `most` rows, so that no block holds a hot group.
Refinement rounds then compare the neighbours of each row with each other, which finds what the bands have missed.

Blocks are bounded, so the work is rows x bands x `most`, and rounds x rows x (wide x k)^2. Vectors are compared inside tasks as matrix products.
Similarities are rounded to DIGITS digits before they are ranked; ties go to the lesser id. Rows with a null, empty or zero vector have no
neighbours. Ids are unique integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut, forget

DIGITS = 9
BANDS = 8
BITS = 24
MOST = 256
WIDE = 3
#: Similarities that a task holds at once.
CELLS = 1 << 18
#: Rows of a block, and queries, of the comparison of all pairs.
ROWS, ASKED = 4096, 2048


def planes(bands: int, bits: int, dim: int, seed: int) -> np.ndarray:
    """bands x bits normal vectors with entries 1 and -1."""
    return np.random.default_rng(seed).integers(0, 2, (bands * bits, dim)) * 2 - 1


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """id, v: vectors of length one. (As an expression, Catalyst would put the norm into the function of each element.)"""
    wide = vectors.filter(F.size(column) > 0).select("id", F.transform(column, lambda x: x.cast("double")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                norm = np.sqrt((x * x).sum(axis=1))
                keep = norm > 0
                yield pa.record_batch([batch.column(0).filter(pa.array(keep)), pa.array(list(x[keep] / norm[keep, None]), pa.list_(pa.float64()))], names=["id", "v"])

    return wide.mapInArrow(run, wide.schema)


def _coded(unit: DataFrame, bands: int, bits: int, seed: int) -> DataFrame:
    """id, v, codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            normals = planes(bands, bits, x.shape[1], seed).T.astype(float) if normals is None else normals
            signs = (np.round(x @ normals, DIGITS) >= 0).reshape(-1, bits)
            codes = (signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).reshape(batch.num_rows, bands)
            yield pa.record_batch([*batch.columns, pa.array(list(codes), pa.list_(pa.int64()))], names=["id", "v", "codes"])

    return unit.mapInArrow(run, unit.withColumn("codes", F.array(F.lit(0).cast("bigint"))).schema)


def _nearest_in_blocks(blocks: DataFrame, k: int) -> DataFrame:
    """id, neighbour, similarity of the `k` nearest rows inside each block; `blocks` has one column `rows` of structs (id, v)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ids, at = lists.flatten().field("id").to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            x = matrix(lists.flatten().field("v"))
            out, size = [[], [], []], 0
            for a, b in zip(at, at[1:]):
                order = a + np.argsort(ids[a:b], kind="stable")
                near = np.round(x[order] @ x[order].T, DIGITS)
                np.fill_diagonal(near, -np.inf)
                best = np.argsort(-near, axis=1, kind="stable")[:, :min(k, b - a - 1)]
                out[0].append(np.repeat(ids[order], best.shape[1]))
                out[1].append(ids[order][best].ravel())
                out[2].append(np.take_along_axis(near, best, axis=1).ravel())
                size += best.size
                if size >= CELLS:
                    yield _links(out)
                    out, size = [[], [], []], 0
            yield _links(out)

    return blocks.mapInArrow(run, "id bigint, neighbour bigint, similarity double")


def _links(out: list[list[np.ndarray]]) -> pa.RecordBatch:
    parts = [np.concatenate(o) if o else np.zeros(0) for o in out]
    return pa.record_batch([pa.array(parts[0].astype(np.int64)), pa.array(parts[1].astype(np.int64)), pa.array(parts[2].astype(float))],
                           names=["id", "neighbour", "similarity"])


def _gathered(rows: DataFrame, *block: str) -> DataFrame:
    """Bounded blocks as lists."""
    return rows.groupBy(*block).agg(F.collect_list(F.struct("id", "v")).alias("rows")).filter(F.size("rows") > 1).select("rows")


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k)


def blocks_of(coded: DataFrame, bits: int, most: int) -> DataFrame:
    """id, v, band, level, key, chunk: the block of each row in each band."""
    rows = coded.count()
    first = min(bits, max(0, math.ceil(math.log2(rows / (most / 2))))) if rows else 0
    keyed = coded.select("id", "v", F.posexplode("codes").alias("band", "code")).withColumn("key", F.shiftright("code", bits - first))
    full = cut(keyed.groupBy("band", "key").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("band", "key", F.lit(1).alias("level")))
    deep = keyed.join(full, ["band", "key"], "left_semi").groupBy("band", "code").agg(F.count("*").alias("c"))
    chunks = cut(deep.filter(F.col("c") > most).select("band", "code", F.ceil(F.col("c") / most).alias("chunks")))
    return keyed.join(full, ["band", "key"], "left").join(chunks, ["band", "code"], "left").select(
        "id", "v", "band", F.coalesce("level", F.lit(0)).alias("level"), F.when(F.col("level") == 1, F.col("code")).otherwise(F.col("key")).alias("key"),
        F.when(F.col("chunks").isNotNull(), F.pmod("id", "chunks")).otherwise(0).alias("chunk"))


def knn_graph(vectors: DataFrame, k: int = 10, bands: int = BANDS, bits: int = BITS, most: int = MOST, rounds: int = 2, seed: int = 0,
              wide: int = WIDE, column: str = "embedding") -> DataFrame:
    """id, neighbour, similarity, rank: up to `k` nearest rows of each row.

    Rounds work on lists of `wide` x `k`: a true neighbour that isn't close to the best ones is often close to a lesser one.
    """
    coded = cut(_coded(unit_vectors(vectors, column), bands, bits, seed))
    unit = coded.select("id", "v")
    near = cut(_best(_nearest_in_blocks(_gathered(blocks_of(coded, bits, most), "band", "level", "key", "chunk"), k * wide), k * wide))
    for _ in range(rounds):
        members = near.select(F.col("id").alias("block"), F.col("neighbour").alias("id")).unionByName(near.select(F.col("id").alias("block"), "id").distinct())
        suggested = _nearest_in_blocks(_gathered(members.join(unit, "id"), "block"), k * wide)
        better = cut(_best(suggested.unionByName(near.drop("rank")), k * wide))
        forget(near)
        near = better
    return near.filter(F.col("rank") <= k)


def _dealt(unit: DataFrame, name: str, most: int) -> DataFrame:
    """One column `name`: lists of about `most` rows (id, v), dealt out by a hash of the id."""
    blocks = max(1, math.ceil(unit.count() / most))
    return unit.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias(name)).select(name)


def all_pairs(vectors: DataFrame, queries: DataFrame, k: int = 10, column: str = "embedding") -> DataFrame:
    """The true `k` nearest rows of the query rows, to measure recall against.

    Every block of queries meets every block of rows: the work is queries x rows by nature. A task holds CELLS similarities at once and keeps the
    `k` best of a query in each block.
    """
    asked, rows = (cut(_dealt(cut(unit_vectors(df, column)), name, most)) for df, name, most in ((queries, "asked", ASKED), (vectors, "rows", ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                (ids, q), (own, x) = ((part.field("id").to_numpy(zero_copy_only=False), matrix(part.field("v"))) for part in (
                    batch.column(c).slice(pair, 1).flatten() for c in ("asked", "rows")))
                step, keep = max(1, CELLS // len(own)), min(k, len(own))
                for a in range(0, len(q), step):
                    some = ids[a:a + step]
                    near = np.round(q[a:a + step] @ x.T, DIGITS)
                    near[some[:, None] == own[None, :]] = -np.inf
                    least = -np.partition(-near, keep - 1, axis=1)[:, keep - 1]
                    of, at = np.nonzero(near >= least[:, None])
                    order = np.lexsort((own[at], -near[of, at], of))
                    of, at = of[order], at[order]
                    best = np.arange(len(of)) - np.searchsorted(of, of) < keep
                    yield _links([[some[of[best]]], [own[at[best]]], [near[of[best], at[best]]]])

    dealt = rows.repartition(vectors.sparkSession.sparkContext.defaultParallelism)  # a few large blocks are a small table
    found = dealt.crossJoin(asked).mapInArrow(run, "id bigint, neighbour bigint, similarity double")
    return _best(found.filter("id <> neighbour"), k)
