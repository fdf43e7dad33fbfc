"""Bloom filters of 64-bit numbers that are built and tested inside Spark tasks.

The filter is split into segments of 2^16 bits, and a number sets all its bits in one segment, so segments are merged independently from
per-task lists of positions. It has BITS_A_ROW bits a row, up to MAX_BITS in all (256 MB): that bounds what is collected and
broadcast. Beyond it the filter grows fuller and lets more through; it never rejects what it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.words import mix

SEGMENT_BITS = 1 << 16
BITS_A_ROW = 16
MAX_BITS = 1 << 31
PROBES = 4


def segments_for(rows: int) -> int:
    return max(1, min(MAX_BITS, rows * BITS_A_ROW) // SEGMENT_BITS)


def probes(numbers: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each number and its PROBES bit positions there."""
    h = mix(numbers.astype(np.uint64))
    place = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    more = mix(h ^ np.uint64(0x9E3779B97F4A7C15))
    shifts = np.arange(PROBES, dtype=np.uint64) * np.uint64(16)
    return place.astype(np.int64), ((more[:, None] >> shifts) & np.uint64(0xFFFF)).astype(np.int64)


def contains(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers a filter may hold."""
    place, at = probes(numbers, len(bits) * 8 // SEGMENT_BITS)
    at += place[:, None] * SEGMENT_BITS
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def bloom_bits(numbers: DataFrame, least: int = 1) -> np.ndarray:
    """Bitmap (eight bits a byte) of the positions set by at least `least` (1 or 2) rows of the one bigint column."""
    segments = segments_for(numbers.count())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, bits = probes(batch.column(0).to_numpy(zero_copy_only=False), segments)
            each = np.sort(place[:, None] * SEGMENT_BITS + bits, axis=1)
            at, n = np.unique(each, return_counts=True)
            same = each[:, 1:][each[:, 1:] == each[:, :-1]]  # two probes of one row on one bit are one
            extra, times = np.unique(same, return_counts=True)
            n[np.searchsorted(at, extra)] -= times
            owner = at // SEGMENT_BITS
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            ends = np.append(cuts[1:], len(at))
            low = (at % SEGMENT_BITS).astype(np.uint16)
            once = [low[a:b].tobytes() for a, b in zip(cuts, ends)]
            twice = [low[a:b][n[a:b] > 1].tobytes() for a, b in zip(cuts, ends)]
            yield pa.record_batch([pa.array(owner[cuts], pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
                                  names=["segment", "once", "twice"])

    def merge(parts: pa.Table) -> pa.Table:
        count = np.zeros(SEGMENT_BITS, np.uint8)
        for once, twice in zip(parts.column("once"), parts.column("twice")):
            for bits in (once, twice):
                at = np.frombuffer(bits.as_buffer(), np.uint16)
                count[at] = np.minimum(count[at] + 1, 2)
        return pa.table({"segment": parts.column("segment").slice(0, 1), "bits": pa.array([np.packbits(count >= least).tobytes()], pa.binary())})

    merged = numbers.mapInArrow(build, "segment bigint, once binary, twice binary").groupBy("segment").applyInArrow(merge, "segment bigint, bits binary")
    whole = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for r in merged.toLocalIterator():  # at most MAX_BITS bits in all
        whole[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return whole.ravel()


def tested(rows: DataFrame, key: str, flag: str, least: int = 1) -> DataFrame:
    """`rows` plus a boolean column: false only where fewer than `least` rows have that bigint key."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom_bits(rows.select(key), least))
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            hit = contains(bits, batch.column(at).to_numpy(zero_copy_only=False))
            yield pa.record_batch([*batch.columns, pa.array(hit)], names=[*batch.schema.names, flag])

    return rows.mapInArrow(run, rows.withColumn(flag, F.lit(True)).schema)
