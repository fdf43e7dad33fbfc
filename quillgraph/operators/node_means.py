"""Means of the vectors that a node's edges lead to, without a vector per edge.

Nodes are numbered inside parts of bounded size, and the edges are stored as runs of positions from one part to another. Vectors are cut into
slices of SLICE numbers. Every pair of a part and a slice is one group: the slices of the other parts' vectors come to it part by part, each followed by the edges into
that part. So a task keeps two matrices of VERTICES_PER_PART x SLICE numbers at most, a vector moves once per part (not once per edge), and an edge once per slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.neighbours import matrix
from quillgraph.session import cut, forget

VERTICES_PER_PART, SLICE = 1 << 19, 32
#: Edges in a stored run, vectors in a piece.
RUN, PIECE = 4096, 512
#: Vectors of no more different numbers are sent as bytes.
FEW = 8


class Places:
    """id, part, pos of every node that has a vector or an edge, and the edges by part and position."""

    def __init__(self, edges: DataFrame, ids: DataFrame):
        edges = cut(edges.select("src", "dst", "weight").filter("src IS NOT NULL AND dst IS NOT NULL"))
        found = cut(ids.select("id").filter("id IS NOT NULL").union(edges.select("src")).distinct())
        self.parts = max(1, math.ceil(found.count() / VERTICES_PER_PART))
        self.vertices = cut(found.select("id", F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int").alias("part")).withColumn(
            "pos", (F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1).cast("int")))
        self.rows = (self.vertices.agg(F.max("pos")).first()[0] or 0) + 1
        at = lambda end, part, pos: self.vertices.select(F.col("id").alias(end), F.col("part").alias(part), F.col("pos").alias(pos)).hint("merge")
        placed = edges.join(at("src", "part", "s"), "src").join(at("dst", "origin", "d"), "dst")
        count = max(1, math.ceil(edges.count() / (RUN * self.parts * self.parts)))
        ends = F.array_sort(F.collect_list(F.struct("s", "d", F.col("weight").alias("w"))))
        packed = placed.groupBy("part", "origin", F.pmod(F.xxhash64("s", "d"), F.lit(count)).alias("run")).agg(ends.alias("e"))
        self.runs = packed.select("part", "origin", F.col("e.s").alias("to"), F.col("e.d").alias("from"), F.col("e.w").alias("weight"))
        self._edges = edges

    def stored(self) -> "Places":
        self.runs = cut(self.runs)
        forget(self._edges)
        return self

    def on(self, frame: DataFrame) -> DataFrame:
        """`frame` (id, ...) with part and pos."""
        return frame.join(self.vertices.hint("merge"), "id")


def _packed(cells: np.ndarray) -> bytes:
    """Eight bytes with the number of different values (0: plain), these values, and the cells' numbers among them; drawn vectors have three."""
    cells = np.ascontiguousarray(cells, np.float64)
    values = np.unique(cells) if len(np.unique(cells[:4])) <= FEW else ()
    if 0 < len(values) <= FEW:
        return np.int64(len(values)).tobytes() + values.tobytes() + np.searchsorted(values, cells).astype(np.uint8).tobytes()
    return np.int64(0).tobytes() + cells.tobytes()


def _unpacked(packed: bytes, rows: int) -> np.ndarray:
    few = int(np.frombuffer(packed, np.int64, 1)[0])
    if not few:
        return np.frombuffer(packed, np.float64, offset=8).reshape(rows, -1)
    return np.frombuffer(packed, np.float64, few, 8)[np.frombuffer(packed, np.uint8, offset=8 + 8 * few)].reshape(rows, -1)


def _slicer(size: int, piece: int):
    """Batch function over part, pos, vector: slices of `size` numbers of up to `piece` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(2))
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                for a in range(0, len(mine), piece):
                    at = mine[a:a + piece]
                    pos = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), batch.column(1).take(pa.array(at)))
                    for k in range(0, x.shape[1], size):
                        yield pa.record_batch([pa.array([p], pa.int32()), pa.array([k // size], pa.int32()), pos, pa.array([_packed(x[at, k:k + size])])], names=["part", "slice", "pos", "cells"])

    return run


def _adder(rows: int, width: int, size: int, piece: int, weighted: bool):
    """Batch function over groups sorted by part, slice and turn (vectors of a part, edges out of it, ...): pieces of mean slices."""

    def results(part: int, k: int, sums: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        for begin in range(0, rows, piece):
            at = np.flatnonzero(weight[begin:begin + piece] > 0) + begin
            if len(at):
                mean = sums[at, :min(size, width - k * size)] / weight[at, None]
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([begin // piece], pa.int32()), pa.array([k], pa.int32()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
                                       pa.array([np.ascontiguousarray(mean).tobytes()])], names=["part", "piece", "slice", "pos", "cells"])

    def add(sums: np.ndarray, weight: np.ndarray, front: np.ndarray, copies: np.ndarray, to: np.ndarray, at: np.ndarray, w: np.ndarray | None) -> None:
        live = np.flatnonzero(copies[at] > 0)
        if not len(live):
            return
        to, at = to[live], at[live]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))  # a run is sorted by its ends
        values, counts = front[at], copies[at]
        if weighted:
            w = w[live]
            if (w < 0).any():
                raise ValueError("a weight is negative")
            values, counts = values * w[:, None], counts * w
        sums[to[first]] += np.add.reduceat(values, first, axis=0)
        weight[to[first]] += np.add.reduceat(counts, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, front = np.zeros((rows, size)), np.zeros((rows, size))
        weight, copies = np.zeros(rows), np.zeros(rows)
        group, source = None, None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("part", "slice", "turn")), strict=True)
            for i, (part, k, turn) in enumerate(keys):
                if group != (part, k):
                    if group is not None:
                        yield from results(*group, sums, weight)
                    group, source = (part, k), None
                    sums.fill(0)
                    weight.fill(0)
                if turn % 2:
                    if source == turn - 1:
                        to, at, w = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) if c != "weight" or weighted else None for c in ("to", "from", "weight"))
                        add(sums, weight, front, copies, to, at, w)
                    continue
                if source != turn:
                    front.fill(0)
                    copies.fill(0)
                    source = turn
                pos = batch.column("pos")[i].values.to_numpy(zero_copy_only=False)
                cells = _unpacked(batch.column("cells")[i].as_py(), len(pos))
                np.add.at(copies, pos, 1)  # a repeated id has a vector per row
                np.add.at(front[:, :cells.shape[1]], pos, cells)
        if group is not None:
            yield from results(*group, sums, weight)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batch function over pieces sorted by part, piece and slice, first the ids (slice -1): id, part, pos, vector."""
    key, known, ids, pos, cells = None, None, None, None, []

    def row() -> pa.RecordBatch:
        x = np.concatenate(cells, axis=1)
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        return pa.record_batch([ids.take(pa.array(np.searchsorted(known, pos))), pa.array(np.full(len(pos), key[0], np.int32)), pa.array(pos), values], names=["id", "part", "pos", "vector"])

    for batch in batches:
        for i, found in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "piece", "slice")), strict=True)):
            if key != found[:2]:
                if cells:
                    yield row()
                key, cells = found[:2], []
            at = batch.column("pos")[i].values.to_numpy(zero_copy_only=False)
            if found[2] < 0:
                known, ids = at, batch.column("ids")[i].values
            else:
                pos = at
                cells.append(np.frombuffer(batch.column("cells")[i].as_py()).reshape(len(pos), -1))
    if cells:
        yield row()


def means(places: Places, vectors: DataFrame, width: int, weighted: bool) -> DataFrame:
    """id, part, pos, vector (array): weighted mean of the vectors a node's edges lead to. `vectors` has part, pos and an array of `width` numbers."""
    slices = math.ceil(width / SLICE)
    pieces = vectors.select("part", "pos", "vector").mapInArrow(_slicer(SLICE, PIECE), "part int, slice int, pos array<int>, cells binary")
    everywhere = f"explode(sequence(0, {places.parts - 1})) AS part"
    new = pieces.selectExpr(everywhere, "slice", "2 * part AS turn", "pos", "cells", "CAST(NULL AS array<int>) AS to", "CAST(NULL AS array<int>) AS from", "CAST(NULL AS array<double>) AS weight")
    weight = "weight" if weighted else "CAST(NULL AS array<double>) AS weight"
    out = places.runs.selectExpr("part", f"explode(sequence(0, {slices - 1})) AS slice", "2 * origin + 1 AS turn", "CAST(NULL AS array<int>) AS pos",
                                 "CAST(NULL AS binary) AS cells", "to", "from", weight)
    groups = min(places.parts * slices, 10_000)
    deal = F.col("part") * slices + F.col("slice")
    met = new.union(out).repartitionById(groups, deal % groups).sortWithinPartitions("part", "slice", "turn")
    sums = met.mapInArrow(_adder(places.rows, width, SLICE, PIECE, weighted), "part int, piece int, slice int, pos array<int>, cells binary")
    kind = dict(places.vertices.dtypes)["id"]
    named = places.vertices.groupBy("part", F.expr(f"pos DIV {PIECE}").cast("int").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("e")).selectExpr(
        "part", "piece", "-1 AS slice", "e.pos AS pos", "CAST(NULL AS binary) AS cells", "e.id AS ids")
    every = named.union(sums.selectExpr("*", f"CAST(NULL AS array<{kind}>) AS ids"))
    return every.repartition("part", "piece").sortWithinPartitions("part", "piece", "slice").mapInArrow(_joined, f"id {kind}, part int, pos int, vector array<double>")
