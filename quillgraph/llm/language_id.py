"""Language identification with a blended-spectrum string kernel.

Texts are folded to letters (lower case; a run of anything else is one blank), and k(x, y) counts the n-grams of orders
1 to ORDER that occur in both, whatever their frequency, divided by the root of k(x, x) k(y, y). An n-gram is a hash into
2^GRAM_BITS places, so memory doesn't depend on script or vocabulary.

`fit` takes a bounded sample: per language ROWS_PER_LANGUAGE different labelled texts, least by a hash of the text, of which
LANDMARKS_PER_LANGUAGE are landmarks. With K the kernel of sample and landmarks and M that of the landmarks, the Nystrom map
is M^(-1/2); one-versus-rest ridge regression on K M^(-1/2) gives one weight vector per language. Only the n-gram
sets of the sample come to the driver. Prediction uses every labelled language's output on the whole text: batches of presence
rows times landmarks times weights.

Sampling thins the hashes by each language's measured number before it ranks them, so a hot language or a hot text moves no more
rows than another. Prediction is a map without a shuffle. The model is broadcast: one number per language and n-gram place, 2^GRAM_BITS places at most.

Defined cases: a null text or one without a letter is `und` with score 0; so is every text if nothing can be learned. Texts without
a label, or without letters, aren't learned from. Ties between languages go to the first by name. Repeated rows get the same
answer. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import free_name, store

UNKNOWN = "und"
ORDER = 4
GRAM_BITS = 17
ROWS_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 1e-3
BATCH = 64
SLICE = 1 << 20
_STEP = np.uint32(0x9E3779B1)


class _Fold:
    """Code points to their folded code points (0: no letter), a table for the whole Basic Multilingual Plane and beyond."""

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, np.uint32)
        for lo, hi in ((0, 0xD800), (0xE000, 0x33480)):
            chars = [chr(i) for i in range(lo, hi)]
            self.table[lo:hi] = [ord(c.lower()[0]) if c.isalpha() else 0 for c in chars]


_FOLD: list[_Fold] = []


def fold_table() -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_Fold())
    return _FOLD[0].table


def grams(codes: np.ndarray, seen: np.ndarray, order: int = ORDER, bits: int = GRAM_BITS) -> bool:
    """Set the places of all n-grams of a text (folded code points) in `seen`; false if it has no letter."""
    letter = codes != 0
    if not letter.any():
        return False
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    codes = np.concatenate([np.zeros(1, np.uint32), codes[keep]])
    shift = np.uint32(32 - bits)
    for lo in range(0, len(codes), SLICE):
        part = codes[lo:lo + SLICE + order - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(order):
            h = (h[:len(part) - n] ^ part[n:]) * _STEP
            h ^= h >> np.uint32(15)
            seen[(h * np.uint32(0x85EBCA6B) + np.uint32(n)) >> shift] = 1
            h = h[:-1] if len(h) else h
            if not len(h):
                break
    return True


def presence(texts: pa.Array, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(row, 0/1 places, has a letter) for each text; the array is reused."""
    seen = np.zeros(1 << GRAM_BITS, np.uint8)
    for i, t in enumerate(texts):
        t = t.as_py()
        seen[:] = 0
        if not t:
            yield i, seen, False
            continue
        codes = table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
        yield i, seen, grams(codes, seen)


@dataclass
class Model:
    """columns: places that occur in landmarks. projection: presence of the landmarks there, times the weight of each for each language.

    Scores are kernel times weights, and the kernel is presence rows times landmarks; the second product is taken once.
    """

    languages: list[str]
    columns: np.ndarray
    projection: np.ndarray
    bias: np.ndarray

    def scores(self, batch: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return (batch @ self.projection) / norms[:, None] + self.bias


def sample(docs: DataFrame, text: str, lang: str, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """lang, rank, text: `rows` different labelled texts of each language (all if there are fewer), least by a hash.

    Only hashes are compared, and only about three times `rows` of them reach the ranking, so neither a large language nor a
    text with very many copies gathers in a task. Texts are fetched for the chosen hashes.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    near = labelled.select("lang", "h").join(store(sizes, "languages"), "lang").filter(
        F.pmod("h", F.lit(1 << 20)) * F.col("n") <= F.lit(3 * rows << 20)).select("lang", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h"))
    chosen = store(near.withColumn("rank", rank).filter(F.col("rank") <= rows), "sample")
    return labelled.join(chosen, ["lang", "h"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE,
        landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model | None:
    """Model from labelled rows; None if there are none."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table()
        for batch in batches:
            found = [np.flatnonzero(seen).astype(np.int32).tobytes() for _, seen, _ in presence(batch.column("text"), table)]
            yield pa.record_batch([batch.column("lang"), batch.column("rank"), pa.array(found, pa.binary())], names=["lang", "rank", "places"])

    got = sample(docs, text, lang, rows).mapInArrow(places, "lang string, rank int, places binary").orderBy("lang", "rank").collect()
    if not got:
        return None
    sets = [np.frombuffer(r["places"], np.int32) for r in got]
    chosen = [i for i, r in enumerate(got) if r["rank"] <= landmarks]
    columns = np.unique(np.concatenate([sets[i] for i in chosen]))

    def rows_of(indices: list[int]) -> np.ndarray:
        out = np.zeros((len(indices), len(columns)), np.float32)
        for k, i in enumerate(indices):
            at = np.searchsorted(columns, sets[i])
            at = np.minimum(at, len(columns) - 1)
            out[k, at[columns[at] == sets[i]]] = 1
        return out

    marks = rows_of(chosen) / np.sqrt([len(sets[i]) for i in chosen]).astype(np.float32)[:, None]
    blocks = [np.arange(a, min(a + 256, len(got))) for a in range(0, len(got), 256)]
    kernel = np.concatenate([rows_of(list(b)) @ marks.T for b in blocks]).astype(float)
    kernel /= np.sqrt([len(s) for s in sets])[:, None]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values[-1]
    nystrom = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ nystrom
    languages = sorted({r["lang"] for r in got})
    wanted = np.array([[1.0 if r["lang"] == name else -1.0 for name in languages] for r in got])
    mean, goal = features.mean(axis=0), wanted.mean(axis=0)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ centred + ridge * len(got) * np.eye(features.shape[1]), centred.T @ (wanted - goal))
    projection = marks.T @ (nystrom @ solved).astype(np.float32)
    return Model(languages, columns, projection, (goal - mean @ solved).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` plus lang_pred and score (0 to 1, from the best output of the regressions, which aims at -1 or 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.languages, model.columns, model.projection, model.bias))
    at = docs.columns.index(text)
    schema = docs.select("*", F.lit("").alias(lang_pred), F.lit(0.0).alias(score)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = fold_table(), shared.value and Model(*shared.value)
        for batch in batches:
            best = np.zeros(batch.num_rows)
            names = np.full(batch.num_rows, UNKNOWN, object)
            if known is not None:
                block = np.zeros((BATCH, len(known.columns)), np.float32)
                norms, rows = np.ones(BATCH), []

                def flush() -> None:
                    out = known.scores(block[:len(rows)], norms[:len(rows)].astype(np.float32))
                    win = out.argmax(axis=1)
                    names[rows] = np.array(known.languages, object)[win]
                    best[rows] = np.clip((1 + out[np.arange(len(rows)), win].astype(float)) / 2, 0, 1)
                    rows.clear()

                for i, seen, has in presence(batch.column(at), table):
                    if not has:
                        continue
                    block[len(rows)] = seen[known.columns]
                    norms[len(rows)] = np.sqrt(np.count_nonzero(seen))
                    rows.append(i)
                    if len(rows) == BATCH:
                        flush()
                if rows:
                    flush()
            arrays = [*batch.columns, pa.array(names, pa.string()), pa.array(best)]
            yield pa.record_batch(arrays, schema=pa.schema([*batch.schema, pa.field(lang_pred, pa.string()), pa.field(score, pa.float64())]))

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of `docs` whose language could be told, with all their columns."""
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    return predict(docs, model, text, pred, score).filter(F.col(pred) != UNKNOWN).select(*docs.columns)
