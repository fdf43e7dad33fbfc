"""Fill-in-the-middle rewriting of whole texts.

A text is cut into units (leading white space plus a run of other characters; white space at the end is a unit of its own)
without a Python string per unit. The UTF-8 bytes of a run of rows are viewed as 64-bit words. Arithmetic on whole words (no carry
leaves a byte) puts a mark into the high bit of each byte that ends a unit; counts are `bitwise_count` per word. The k-th mark is
found by a search in the cumulated counts and then inside one word by clearing lowest bits.

Where a text is cut depends on `seed` and its id only, so reruns and repeated attempts of a task agree.

Defined cases: a null text is empty and stays plain; a null id counts as empty text in the draw. A text that holds a sentinel stays
plain, so `restore` is exact. A one-unit text may have empty parts. Repeated rows are rewritten alike. Very long texts are whole; a run of rows
is about PIECE_BYTES, or one row. Columns of the input pass through, except those named like a column that is added. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.llm.words import PIECE_BYTES, text_buffer

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
REWRITTEN = 50
SPM = 80
_U = np.uint64
EACH = _U(0x0101010101010101)
HIGH = EACH * _U(0x80)
LOW = ~HIGH


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words, with at least one zero byte behind them."""
    x = np.zeros(len(data) // 8 + 1, "<u8")
    x.view(np.uint8)[:len(data)] = data
    return x


def unit_ends(x: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """High bits of the bytes that end a unit; `lasts` are the places of the last byte of each text that isn't empty."""
    y = x ^ (EACH * _U(0x20))
    blank = ~(((y & LOW) + LOW) | y)
    control = ((x & LOW) + EACH * _U(0x80 - 0x09)) & ~((x & LOW) + EACH * _U(0x80 - 0x0E)) & ~x
    space = (blank | control) & HIGH
    after = space >> _U(8)
    after[:-1] |= space[1:] << _U(56)
    ends = after & ~space
    ends.view(np.uint8)[lasts] = 0x80
    return ends


def code_points(x: np.ndarray) -> np.ndarray:
    """High bits of the bytes that begin a code point (all but 10xxxxxx)."""
    return ~(x & ~(x << _U(1))) & HIGH


class Marks:
    """Rank and select over the marks in the high bits of 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before each place."""
        word = self.words[at >> 3] & ((_U(1) << ((at & 7) * 8).astype(_U)) - _U(1))
        return self.before[at >> 3] + np.bitwise_count(word)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th mark, counted from 0."""
        w = np.searchsorted(self.before, k, "right") - 1
        word, skip = self.words[w], k - self.before[w]
        for step in range(7):
            word = np.where(skip > step, word & (word - _U(1)), word)
        return w * 8 + (np.bitwise_count((word & (~word + _U(1))) - _U(1)) >> 3)


def draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers of each id."""
    each = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(each, ">u4").reshape(-1, 4).astype(np.int64)


def rewrite(texts: pa.Array, ids: list, seed: int = SEED, rewritten: int = REWRITTEN, spm: int = SPM) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Number of rows and their n, form, prefix_chars, middle_chars, output, for runs of rows of about PIECE_BYTES."""
    data, at = text_buffer(texts)
    marked = np.zeros(len(texts), bool)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.fill_null(pc.match_substring(texts, sentinel), False).to_numpy(zero_copy_only=False)
    h = draws(ids, seed)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + PIECE_BYTES, "right")) - 1)
        part, bounds = data[at[row]:at[stop]], at[row:stop + 1] - at[row]
        start, end = bounds[:-1], bounds[1:]
        x = as_words(part)
        units, points = Marks(unit_ends(x, end[end > start] - 1)), Marks(code_points(x))
        first = units.rank(start)
        n = units.rank(end) - first
        mine = h[row:stop]
        cuts = np.sort(mine[:, :2] % (n + 1)[:, None], axis=1)
        place = [np.where(c > 0, units.select(np.maximum(first + c - 1, 0)) + 1, start) for c in cuts.T]
        plain = (n == 0) | marked[row:stop] | (mine[:, 2] % 100 >= rewritten)
        head_last = mine[:, 3] % 100 < spm
        low = points.rank(place[0])
        sizes = [pa.array(v, pa.int64(), mask=plain) for v in (low - points.rank(start), points.rank(place[1]) - low)]
        raw, out = part.tobytes(), []
        for a, b, c, d, same, spm_form in zip(start.tolist(), place[0].tolist(), place[1].tolist(), end.tolist(), plain.tolist(), head_last.tolist()):
            if same:
                out.append(raw[a:d])
            elif spm_form:
                out.append(b"%b%b%b%b%b%b" % (SUFFIX.encode(), raw[c:d], PREFIX.encode(), raw[a:b], MIDDLE.encode(), raw[b:c]))
            else:
                out.append(b"%b%b%b%b%b%b" % (PREFIX.encode(), raw[a:b], SUFFIX.encode(), raw[c:d], MIDDLE.encode(), raw[b:c]))
        form = np.where(plain, "plain", np.where(head_last, "spm", "psm"))
        yield stop - row, pa.record_batch([pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *sizes, pa.array(out, pa.binary()).cast(pa.string())],
                                          names=ADDED)
        row = stop


ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rewritten: int = REWRITTEN, spm: int = SPM) -> DataFrame:
    """`docs` plus n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    `rewritten` of 100 texts are rewritten, `spm` of 100 of these with the suffix first.
    """
    frame = docs.drop(*[c for c in docs.columns if c.lower() in ADDED and c not in (doc_id, text)])
    id_at, text_at = frame.columns.index(doc_id), frame.columns.index(text)
    schema = StructType(frame.schema.fields + StructType.fromDDL("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for size, made in rewrite(batch.column(text_at), batch.column(id_at).to_pylist(), seed, rewritten, spm):
                yield pa.record_batch([*batch.slice(row, size).columns, *made.columns], names=[*batch.schema.names, *ADDED])
                row += size

    return frame.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that was rewritten. It holds no sentinel, so each sentinel of the output stands at a border between parts."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
