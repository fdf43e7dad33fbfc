"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import scratch_path
from quillgraph.sources.tables import table  # noqa: F401

#: White space of the contracts, as a regular expression for Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
HOT_KEYS = 1000


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back; its true size is then known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart by id and text; null and empty differ."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(doc_id).isNull(), F.col(text).isNull())


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many leading underscores as keep it apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """Join on `key`, which is unique in `right`; `right` says in `size` how many left rows each key has at most.

    Keys with more than a thousandth of those rows are at most a thousand, so their part of `right` is broadcast
    and their left rows stay where they are. All other keys are joined by a shuffle. `right` should be a stored
    table, because it is read three times.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    limit = total / HOT_KEYS
    hot = right.filter(F.col(size) > limit)
    cold = right.filter(F.col(size) <= limit)
    keys = F.broadcast(hot.select(key))
    one = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(keys, key, "left_anti")
    return one.unionByName(rest.join(cold, key, how), allowMissingColumns=True)
