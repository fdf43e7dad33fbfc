"""Insert-or-update, property updates and deletes as whole-table transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("sum", "max", "overwrite")


def merge_rows(rows: DataFrame, keys: Sequence[str], rules: Mapping[str, str], order: str | None = None) -> DataFrame:
    """Collapse rows of equal key: "sum" adds, "max" keeps the greatest, "overwrite" the value with the greatest
    `order` (of equal ones, the greatest value)."""
    aggs = []
    for column, rule in rules.items():
        if rule not in RULES:
            raise ValueError(f"unknown rule {rule}")
        pick = {"sum": F.sum(column), "max": F.max(column)}.get(rule)
        aggs.append((pick if pick is not None else F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(order, column)))).alias(column))
    return rows.groupBy(*keys).agg(*aggs)


def upsert_nodes(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of both; where a key is in both, non-null new values win. `updates` has one row per key."""
    return _upsert(target, updates, [key])


def upsert_edges(target: DataFrame, updates: DataFrame, sources: DataFrame, targets: DataFrame,
                 keys: Sequence[str] = ("src", "dst")) -> DataFrame:
    """As upsert_nodes for edges; updates whose ends do not exist are dropped."""
    a, b = keys
    known = updates.join(sources.select(F.col("id").alias(a)), a, "left_semi").join(
        targets.select(F.col("id").alias(b)), b, "left_semi")
    return _upsert(target, known, list(keys))


def _upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    new = updates.select(*keys, *[F.col(c).alias(f"__{c}") for c in updates.columns if c not in keys])
    both = target.join(new, keys, "full")
    columns = [c for c in target.columns if c not in keys]
    added = [c for c in updates.columns if c not in keys and c not in columns]
    return both.select(
        *keys,
        *[F.coalesce(f"__{c}", c).alias(c) if c in updates.columns else F.col(c) for c in columns],
        *[F.col(f"__{c}").alias(c) for c in added])


def set_property(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach or replace columns on existing keys only."""
    keys = list(keys)
    new = updates.select(*keys, *[F.col(c).alias(f"__{c}") for c in updates.columns if c not in keys])
    both = target.join(new, keys, "left")
    columns = [c for c in target.columns if c not in keys]
    return both.select(
        *keys, *[F.coalesce(f"__{c}", c).alias(c) if c in updates.columns else F.col(c) for c in columns],
        *[F.col(f"__{c}").alias(c) for c in updates.columns if c not in keys and c not in columns])


def delete_where(target: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate is not true (a null predicate keeps the row)."""
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    return target.filter(~F.coalesce(p, F.lit(False)))


def detach_delete(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop the doomed ids and every edge that touches one."""
    ids = doomed.select("id")
    left = nodes.join(ids, "id", "left_anti")
    kept = edges.join(ids, edges["src"] == ids["id"], "left_anti").join(ids, edges["dst"] == ids["id"], "left_anti")
    return left, kept
