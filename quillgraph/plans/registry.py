"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillgraph.sources.tables import VIEW_NEEDS, VIEWS

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def with_views(sql: str) -> str:
    """Prefix `sql` with the data-model views it names (and the helper tables it already defines)."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in VIEW_NEEDS.get(name, ()):
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if re.search(rf"(?i)\b(from|join|,)\s+{name}\b", sql):
            need(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in wanted)
    body = sql.strip()
    if not ctes:
        return body
    head = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{body[head.end():]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register `run(spark, sf_dir)` under `name`; `covers` lists inventory ids."""

    def add(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, tuple(covers.split()), run, with_views(sql) if sql else None)
        return run

    return add
