"""Registry of named queries: a Spark plan over the driver tables and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from scoreloom.plans.proxies import CTES, Tables


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, px: Sequence[str] = ()):
    """Register ``fn(tables)``; ``px`` names the proxy views the SQL text uses."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, fn, with_views(sql, px) if sql else None)
        return fn

    return wrap


def with_views(sql: str, px: Sequence[str]) -> str:
    sql = sql.strip()
    views = ", ".join(f"{p} AS ({CTES[p].strip()})" for p in px)
    if not views:
        return sql
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(head):
            return f"{head}{views}, {sql[len(head):]}"
    return f"WITH {views} {sql}"
