"""Ordered report rows and set operations on id columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_by(df: DataFrame, key: str, n: int, tie: Sequence[str], absolute: bool = False) -> DataFrame:
    """The n largest rows (by magnitude with ``absolute``) in order; planned as a top-k, not a full sort."""
    order = F.abs(F.col(key)) if absolute else F.col(key)
    return df.orderBy(F.desc_nulls_last(order), *[F.asc(t) for t in tie]).limit(n)


def common_songs(frames: Sequence[DataFrame], key: str) -> DataFrame:
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.intersect(f.select(key))
    return out.distinct()


def union_listeners(frames: Sequence[DataFrame], key: str) -> DataFrame:
    out = frames[0].select(key).distinct()
    for f in frames[1:]:
        out = out.unionByName(f.select(key).distinct())
    return out.distinct()


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Symmetric difference with the side each key is on."""
    return (a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("a"))
            .unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("b"))))


def nested_subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: is every key of a inside b?"""
    extra = a.select(key).distinct().join(b.select(key), key, "left_anti")
    return extra.agg((F.count("*") == 0).alias("nested"), F.count("*").alias("n_outside"))
