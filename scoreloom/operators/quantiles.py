"""Exact order statistics for groups of any size.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a bounded sketch of each group gives a
bracket around each wanted rank; rows outside the brackets are counted into markers during the map-side aggregation, and
only the few values inside a bracket are put in order. The way is the same for every group: a sketch of a small group holds
all its values, so its bracket is one value, and a neighbour that the interpolation needs is the first or last value that
its marker has counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.scalars import ColumnOrName, finite


def _same(by: Sequence[str]):
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    return on


def exact_percentiles(df: DataFrame, by: Sequence[str], value: ColumnOrName, probs: dict[str, float],
                      accuracy: int = 100_000, lower: bool = False) -> DataFrame:
    """One row per group with the linearly interpolated percentiles (``lower``: the element at floor(n·p)).

    A group without finite values gives no row. The sketch misses a rank by at most n / accuracy and the brackets reach
    four times as far, so the wanted rank lies in its bracket; should a sketch break that promise, the query fails.
    """
    names = list(probs)
    base = df.select(*by, finite(value).alias("__v")).where(F.col("__v").isNotNull())
    eps = 4.0 / accuracy
    marks = [max(probs[n] - eps, 0.0) for n in names] + [min(probs[n] + eps, 1.0) for n in names]
    sketch = base.groupBy(*by).agg(F.count("*").alias("__n"), F.percentile_approx(
        "__v", F.array(*[F.lit(p) for p in marks]), accuracy).alias("__q"))
    key = [F.col(b).alias(f"__k_{b}") for b in by]
    sketch = sketch.select(*key, "__n", *[
        c for i in range(len(names)) for c in (F.col("__q")[i].alias(f"__lo{i}"), F.col("__q")[len(names) + i].alias(f"__hi{i}"))])
    # With no group key the sketch is a single row.
    joined = base.join(sketch if by else F.broadcast(sketch), _same(by)).drop(*[f"__k_{b}" for b in by])
    v, inside, below = F.col("__v"), F.lit(False), F.lit(float("-inf"))
    for i in range(len(names)):
        inside = inside | v.between(F.col(f"__lo{i}"), F.col(f"__hi{i}"))
        below = F.greatest(below, F.when(F.col(f"__hi{i}") < v, F.col(f"__hi{i}")))
    cell = joined.select(*by, "__v", F.when(inside, v).otherwise(below).alias("__x"), (~inside).cast("int").alias("__marker"), "__n")
    counts = cell.groupBy(*by, "__x", "__marker").agg(
        F.count("*").alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), F.first("__n").alias("__n"))
    w = W.partitionBy(*by).orderBy("__x", "__marker").rowsBetween(W.unboundedPreceding, 0) if by else \
        W.orderBy("__x", "__marker").rowsBetween(W.unboundedPreceding, 0)
    cum = counts.withColumn("__cum", F.sum("__c").over(w))
    slot = F.struct("__cum", "__c", "__marker", "__least", "__most")
    n, ranks = F.col("__n"), {}
    for name in names:
        h = F.floor(n * probs[name]) if lower else (n - 1) * F.lit(probs[name])
        k = F.least(F.floor(h), n - 1)
        ranks[name] = (k + 1, F.least(k + 2, n))
    picked = cum.groupBy(*by).agg(F.first("__n").alias("__n"), *[
        F.min(F.when(F.col("__cum") >= r, slot)).alias(f"__{i}_{name}") for name in names for i, r in enumerate(ranks[name])])

    def at(name: str, i: int):
        """Value of a rank: of its cell, or the first or last of the rows between two brackets."""
        s, rank = F.col(f"__{i}_{name}"), ranks[name][i]
        return F.when((s["__marker"] == 0) | (rank == s["__cum"] - s["__c"] + 1), s["__least"]).when(rank == s["__cum"], s["__most"]).otherwise(
            F.raise_error(F.lit(f"percentile bracket missed the rank of {name}")).cast("double"))

    out = []
    for name in names:
        h = (n - 1) * F.lit(probs[name])
        frac = F.lit(0.0) if lower else h - F.floor(h)
        out.append(F.when(frac > 0, at(name, 0) + (at(name, 1) - at(name, 0)) * frac).otherwise(at(name, 0)).alias(name))
    return picked.where(n.isNotNull()).select(*by, *out)


def exact_median(df: DataFrame, by: Sequence[str], value: ColumnOrName, name: str = "median") -> DataFrame:
    return exact_percentiles(df, by, value, {name: 0.5})


def upper_median(df: DataFrame, by: Sequence[str], value: ColumnOrName, name: str = "upper_median") -> DataFrame:
    """Element at index floor(n/2) of the sorted values, not interpolated."""
    return exact_percentiles(df, by, value, {name: 0.5}, lower=True)
