"""Running values over ordered rows when one key may hold a third of the data.

A plain window puts every row of a key into one task. Here the rows of a key are cut into *blocks* that follow
the order; each block is scanned on its own, the per-block totals (a few bytes each) are scanned per key, and
the carry of the earlier blocks is joined back. No task ever sees more rows than one block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.scalars import ColumnOrName, col, epoch_us
from scoreloom.session import materialize

BLOCK_ROWS = 65536


@dataclass(frozen=True)
class Run:
    """One running value: ``sum``, ``count``, ``max``, ``min`` or ``last`` (non-null) of ``value``."""

    kind: str
    value: Column | None = None
    inclusive: bool = True


def running_sum(value: ColumnOrName, inclusive: bool = True) -> Run:
    return Run("sum", col(value), inclusive)


def running_count(inclusive: bool = True) -> Run:
    return Run("sum", F.lit(1).cast("bigint"), inclusive)


def running_max(value: ColumnOrName, inclusive: bool = True) -> Run:
    return Run("max", col(value), inclusive)


def running_last(value: ColumnOrName, inclusive: bool = True) -> Run:
    """Latest non-null value."""
    return Run("last", col(value), inclusive)


def previous(value: ColumnOrName) -> Run:
    """Value of the row before, null or not (wrapped so that a null value is not skipped)."""
    return Run("last", F.struct(col(value).alias("v")), False)


def step_block(step: ColumnOrName = "step", rows: int = BLOCK_ROWS) -> Column:
    """Block of a dense step number."""
    return F.floor(col(step) / rows).cast("bigint")


def time_block(ts: ColumnOrName, seconds: int = 3600) -> Column:
    """Block of an event time; choose the width so that the hottest key fits a task per block."""
    return F.floor(epoch_us(ts) / (seconds * 1_000_000)).cast("bigint")


def range_blocks(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "__range") -> DataFrame:
    """Add a block number that follows (by, order): the ranges that Spark cuts from the data.

    For orders without a natural block (a float, a text). A key's rows spread over as many ranges as they fill. The ranged
    rows are written once, so that every later use and every retry sees the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(b) for b in by], *order)
    return materialize(ranged.withColumn(name, F.spark_partition_id()), "ranges")


def prefix_scan(df: DataFrame, by: Sequence[str], order: Sequence[Column], block: Column | Sequence[Column],
                runs: dict[str, Run], backwards: bool = False) -> DataFrame:
    """Add one column per run, computed over the rows of ``by`` in ``order``.

    ``block`` must never decrease along ``order`` (with ``backwards``: never increase); several columns are
    compared one after the other. ``backwards`` scans from the end of the order, which then is given descending.
    """
    blocks = [block] if isinstance(block, Column) else list(block)
    names = [f"__b{i}" for i in range(len(blocks))]
    tmp = df.select("*", *[b.alias(n) for b, n in zip(blocks, names)],
                    *[r.value.alias(f"__v_{k}") for k, r in runs.items()])
    in_block = W.partitionBy(*by, *names).orderBy(*order)
    local, totals, carries = {}, [], []
    block_order = [F.desc(n) if backwards else F.asc(n) for n in names]
    before = W.partitionBy(*by).orderBy(*block_order).rowsBetween(W.unboundedPreceding, -1)
    for name, run in runs.items():
        value = F.col(f"__v_{name}")
        frame = in_block.rowsBetween(W.unboundedPreceding, 0 if run.inclusive else -1)
        total = F.col(f"__t_{name}")
        if run.kind in ("sum", "max", "min"):
            agg = {"sum": F.sum, "max": F.max, "min": F.min}[run.kind]
            local[f"__l_{name}"] = agg(value).over(frame)
            totals.append(agg(value).alias(f"__t_{name}"))
            carries.append(agg(total).over(before).alias(f"__c_{name}"))
        elif run.kind == "last":
            local[f"__l_{name}"] = F.last(value, ignorenulls=True).over(frame)
            totals.append(F.max_by(value, F.when(value.isNotNull(), F.col("__rn"))).alias(f"__t_{name}"))
            carries.append(F.last(total, ignorenulls=True).over(before).alias(f"__c_{name}"))
        else:
            raise ValueError(f"unknown run kind {run.kind!r}")
    keys = [*by, *names]
    # The place of a row in its block tells which value is the last, whatever the order looks like.
    numbered = tmp.withColumn("__rn", F.row_number().over(in_block)) if any(r.kind == "last" for r in runs.values()) else tmp
    carry = numbered.groupBy(*keys).agg(*totals).select(*keys, *carries)
    # A null key or block still has to find its carry, hence the null-safe match.
    carry = carry.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[f"__c_{n}" for n in runs])
    on = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        on = test if on is None else on & test
    joined = tmp.withColumns(local).join(carry, on, "left")
    out = []
    for name, run in runs.items():
        mine, theirs = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if run.kind == "sum":
            out.append(F.coalesce(mine + theirs, mine, theirs).alias(name))
        elif run.kind == "max":
            out.append(F.greatest(mine, theirs).alias(name))
        elif run.kind == "min":
            out.append(F.least(mine, theirs).alias(name))
        else:
            out.append(F.coalesce(mine, theirs).alias(name))
    return joined.select(*[c for c in df.columns if c not in runs], *out)


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[Column], block: Column | Sequence[Column],
            name: str = "rn") -> DataFrame:
    """Exact 1-based row number per key without a per-key task."""
    return prefix_scan(df, by, order, block, {name: running_count()})
