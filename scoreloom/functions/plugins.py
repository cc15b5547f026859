"""User extension points: metrics, tables, the window UDTF and scalar functions for SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_METRICS: dict[str, Callable] = {}


def register_metric(name: str, fn: Callable[..., pd.Series], inputs: Sequence[str]) -> None:
    """Add a score plug-in: a function of pandas Series (features) to a Series of scores.

    It runs on Arrow batches. When it fails on a batch the batch is halved until the rows that fail are alone, so good
    rows are scored in large parts; a row that fails gets a null score and a warning instead of failing the job.
    """

    @F.pandas_udf("score double, warning string")
    def scored(*cols: pd.Series) -> pd.DataFrame:
        n = len(cols[0])
        score, warning = np.full(n, np.nan), np.full(n, None, object)
        parts = [(0, n)] if n else []
        while parts:
            lo, hi = parts.pop()
            try:
                score[lo:hi] = fn(*[c.iloc[lo:hi] for c in cols])
            except Exception as e:  # noqa: BLE001
                if hi - lo > 1:
                    parts += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
                else:
                    warning[lo] = f"{type(e).__name__}: {e}"
        return pd.DataFrame({"score": score, "warning": warning})

    _METRICS[name] = (scored, tuple(inputs))


def metric(name: str) -> Column:
    """struct(score, warning) of a registered metric."""
    if name not in _METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(_METRICS)}")
    fn, inputs = _METRICS[name]
    return fn(*[F.col(c) for c in inputs])


def register_role_table(spark: SparkSession, name: str, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Publish a keyword table as a view (position, role, keyword)."""
    rows = [(i, role, w) for i, (role, words) in enumerate(rules) for w in words]
    df = spark.createDataFrame(rows, "position int, role string, keyword string")
    df.createOrReplaceTempView(name)
    return df


def register_limits(spark: SparkSession, name: str, limits: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """Publish a limit table as a view (action, arg, lo, hi)."""
    df = spark.createDataFrame(list(limits), "action string, arg string, lo double, hi double")
    df.createOrReplaceTempView(name)
    return df


def classify_by_table(df: DataFrame, column: str, roles: DataFrame, key: Sequence[str], default: str = "other") -> DataFrame:
    """Role by a keyword table instead of a literal rule list: the table travels as one array."""
    # A keyword table is a catalogue; it is packed into a single row.
    packed = roles.agg(F.array_sort(F.collect_list(F.struct("position", "role", "keyword"))).alias("__rules"))
    j = df.select(*key, column).join(F.broadcast(packed), F.lit(True))
    hit = F.get(F.filter("__rules", lambda r: F.contains(F.lower(F.col(column)), r["keyword"])), F.lit(0))
    return j.select(*key, F.coalesce(hit["role"], F.lit(default)).alias("role"))


def register_sql(spark: SparkSession) -> None:
    """Scalar functions for SQL text; they are SQL expressions, so Catalyst inlines them."""
    for text in (
        "wilson_lo(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN (k / n + 3.84145882249662D / (2 * n) - 1.959963985D * "
        "sqrt(k / n * (1 - k / n) / n + 3.84145882249662D / (4 * n * n))) / (1 + 3.84145882249662D / n) ELSE 0D END",
        "wilson_hi(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN (k / n + 3.84145882249662D / (2 * n) + 1.959963985D * "
        "sqrt(k / n * (1 - k / n) / n + 3.84145882249662D / (4 * n * n))) / (1 + 3.84145882249662D / n) ELSE 0D END",
        "z_score(x DOUBLE, mean DOUBLE, std DOUBLE) RETURNS DOUBLE RETURN (x - mean) / greatest(std, 1e-6D)",
        "reward_min(p DOUBLE, s DOUBLE) RETURNS DOUBLE RETURN CASE WHEN p IS NOT NULL AND s IS NOT NULL THEN least(p, s) END",
        "reward_weighted(p DOUBLE, s DOUBLE, w DOUBLE) RETURNS DOUBLE RETURN w * p + (1 - w) * s",
        "reward_penalized(p DOUBLE, s DOUBLE, lam DOUBLE) RETURNS DOUBLE RETURN p - lam * abs(p - s)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")


def register_window_rows(spark: SparkSession, name: str = "window_rows") -> None:
    """``window_rows(duration, win, hop)``: the sliding windows of one series as rows, for SQL users.

    A SQL table function; the DataFrame form is ``sliding_windows``.
    """
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(duration DOUBLE, win DOUBLE, hop DOUBLE)
        RETURNS TABLE (win_idx BIGINT, start_sec DOUBLE, end_sec DOUBLE)
        RETURN SELECT w.i, w.a, w.b FROM (SELECT inline(CASE
            WHEN duration + 1e-6D >= win THEN transform(sequence(0L, CAST(floor((duration + 1e-6D - win) / hop) AS BIGINT)),
                i -> named_struct('i', i, 'a', i * hop, 'b', i * hop + win))
            WHEN duration > 0.5D THEN array(named_struct('i', 0L, 'a', 0D, 'b', duration)) END)) w""")
