"""Distribution functions and intervals as Columns (Spark SQL has no erf, t or binomial CDF)."""

# No lazy annotations here: Spark reads the types of the functions over Arrow batches.
import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.scalars import ColumnOrName, col

Z95 = 1.959963985


def _d(c: ColumnOrName | float) -> Column:
    return F.lit(float(c)) if isinstance(c, (int, float)) else col(c).cast("double")


def let(value: Column, body) -> Column:
    """``body`` of a value that is written (and computed) once; keeps nested formulas small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def wilson_ci(k: ColumnOrName, n: ColumnOrName, z: float = Z95) -> Column:
    """struct(lo, hi): Wilson 95 % interval; (0, 0) for n = 0."""
    k, n = _d(k), _d(n)
    p = k / n
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1.0 + z * z / n
    ok = n > 0
    return F.struct(F.when(ok, (centre - half) / scale).otherwise(0.0).alias("lo"),
                    F.when(ok, (centre + half) / scale).otherwise(0.0).alias("hi"))


def norm_cdf(x: ColumnOrName) -> Column:
    """Standard normal CDF."""
    return norm_sf(-_d(x))


def norm_sf(x: ColumnOrName) -> Column:
    """1 - CDF with full relative precision: power series of the error integral inside (-3, 3), continued fraction beyond."""

    def central(v: Column) -> Column:
        def grow(acc: Column, i: Column) -> Column:
            return let(acc["term"] * v * v / (2 * i + 1), lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum")))

        total = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(v.alias("term"), v.alias("sum")), grow, lambda acc: acc["sum"])
        return 0.5 - total * F.exp(-v * v / 2.0) / math.sqrt(2.0 * math.pi)

    def tail(v: Column) -> Column:
        below = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), v, lambda acc, k: v + k / acc)
        return F.exp(-v * v / 2.0) / math.sqrt(2.0 * math.pi) / below

    return let(_d(x), lambda v: F.when(v >= 3, tail(v)).when(v <= -3, 1.0 - tail(-v)).when(v.isNotNull(), central(v)))


# --- Student's t and the binomial: Arrow batches, for result rows (one per contrast) ---------------

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)
_PANELS = 64


def _gamma_ratio(a: np.ndarray) -> np.ndarray:
    """gamma(a + 1/2) / gamma(a), by its series at a + 20 and the recurrence down to a."""
    b = a + 20.0
    series = 1 - 1 / (8 * b) + 1 / (128 * b**2) + 5 / (1024 * b**3) - 21 / (32768 * b**4) - 399 / (262144 * b**5) + 869 / (4194304 * b**6)
    out = np.sqrt(b) * series
    for i in range(20):
        out = out * ((a + i) / (a + i + 0.5))
    return out


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for t >= 0, with full relative precision for any degrees of freedom.

    With u = sqrt(df) tan(x) the density becomes a power of the cosine, integrated from atan(t / sqrt(df)) to pi / 2 over
    panels that double in width, starting from the scale on which it falls.
    """
    x0 = np.arctan2(t, np.sqrt(df))
    gap = np.maximum(np.arctan2(np.sqrt(df), t), 1e-300)  # pi / 2 - x0 without cancellation
    first = np.minimum(gap, 0.25 / (np.sqrt(df) * (1.0 + np.minimum(t, 40.0))))
    ends = np.minimum(first[:, None] * (2.0 ** np.arange(_PANELS + 1) - 1.0), gap[:, None])
    ends[:, -1] = gap
    half, mid = np.diff(ends, axis=1) / 2, (ends[:, 1:] + ends[:, :-1]) / 2
    y = mid[:, :, None] + half[:, :, None] * _NODES  # distance from x0
    # log cos(x0 + y), from the side that keeps its digits
    x = x0[:, None, None] + y
    rest = gap[:, None, None] - y
    log_cos = np.where(x < 0.7, 0.5 * np.log1p(-np.minimum(np.sin(x) ** 2, 0.9)), np.log(np.maximum(np.sin(rest), 1e-300)))
    power = np.exp((df[:, None, None] - 1.0) * log_cos)
    return (power @ _WEIGHTS * half).sum(1) * _gamma_ratio(df / 2.0) / math.sqrt(math.pi)


def _t_density(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return np.exp(-(df + 1) / 2 * np.log1p(t * t / df)) * _gamma_ratio(df / 2.0) / np.sqrt(math.pi * df)


def _t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """Newton on log P(T > e^u) from the normal quantile: that function is concave and falls, so every step after the first comes
    from above and none overshoots."""
    if p == 0.5:
        return np.zeros(len(df))
    q = 1.0 - p if p > 0.5 else p
    u = np.full(len(df), math.log(-NormalDist().inv_cdf(q)))
    for _ in range(60):
        t = np.exp(u)
        tail = t_tail(t, df)
        step = (np.log(tail) - math.log(q)) * tail / (_t_density(t, df) * t)
        u = u + step
        if (np.abs(step) < 1e-14).all():
            break
    return np.exp(u) if p > 0.5 else -np.exp(u)


def _over(fn: Callable[..., np.ndarray], ok: np.ndarray, *args: np.ndarray) -> pd.Series:
    """``fn`` where ``ok``, null elsewhere."""
    out = np.full(len(ok), np.nan)
    if ok.any():
        out[ok] = fn(*(a[ok] for a in args))
    return pd.Series(out)


def t_cdf(t: ColumnOrName, df: ColumnOrName) -> Column:
    """Student-t CDF; null for a null or NaN t or for no degrees of freedom."""
    @F.pandas_udf("double")
    def cdf(t: pd.Series, df: pd.Series) -> pd.Series:
        t, df = t.to_numpy(float), df.to_numpy(float)
        return _over(lambda t, df: np.where(t >= 0, 1.0 - t_tail(np.abs(t), df), t_tail(np.abs(t), df)), ~np.isnan(t) & (df > 0), t, df)
    return cdf(_d(t), _d(df))


def t_ppf(p: float, df: ColumnOrName) -> Column:
    """Quantile of Student's t; null without degrees of freedom."""
    @F.pandas_udf("double")
    def ppf(df: pd.Series) -> pd.Series:
        df = df.to_numpy(float)
        return _over(lambda df: _t_quantile(p, df), df > 0, df)
    return ppf(_d(df))


def _stirling_rest(n: float) -> float:
    """ln n! less (n + 1/2) ln n - n + ln(2 pi) / 2, by its series at n + 16 and the recurrence down to n."""
    m = n + 16.0
    out = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / m**2) / m**2) / m**2) / m**2) / m
    for i in range(16):
        k = n + 15.0 - i  # from k + 1 to k
        out += (k + 0.5) * math.log1p(1.0 / k) - 1.0
    return out


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x without cancellation."""
    v = (x - mean) / (x + mean)
    if abs(v) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, term, j = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def _binom_half(k: int, m: int) -> float:
    """P(X = k), X ~ Binomial(m, 1/2), with full relative precision."""
    if k in (0, m):
        return 0.5**m
    rest = _stirling_rest(m) - _stirling_rest(k) - _stirling_rest(m - k)
    return math.exp(rest - _deviance(k, m / 2) - _deviance(m - k, m / 2)) * math.sqrt(m / (2 * math.pi * k * (m - k)))


def _binom_tail(k: int, m: int) -> float:
    """P(X >= k): terms from the smaller tail until they no longer count."""
    if k <= 0 or k > m:
        return float(k <= 0)
    # P(X >= k) = 1 - P(X >= m - k + 1) by symmetry, so one direction is enough.
    upper = 2 * k >= m
    i = k if upper else m - k + 1
    term = total = _binom_half(i, m)
    while i < m:
        term *= (m - i) / (i + 1)
        if total + term == total:
            break
        total, i = total + term, i + 1
    return total if upper else 1.0 - total


def binom_tail_half(k: ColumnOrName, m: ColumnOrName) -> Column:
    """P(X >= k) for X ~ Binomial(m, 1/2); null where either is null."""
    @F.pandas_udf("double")
    def tail(k: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else _binom_tail(int(a), int(b)) for a, b in zip(k, m)], dtype=float)
    return tail(col(k).cast("bigint"), col(m).cast("bigint"))
