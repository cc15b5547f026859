"""Per-song calibration to z units and the reward forms built on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.scalars import ColumnOrName, col, nan_to_null
from scoreloom.operators.joins import attach

STD_FLOOR = 0.05
MIN_RELIABLE_N = 12
DIVIDE_GUARD = 1e-6
METRICS = ("pq", "sb")


def fit_calibration(pool: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRICS,
                    floors: dict[str, float] | None = None) -> DataFrame:
    """Mean, floored population std, floor flags and sample count per key; partial aggregation handles hot keys."""
    floors = floors or {}
    aggs, cols = [], []
    for m in metrics:
        v = nan_to_null(m)
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_pop(v).alias(f"{m}_std_measured"), F.count(v).alias(f"__n_{m}")]
        floor = F.lit(float(floors.get(m, STD_FLOOR)))
        raw = F.col(f"{m}_std_measured")
        cols += [F.col(f"{m}_mean"), raw, F.greatest(raw, floor).alias(f"{m}_std"), (raw < floor).alias(f"{m}_floored")]
    n = F.least(*[F.col(f"__n_{m}") for m in metrics]) if len(metrics) > 1 else F.col(f"__n_{metrics[0]}")
    return pool.groupBy(*by).agg(*aggs).select(*by, *cols, n.alias("n_samples"))


def guard_reliable(metric: str = "sb", min_n: int = MIN_RELIABLE_N) -> Column:
    return ~F.col(f"{metric}_floored") & (F.col("n_samples") >= min_n)


def warn_weak_calibration(min_n: int = MIN_RELIABLE_N) -> Column:
    """Reasons why a calibration is weak, in fixed order."""
    return F.filter(F.array(F.when(F.col("n_samples") < min_n, "few_samples"),
                            F.when(F.col("sb_floored"), "sb_floored"),
                            F.when(F.col("pq_floored"), "pq_floored")), lambda r: r.isNotNull())


def zscore(df: DataFrame, calib: DataFrame, on: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Add ``z_<metric>``; the calibration is one row per key, so tasks hash their keys of it and never sort the rows of ``df``."""
    cols = [c for m in metrics for c in (f"{m}_mean", f"{m}_std")]
    out = df.join(calib.select(*on, *cols).hint("shuffle_hash"), list(on))
    z = {f"z_{m}": (F.col(m) - F.col(f"{m}_mean")) / F.greatest(F.col(f"{m}_std"), F.lit(DIVIDE_GUARD)) for m in metrics}
    return out.withColumns(z).drop(*cols)


# --- reward forms --------------------------------------------------------------------------------


def reward_min(z_pq: ColumnOrName = "z_pq", z_sb: ColumnOrName = "z_sb") -> Column:
    """Smaller z; null when either side is missing (``least`` alone would skip the null)."""
    a, b = nan_to_null(z_pq), nan_to_null(z_sb)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def reward_weighted(z_pq: ColumnOrName = "z_pq", z_sb: ColumnOrName = "z_sb", w: float = 0.5) -> Column:
    return w * col(z_pq) + (1.0 - w) * col(z_sb)


def reward_penalized(z_pq: ColumnOrName = "z_pq", z_sb: ColumnOrName = "z_sb", lam: float = 0.5) -> Column:
    """Anchored on the first axis, so not symmetric."""
    return col(z_pq) - lam * F.abs(col(z_pq) - col(z_sb))


def reward_single(axis: str) -> Column:
    return F.col(f"z_{axis}")


RewardForm = Callable[..., Column]
_FORMS: dict[str, RewardForm] = {}


def register_reward(name: str, fn: RewardForm) -> None:
    """Add a reward form: a function of the two z Columns (and keyword parameters) returning a Column."""
    _FORMS[name] = fn


register_reward("min", lambda p, s: reward_min(p, s))
register_reward("mean", lambda p, s: reward_weighted(p, s, 0.5))
register_reward("weighted", lambda p, s, weight=0.5: reward_weighted(p, s, weight))
register_reward("penalized", lambda p, s, lam=0.5: reward_penalized(p, s, lam))
register_reward("pq_only", lambda p, s: p)
register_reward("sb_only", lambda p, s: s)


def reward(form: str, z_pq: ColumnOrName = "z_pq", z_sb: ColumnOrName = "z_sb", **params: float) -> Column:
    if form not in _FORMS:
        raise ValueError(f"unknown reward form {form!r}; known: {sorted(_FORMS)}")
    return _FORMS[form](col(z_pq), col(z_sb), **params)


def rescore(methods: DataFrame, calib: DataFrame, on: Sequence[str], form: str = "min", **params: float) -> DataFrame:
    """Reward of every method row on the calibration of its key."""
    return zscore(methods, calib, on).withColumn("reward", reward(form, **params))


# --- axes over logs ------------------------------------------------------------------------------


def binding_axis(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shares of accepted steps on which each axis is the minimum."""
    axis = F.when(F.col("z_sb") < F.col("z_pq"), "sb").otherwise("pq")
    acc = log.where(F.col("accepted") & F.col("z_pq").isNotNull() & F.col("z_sb").isNotNull()).select(*by, axis.alias("axis"))
    return acc.groupBy(*by).agg(F.count("*").alias("n_accepted"),
                                F.avg((F.col("axis") == "sb").cast("int")).alias("sb_share"),
                                F.avg((F.col("axis") == "pq").cast("int")).alias("pq_share"))


def veto_share(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of the candidates one axis alone would accept that the minimum rejects, and the reverse.

    Needs the z values of each candidate and ``state_z_pq`` / ``state_z_sb`` of the state it starts from.
    """
    one = F.coalesce(F.col("z_pq") > F.col("state_z_pq"), F.lit(False))
    low = F.coalesce(reward_min() > reward_min("state_z_pq", "state_z_sb"), F.lit(False))
    out = log.groupBy(*by).agg(F.count_if(one).alias("n_axis"), F.count_if(one & ~low).alias("n_vetoed"),
                               F.count_if(low).alias("n_min"), F.count_if(low & ~one).alias("n_driven"))
    return out.withColumns({
        "veto_share": F.when(F.col("n_axis") > 0, F.col("n_vetoed") / F.col("n_axis")),
        "driven_share": F.when(F.col("n_min") > 0, F.col("n_driven") / F.col("n_min"))})


def chunk_mean_score(frames: DataFrame, by: Sequence[str], at: str, value: str, sec: float) -> DataFrame:
    """Unweighted mean of chunk means for items longer than a chunk; the plain mean otherwise."""
    if sec <= 0:
        return frames.groupBy(*by).agg(F.avg(value).alias("score"), F.lit(1).cast("bigint").alias("n_chunks"))
    chunk = F.floor(F.col(at) / sec).cast("bigint")
    means = frames.groupBy(*by, chunk.alias("__chunk")).agg(F.avg(value).alias("__m"))
    return means.groupBy(*by).agg(F.avg("__m").alias("score"), F.count("*").alias("n_chunks"))


def with_state_z(replayed: DataFrame, by: Sequence[str]) -> DataFrame:
    """State z values before each step; the start state is the calibration mean (z = 0)."""
    from scoreloom.operators.logs import state_values
    out = state_values(replayed, ("z_pq", "z_sb"), by)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("state_z_pq", "state_z_sb")})


def floor_rate(calib: DataFrame) -> DataFrame:
    """Share of records whose scale is a floor, and the median stored std, per metric."""
    from scoreloom.operators.quantiles import exact_percentiles
    long = calib.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_floored").alias("floored"),
                                                    F.col(f"{m}_std").alias("std")) for m in METRICS])))
    rates = long.groupBy("metric").agg(F.count("*").alias("n"), F.avg(F.col("floored").cast("int")).alias("floor_rate"))
    return attach(rates, exact_percentiles(long, ["metric"], "std", {"median_std": 0.5}), ["metric"])
