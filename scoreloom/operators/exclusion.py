"""Ordered exclusion of participants: every stage sees only the survivors of the stages before.

Facts are reduced to one row per listener first. The stages then run on that table and need from the survivors only
scalars: a share, a median, two quartiles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.scalars import finite
from scoreloom.operators.inference import repeat_agreement
from scoreloom.operators.joins import attach, match_repeats
from scoreloom.operators.quantiles import exact_percentiles
from scoreloom.operators.rules import screen_check
from scoreloom.session import materialize, shared_exchange

KEY = ["listener"]


@dataclass(frozen=True)
class Screening:
    hp_min: int = 5
    ap_min: int = 5
    require_stage1: bool = False
    require_eligibility_record: bool = False
    required_screens: int = 8
    required_afc: int = 12
    afc_block_expected: bool | None = None
    afc_block_min_share: float = 0.5
    screen_fail_frac: float = 0.20
    speeder_factor: float = 0.5
    repeat_agree_min: float = 0.25
    iqr_k: float = 1.5
    anchor: str = "random_dry"


def all_listeners(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("listener")
    for t in tables[1:]:
        out = out.unionByName(t.select("listener"))
    return out.distinct()


# --- one row per listener ------------------------------------------------------------------------


def verdict_flags(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(*KEY).agg(F.bool_and("eligible").alias("eligible"))


def stage1_flags(stage1: DataFrame, cfg: Screening) -> DataFrame:
    return stage1.groupBy(*KEY).agg(F.bool_or(_stage1_bad(cfg)).alias("stage1_bad"))


def _stage1_bad(cfg: Screening) -> Column:
    return F.coalesce(finite("hp") < cfg.hp_min, F.lit(False)) | F.coalesce(finite("ap") < cfg.ap_min, F.lit(False))


def completion_counts(session: DataFrame, mushra: DataFrame, afc: DataFrame) -> DataFrame:
    flag = session.groupBy(*KEY).agg(F.max("completed").alias("completed"))
    screens = mushra.groupBy(*KEY).agg(F.count_distinct(F.struct("song", "screen")).alias("n_screens"))
    trials = afc.groupBy(*KEY).agg(F.count("*").alias("n_afc"))
    ids = all_listeners(session, mushra, afc)
    return attach(attach(attach(ids, flag, KEY), screens, KEY), trials, KEY)


def screen_fail_share(mushra: DataFrame, cfg: Screening) -> DataFrame:
    checks = screen_check(mushra, cfg.anchor)
    return checks.groupBy(*KEY).agg(F.avg(F.col("failed").cast("int")).alias("fail_frac"))


def total_time(session: DataFrame, mushra: DataFrame, afc: DataFrame, order: str = "seq") -> DataFrame:
    """Longest finite session total, else the first known duration of each screen (by ``order``) plus all trial durations."""
    first = mushra.groupBy(*KEY, "song", "screen").agg(_first_duration(order).alias("__d"))
    rows = _stack(session.select("listener", finite("total_sec").alias("__s")), first.select("listener", "__d"),
                  afc.select("listener", F.col("dur").alias("__a")))
    return rows.groupBy(*KEY).agg(_total_seconds().alias("total_sec"))


def _first_duration(order: str) -> Column:
    """Duration on the first row that has one; rows of equal place count by duration."""
    known = finite("dur")
    return F.min(F.when(known.isNotNull(), F.struct(F.col(order), known.alias("d"))))["d"]


def _total_seconds() -> Column:
    zero = F.lit(0.0)
    return F.coalesce(F.max("__s"), F.coalesce(F.sum("__d"), zero) + F.coalesce(F.sum(finite("__a")), zero))


def listener_means(mushra: DataFrame) -> DataFrame:
    return mushra.groupBy(*KEY).agg(F.avg("score").alias("mean_score"))


def _stack(*parts: DataFrame) -> DataFrame:
    """All rows below each other; a column that a part does not have is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def listener_features(mushra: DataFrame, afc: DataFrame, session: DataFrame, stage1: DataFrame, verdicts: DataFrame,
                      cfg: Screening, order: str = "seq") -> DataFrame:
    """Everything the stages look at, one row per listener.

    Ratings are reduced to one row per screen and repeats to their agreement; these and the rows of the other tables go
    below each other and meet in one aggregation. A listener known from verdicts only is no participant.
    """
    screens = screen_check(mushra, cfg.anchor, extra={
        "__d": _first_duration(order), "__score": F.sum("score"), "__scores": F.count("score")})
    agree = match_repeats(afc).where(F.col("original_choice").isNotNull()).select(
        "listener", (F.col("choice") == F.col("original_choice")).cast("int").alias("__agree"))
    here = F.lit(True).alias("__here")
    rows = _stack(
        screens.select("listener", here, "song", F.col("failed").cast("int").alias("__failed"), F.lit(1).alias("__screen"),
                       "__d", "__score", "__scores"),
        afc.select("listener", here, F.lit(1).alias("__trial"), F.col("dur").alias("__a")), agree,
        session.select("listener", here, "completed", finite("total_sec").alias("__s")),
        stage1.select("listener", here, _stage1_bad(cfg).alias("__bad")), verdicts.select("listener", "eligible"))
    facts = rows.groupBy(*KEY).agg(
        F.max("__here").alias("__here"), F.bool_and("eligible").alias("eligible"), F.bool_or("__bad").alias("stage1_bad"),
        F.max("completed").alias("completed"), F.sum("__screen").alias("n_screens"), F.sum("__trial").alias("n_afc"),
        F.avg("__failed").alias("fail_frac"), _total_seconds().alias("total_sec"), F.avg("__agree").alias("agreement"),
        (F.sum("__score") / F.sum("__scores")).alias("mean_score"))
    return facts.where("__here").drop("__here")


# --- stages: each returns the excluded listeners of ``alive`` --------------------------------------


def _ineligible(cfg: Screening) -> Column:
    bad = F.col("eligible") == False  # noqa: E712
    return F.coalesce(bad, F.lit(cfg.require_eligibility_record))


def _stage1(cfg: Screening) -> Column:
    return F.coalesce("stage1_bad", F.lit(cfg.require_stage1))


def _incomplete(cfg: Screening, block_on: Column) -> Column:
    n_afc = F.coalesce("n_afc", F.lit(0))
    need = F.when(block_on | (n_afc > 0), cfg.required_afc).otherwise(0)
    by_count = (F.coalesce("n_screens", F.lit(0)) >= cfg.required_screens) & (n_afc >= need)
    return ~F.coalesce("completed", by_count)


def exclude_ineligible(alive: DataFrame, verdicts: DataFrame, cfg: Screening = Screening()) -> DataFrame:
    return attach(alive, verdict_flags(verdicts), KEY).where(_ineligible(cfg)).select("listener")


def exclude_stage1(alive: DataFrame, stage1: DataFrame, cfg: Screening = Screening()) -> DataFrame:
    return attach(alive, stage1_flags(stage1, cfg), KEY).where(_stage1(cfg)).select("listener")


def exclude_incomplete(alive: DataFrame, session: DataFrame, mushra: DataFrame, afc: DataFrame,
                       cfg: Screening = Screening()) -> DataFrame:
    f = attach(alive, completion_counts(session, mushra, afc), KEY)
    return _with_block(f, cfg).where(_incomplete(cfg, F.col("__on"))).select("listener")


def _with_block(f: DataFrame, cfg: Screening) -> DataFrame:
    """Was the choice block part of this study? Decided by the share of survivors that have trials."""
    if cfg.afc_block_expected is not None:
        return f.withColumn("__on", F.lit(cfg.afc_block_expected))
    share = f.agg((F.avg((F.coalesce("n_afc", F.lit(0)) > 0).cast("int")) >= cfg.afc_block_min_share).alias("__on"))
    return f.join(F.broadcast(share), F.lit(True))


def exclude_bad_screens(alive: DataFrame, mushra: DataFrame, cfg: Screening = Screening()) -> DataFrame:
    mine = mushra.join(alive, KEY, "left_semi")
    return screen_fail_share(mine, cfg).where(F.col("fail_frac") > cfg.screen_fail_frac).select("listener")


def exclude_speeders(alive: DataFrame, times: DataFrame, cfg: Screening = Screening()) -> DataFrame:
    f = shared_exchange(attach(alive, times, KEY).select("listener", F.coalesce("total_sec", F.lit(0.0)).alias("total_sec")))
    return _with_median_time(f).where(F.col("total_sec") < cfg.speeder_factor * F.col("__med")).select("listener")


def _with_median_time(f: DataFrame) -> DataFrame:
    med = exact_percentiles(f.where(F.col("total_sec") > 0), [], "total_sec", {"__med": 0.5})
    return f.join(F.broadcast(med), F.lit(True), "left")


def exclude_unreliable(alive: DataFrame, afc: DataFrame, cfg: Screening = Screening()) -> DataFrame:
    mine = afc.join(alive, KEY, "left_semi")
    return repeat_agreement(mine).where(F.col("agreement") < cfg.repeat_agree_min).select("listener")


def exclude_outliers(alive: DataFrame, mushra: DataFrame, cfg: Screening = Screening()) -> DataFrame:
    f = shared_exchange(listener_means(mushra.join(alive, KEY, "left_semi")))
    return _with_fences(f, cfg).where(_outside(F.col("__lo"), F.col("__hi"))).select("listener")


def _with_fences(f: DataFrame, cfg: Screening) -> DataFrame:
    return f.join(F.broadcast(_fences(f, cfg)), F.lit(True), "left")


def _fences(f: DataFrame, cfg: Screening) -> DataFrame:
    q = exact_percentiles(f, [], "mean_score", {"__q1": 0.25, "__q3": 0.75})
    n = f.agg(F.count("mean_score").alias("__n"))
    iqr = F.col("__q3") - F.col("__q1")
    return q.join(F.broadcast(n), F.lit(True)).select(
        F.when(F.col("__n") >= 4, F.col("__q1") - cfg.iqr_k * iqr).alias("__lo"),
        F.when(F.col("__n") >= 4, F.col("__q3") + cfg.iqr_k * iqr).alias("__hi"))


def _outside(lo: Column, hi: Column) -> Column:
    return F.coalesce((F.col("mean_score") < lo) | (F.col("mean_score") > hi), F.lit(False))


STAGES = ["1a_ineligible", "1_stage1_hp_ap", "2_incomplete", "3_screen_checks", "4_speeder", "5_afc_repeat", "6_iqr_outlier"]


def assign_stages(features: DataFrame, cfg: Screening = Screening()) -> DataFrame:
    """The criteria each listener fails as a bit mask, and the stage that excludes them (null: kept).

    Bit i stands for ``STAGES[i]``; every criterion is judged against the survivors of the stages before, for excluded
    listeners too. The facts are reduced once to the table of listeners; the share, the median and the quartiles of the
    survivors are one-row jobs on it (this starts jobs), and the mask is a single projection with these numbers.
    """
    f = materialize(features, "listeners")
    mask = _bit(0, _ineligible(cfg)) + _bit(1, _stage1(cfg))
    on = cfg.afc_block_expected
    if on is None:
        share = f.where(mask == 0).agg(F.avg((F.coalesce("n_afc", F.lit(0)) > 0).cast("int"))).first()[0]
        on = share is not None and share >= cfg.afc_block_min_share
    mask += _bit(2, _incomplete(cfg, F.lit(on))) + _bit(3, F.col("fail_frac") > cfg.screen_fail_frac)
    med = exact_percentiles(f.where((mask == 0) & (F.col("total_sec") > 0)), [], "total_sec", {"__med": 0.5}).first()
    fast = F.col("total_sec") < cfg.speeder_factor * med["__med"] if med else F.lit(False)
    mask += _bit(4, fast) + _bit(5, F.col("agreement") < cfg.repeat_agree_min)
    fences = _fences(f.where((mask == 0) & F.col("mean_score").isNotNull()), cfg).first()
    lo, hi = (fences["__lo"], fences["__hi"]) if fences else (None, None)
    mask += _bit(6, _outside(F.lit(lo).cast("double"), F.lit(hi).cast("double")))
    out = f.withColumn("mask", mask)
    return out.withColumn("stage", F.coalesce(*[F.when(F.col("mask").bitwiseAND(1 << i) > 0, s) for i, s in enumerate(STAGES)]))


def _bit(i: int, failed: Column) -> Column:
    return F.when(failed, 1 << i).otherwise(0)


def exclusion_counts(assigned: DataFrame) -> DataFrame:
    """Per stage in order: excluded and remaining listeners."""
    position = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    one = assigned.agg(F.count("*").alias("__all"), *[F.count_if(position == i).alias(f"__x{i}") for i in range(1, len(STAGES) + 1)])
    gone, out = F.lit(0), []
    for i, s in enumerate(STAGES, 1):
        gone = gone + F.col(f"__x{i}")
        out.append(F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage"), F.col(f"__x{i}").alias("n_excluded"),
                            (F.col("__all") - gone).alias("n_remaining")))
    return one.select(F.inline(F.array(*out)))


def exclusion_table(assigned: DataFrame) -> DataFrame:
    """The counts of :func:`exclusion_counts` with the ids: one row per excluded listener, a null id for a stage without any.

    Ids are rows and not a list per stage, so a stage may exclude any number of listeners. ``also_failed`` counts the later
    criteria that the listener fails as well.
    """
    counts = exclusion_counts(assigned)
    gone = assigned.where(F.col("stage").isNotNull()).select(
        F.col("stage").alias("__stage"), "listener", (F.bit_count("mask") - 1).alias("also_failed"))
    return gone.join(F.broadcast(counts), F.col("__stage") == F.col("stage")).select(
        *counts.columns, "listener", "also_failed").unionByName(counts.where("n_excluded = 0"), allowMissingColumns=True)


def survivors(assigned: DataFrame) -> DataFrame:
    return assigned.where(F.col("stage").isNull()).select("listener")
