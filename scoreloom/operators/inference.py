"""Paired and crossed contrasts, tests and agreement measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.scalars import finite
from scoreloom.functions.stats import binom_tail_half, norm_sf, t_cdf, t_ppf
from scoreloom.operators.joins import attach, match_repeats, subset_pairs
from scoreloom.operators.logs import rank_no_ties
from scoreloom.operators.raters import rater_pairs
from scoreloom.operators.scan import prefix_scan, range_blocks, running_sum
from scoreloom.session import materialize

MIN_PAIRS = 8


# --- paired arms ---------------------------------------------------------------------------------


def paired_contrast(pairs: DataFrame, by: Sequence[str], metrics: Sequence[str] = ("pq", "sb")) -> DataFrame:
    """n, mean difference (b - a) and win rate of b per metric, over rows with ``<metric>_a`` / ``<metric>_b``."""
    aggs = [F.count("*").alias("n")]
    for m in metrics:
        d = F.col(f"{m}_b") - F.col(f"{m}_a")
        aggs += [F.avg(d).alias(f"d_{m}_mean"), F.avg((d > 0).cast("int")).alias(f"{m}_win")]
    return pairs.groupBy(*by).agg(*aggs)


def contrast_subsets(pairs: DataFrame, durations: DataFrame, by: Sequence[str], song: str = "song", limit: float = 300.0,
                     metrics: Sequence[str] = ("pq", "sb")) -> DataFrame:
    """The paired contrast on all songs and on the short ones; songs without a duration count as long and are reported."""
    j = pairs.join(durations.select(song, F.col("duration").alias("__d")), song, "left")
    sets = F.array_compact(F.array(F.lit("all"), F.when(F.col("__d") <= limit, "short")))
    rows = j.withColumn("subset", F.explode(sets))
    out = paired_contrast(rows, [*by, "subset"], metrics)
    unknown = j.groupBy(*by).agg(F.count_if(F.col("__d").isNull()).alias("n_unknown_duration"))
    return attach(out, unknown, by)


def wilcoxon_signed_rank(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Signed-rank test: zeros dropped, average ranks for ties, normal form with tie correction.

    Equal magnitudes are counted first; only the distinct magnitudes are put in order, range by range.
    """
    d = finite(value)
    # Equal decimal differences may differ in the last bits; 12 decimals decide what a tie is.
    x = F.round(F.abs(d), 12)
    mags = df.where(d.isNotNull() & (x > 0)).groupBy(*by, x.alias("__v")).agg(
        F.count("*").alias("__c"), F.count_if(d > 0).alias("__p"))
    order = [F.asc("__v")]
    ranked = prefix_scan(range_blocks(mags, by, order), by, order, F.col("__range"), {"__before": running_sum("__c", inclusive=False)})
    c = F.col("__c").cast("double")
    rank = F.coalesce("__before", F.lit(0)) + (c + 1) / 2
    out = ranked.groupBy(*by).agg(F.sum("__c").alias("n"), F.sum(F.col("__p") * rank).alias("w_plus"),
                                  F.sum(c * c * c - c).alias("__ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("__ties") / 48
    out = out.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)).drop("__ties")
    return out.withColumns({"p_two": F.least(F.lit(1.0), 2 * norm_sf(F.abs("z"))), "p_greater": norm_sf("z")})


# --- rating contrasts ----------------------------------------------------------------------------


def complete_screens(ratings: DataFrame, n: int, by: Sequence[str] = ("listener", "song")) -> DataFrame:
    """Ratings of the screens on which n different conditions were rated."""
    full = ratings.groupBy(*by).agg(F.count_distinct("condition").alias("__n")).where(F.col("__n") == n).select(*by)
    return ratings.join(full, list(by), "left_semi")


def screen_differences(ratings: DataFrame, contrasts: Sequence[tuple], by: Sequence[str] = ("listener", "song"),
                       value: str = "score", order: str | None = None) -> DataFrame:
    """Within-screen difference a - b per contrast; duplicated cells are averaged, incomplete ones dropped.

    One conditional aggregation serves all contrasts, so the ratings are shuffled once.
    """
    conds = sorted({c for con in contrasts for c in con[1:3]})
    col = {c: f"__m{i}" for i, c in enumerate(conds)}
    aggs = [F.avg(F.when(F.col("condition") == c, F.col(value))).alias(col[c]) for c in conds]
    if order:
        aggs.append(F.min(order).alias(order))
    cells = ratings.where(F.col("condition").isin(*conds)).groupBy(*by).agg(*aggs)
    rows = F.filter(F.array(*[F.struct(F.lit(c[0]).alias("contrast"), (F.col(col[c[1]]) - F.col(col[c[2]])).alias("d"))
                              for c in contrasts]), lambda s: s["d"].isNotNull())
    return cells.select(*by, *([order] if order else []), F.inline(rows))


def crossed_contrast(d: DataFrame, s_per: float, by: Sequence[str] = ("contrast",), listener: str = "listener",
                     song: str = "song", value: str = "d") -> DataFrame:
    """Mean, listener / song / residual spreads, mixed and listener-only standard errors with normal p values.

    Contrasts with fewer than ``MIN_PAIRS`` complete pairs are estimated as well and flagged ``too_few_pairs``.
    """
    by = list(by)
    ml = d.groupBy(*by, listener).agg(F.avg(value).alias("__ml"))
    ms = d.groupBy(*by, song).agg(F.avg(value).alias("__ms"))
    top = d.groupBy(*by).agg(F.avg(value).alias("mu"), F.count("*").alias("n"))
    by_l = ml.groupBy(*by).agg(F.count("*").alias("L"), F.stddev_samp("__ml").alias("__tl"), F.avg("__ml").alias("__mml"))
    by_s = ms.groupBy(*by).agg(F.count("*").alias("S"), F.stddev_samp("__ms").alias("__ts"))
    res = attach(attach(attach(d, ml, [*by, listener]), ms, [*by, song]), top.select(*by, "mu"), by)
    res = res.groupBy(*by).agg(F.stddev_samp(F.col(value) - F.col("__ml") - F.col("__ms") + F.col("mu")).alias("__sg"))
    out = attach(attach(attach(top, by_l, by), by_s, by), res, by)
    zero = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    out = out.withColumns({"tau_l": zero("__tl"), "tau_s": zero("__ts"), "sigma": zero("__sg")})
    sq = lambda c: F.col(c) * F.col(c)
    out = out.withColumns({"se": F.sqrt(sq("tau_l") / F.col("L") + sq("tau_s") / F.col("S") + sq("sigma") / (F.col("L") * s_per)),
                           "se_listener": F.col("tau_l") / F.sqrt(F.col("L"))})
    out = out.withColumns({"p_one": F.when(F.col("se") > 0, norm_sf(F.abs("mu") / F.col("se"))),
                           "p_listener": F.when(F.col("se_listener") > 0, 2 * norm_sf(F.abs("__mml") / F.col("se_listener")))})
    return out.select(*by, "n", "L", "S", "mu", "tau_l", "tau_s", "sigma", "se", "se_listener", "p_one", "p_listener",
                      (F.col("n") < MIN_PAIRS).alias("too_few_pairs"))


def crossed_components(d: DataFrame, by: Sequence[str] = ("contrast",), listener: str = "listener", song: str = "song",
                       value: str = "d") -> DataFrame:
    """Variance components of d = mu + u(listener) + v(song) + e by the method of moments for unbalanced crossed data.

    Only sums over groups are needed, so it distributes; negative solutions are reported as 0.
    """
    by = list(by)
    x = F.col(value)
    cell = d.groupBy(*by, listener, song).agg(F.count("*").alias("__n"), F.sum(value).alias("__t"), F.sum(x * x).alias("__q"))
    n2 = F.col("__n") * F.col("__n")

    def margin(key: str, tag: str) -> DataFrame:
        g = cell.groupBy(*by, key).agg(F.sum("__n").alias("n"), F.sum("__t").alias("t"), F.sum(n2).alias("c"))
        return g.groupBy(*by).agg(F.count("*").alias(f"__g{tag}"), F.sum(F.col("t") * F.col("t") / F.col("n")).alias(f"__T{tag}"),
                                  F.sum(F.col("n") * F.col("n")).alias(f"__N{tag}"), F.sum(F.col("c") / F.col("n")).alias(f"__k{tag}"))

    tot = cell.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum("__t").alias("__s"), F.sum("__q").alias("__T0"))
    j = attach(attach(tot, margin(listener, "l"), by), margin(song, "s"), by)
    n, tm = F.col("n").cast("double"), F.col("__s") * F.col("__s") / F.col("n")
    a = [n - F.col("__Nl") / n, F.col("__ks") - F.col("__Nl") / n, F.col("__Nl") / n - F.col("__ks")]
    b = [F.col("__kl") - F.col("__Ns") / n, n - F.col("__Ns") / n, F.col("__Ns") / n - F.col("__kl")]
    c = [F.col("__gl") - 1, F.col("__gs") - 1, n - F.col("__gl") - F.col("__gs") + 1]
    r = [F.col("__Tl") - tm, F.col("__Ts") - tm, F.col("__T0") - F.col("__Tl") - F.col("__Ts") + tm]

    def det(p: Sequence[Column], q: Sequence[Column], s: Sequence[Column]) -> Column:
        return (p[0] * (q[1] * s[2] - q[2] * s[1]) - q[0] * (p[1] * s[2] - p[2] * s[1]) + s[0] * (p[1] * q[2] - p[2] * q[1]))

    base = F.nullif(det(a, b, c), F.lit(0.0))
    sd = lambda v: F.sqrt(F.greatest(F.lit(0.0), v / base))
    return j.select(*by, "n", (F.col("__s") / n).alias("mu"), sd(det(r, b, c)).alias("sd_listener"),
                    sd(det(a, r, c)).alias("sd_song"), sd(det(a, b, r)).alias("sd_resid"))


def t_tests(res: DataFrame) -> DataFrame:
    """t, p values and 95 / 90 % intervals of contrast rows (mu, se, L, S)."""
    df = F.greatest(F.least("L", "S") - 1, F.lit(2)).cast("int")
    out = res.withColumn("df", df)
    t = F.when(F.col("se") > 0, F.col("mu") / F.col("se")).otherwise(F.lit(float("inf")))
    out = out.withColumns({"t": t, "t95": t_ppf(0.975, "df"), "t90": t_ppf(0.95, "df")})
    out = out.withColumns({"p_less": t_cdf("t", "df"), "__a": t_cdf(F.abs("t"), "df")})
    half = lambda q: F.col(q) * F.col("se")
    return out.withColumns({
        "p_greater": 1 - F.col("p_less"), "p_two": 2 * (1 - F.col("__a")),
        "ci95_lo": F.col("mu") - half("t95"), "ci95_hi": F.col("mu") + half("t95"),
        "ci90_lo": F.col("mu") - half("t90"), "ci90_hi": F.col("mu") + half("t90")}).drop("__a", "t95", "t90")


def noninferiority(res: DataFrame, margin: float = 10.0) -> DataFrame:
    """One-sided test of mu > -margin with its lower bound; needs the ``df`` of :func:`t_tests`."""
    shifted = F.col("mu") + margin
    t = F.when(F.col("se") > 0, shifted / F.col("se")).when(shifted > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    p = F.when(F.col("se") > 0, 1 - t_cdf(t, "df")).when(shifted > 0, 0.0).otherwise(1.0)
    lower = F.col("mu") - t_ppf(0.95, "df") * F.col("se")
    out = res.withColumns({"noninf_margin": F.lit(float(margin)), "t_noninf": t, "p_noninf": p, "ci95_lower": lower})
    return out.withColumn("noninferior", F.col("ci95_lower") > -margin)


def tost(res: DataFrame, lo: float, hi: float) -> DataFrame:
    """Are the 95 and 90 % intervals inside the equivalence band?"""
    inside = lambda q: (F.col(f"{q}_lo") > lo) & (F.col(f"{q}_hi") < hi)
    return res.withColumns({"equivalent_95": inside("ci95"), "equivalent_90": inside("ci90")})


def order_slope(d: DataFrame, order: str, by: Sequence[str] = ("contrast",), value: str = "d") -> DataFrame:
    """Slope of the difference on the presentation order; null without spread."""
    return d.groupBy(*by).agg(F.regr_slope(value, F.col(order).cast("double")).alias("order_slope"))


def holm(df: DataFrame, p: str, by: Sequence[str] = (), tie: str | None = None, name: str = "p_holm") -> DataFrame:
    """Holm step-down adjusted p values within a family; a family is a handful of planned tests."""
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    order = part.orderBy(F.asc(p), *([F.asc(tie)] if tie else []))
    out = df.withColumns({"__i": F.row_number().over(order) - 1, "__m": F.count("*").over(part)})
    step = (F.col("__m") - F.col("__i")) * F.col(p)
    run = F.max(step).over(order.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn(name, F.least(F.lit(1.0), run)).drop("__i", "__m")


def primary_family(res: DataFrame, planned: Sequence[tuple], expected: int = 3, demote: Sequence[str] = ()) -> DataFrame:
    """The planned primary tests with Holm adjustment; a short family and demoted tests carry a note.

    ``planned``: (name, a, b, side, family); the non-inferiority test uses ``p_noninf``, the others ``p_greater``.
    """
    side = F.create_map(*[F.lit(x) for c in planned if c[4].startswith("primary") for x in (c[0], c[3])])
    fam = res.withColumn("side", F.element_at(side, F.col("contrast"))).where(F.col("side").isNotNull())
    fam = fam.withColumn("p_raw", F.when(F.col("side") == "noninf", F.col("p_noninf")).otherwise(F.col("p_greater")))
    fam = fam.where(F.col("p_raw").isNotNull() & ~F.isnan("p_raw"))
    out = holm(fam, "p_raw", (), "contrast")
    short = F.count("*").over(W.partitionBy(F.lit(0))) < expected
    note = F.array_join(F.array_compact(F.array(
        F.when(F.col("contrast").isin(*demote) if demote else F.lit(False), "demoted"), F.when(short, "family_incomplete"))), ",")
    return out.select("contrast", "side", "p_raw", "p_holm", (F.col("p_holm") < 0.05).alias("significant"), note.alias("note"))


# --- choices -------------------------------------------------------------------------------------


def preference_rate(afc: DataFrame, target: str, lo: float = 0.44, hi: float = 0.56) -> DataFrame:
    """Listener-level preference for ``target`` over first presentations: mean, sd, t interval, equivalence."""
    first = afc.where(F.col("choice").isNotNull() & ~F.col("is_repeat"))
    rates = first.groupBy("listener").agg(F.avg((F.col("choice") == target).cast("int")).alias("r"), F.count("*").alias("n"))
    out = rates.agg(F.count("*").alias("n_listeners"), F.sum("n").alias("n_trials"), F.avg("r").alias("rate_mean"),
                    F.stddev_samp("r").alias("rate_sd"))
    se = F.col("rate_sd") / F.sqrt(F.col("n_listeners"))
    half = F.when(F.col("n_listeners") > 1, t_ppf(0.975, (F.col("n_listeners") - 1).cast("int")) * se)
    out = out.withColumns({"ci_lo": F.col("rate_mean") - half, "ci_hi": F.col("rate_mean") + half})
    return out.withColumn("equivalent", F.coalesce((F.col("ci_lo") > lo) & (F.col("ci_hi") < hi), F.lit(False)))


def preference_by_song(afc: DataFrame, target: str) -> DataFrame:
    first = afc.where(F.col("choice").isNotNull() & ~F.col("is_repeat"))
    return first.groupBy("song").agg(F.avg((F.col("choice") == target).cast("int")).alias("rate"), F.count("*").alias("n"))


def repeat_agreement(afc: DataFrame) -> DataFrame:
    """Share of repeats with the same choice as their original, per listener that has any match."""
    m = match_repeats(afc).where(F.col("original_choice").isNotNull())
    return m.groupBy("listener").agg(F.avg((F.col("choice") == F.col("original_choice")).cast("int")).alias("agreement"),
                                     F.count("*").alias("n_repeats"))


def abx_accuracy(abx: DataFrame, demote_at: float = 0.60) -> DataFrame:
    """Listener accuracy with t interval, pooled exact binomial tail against chance and the demotion flag."""
    acc = abx.groupBy("listener").agg(F.avg(F.col("correct").cast("int")).alias("a"), F.count("*").alias("n"),
                                      F.count_if("correct").alias("k"))
    out = acc.agg(F.count("*").alias("n_listeners"), F.sum("n").alias("n_trials"), F.sum("k").alias("n_correct"),
                  F.avg("a").alias("accuracy"), F.stddev_samp("a").alias("__sd"))
    half = F.when(F.col("n_listeners") > 1, t_ppf(0.975, (F.col("n_listeners") - 1).cast("int")) * F.col("__sd") / F.sqrt("n_listeners"))
    out = out.withColumns({"ci_lo": F.col("accuracy") - half, "ci_hi": F.col("accuracy") + half,
                           "p_binom": binom_tail_half("n_correct", "n_trials")})
    return out.withColumn("demote", F.col("accuracy") <= demote_at).drop("__sd")


# --- agreement -----------------------------------------------------------------------------------


def metric_vs_human(auto: DataFrame, human: DataFrame, item: str = "item") -> DataFrame:
    """Pearson and tie-less rank correlation of each metric with the human value.

    ``auto``: item, metric, score; ``human``: item, value. Metrics that miss a shared item are left out.
    """
    h = materialize(human.join(auto.select(item), item, "left_semi"), "human")
    j = auto.join(h, item)
    total = h.agg(F.count("*").alias("__all"))
    full = j.groupBy("metric").agg(F.count("*").alias("n")).join(F.broadcast(total), F.col("n") == F.col("__all")).select("metric", "n")
    # A complete metric covers exactly the shared items, so the human ranks are the same for all of them.
    complete = auto.join(full.select("metric"), "metric", "left_semi").join(h.select(item), item, "left_semi")
    ranked = rank_no_ties(materialize(complete, "auto"), ["metric"], "score", item, name="__ra")
    human_ranks = rank_no_ties(h, [], "value", item, name="__rh")
    out = ranked.join(human_ranks, item).groupBy("metric").agg(
        F.count("*").alias("n"), F.corr("__ra", "__rh").alias("spearman"),
        F.when(F.stddev_pop("score") > 0, F.corr("score", "value")).alias("pearson"))
    return out


def rater_agreement(cells: DataFrame, rater: str, item: str, value: str, min_shared: int = 3) -> DataFrame:
    """Tie-less rank correlation of every rater pair with enough shared items."""
    return rater_pairs(cells, rater, item, value, min_shared, diff=False)


def shapley(grid: DataFrame, elements: int) -> DataFrame:
    """Exact Shapley value per element over the cells that exist."""
    pairs = subset_pairs(grid, elements)
    size = F.bit_count("mask")
    weight = F.element_at(F.array(*[F.lit(math.factorial(s) * math.factorial(elements - s - 1) / math.factorial(elements))
                                    for s in range(elements)]), size + 1)
    gain = finite("value_with") - finite("value_without")
    return pairs.groupBy("element").agg(F.sum(F.when(gain.isNotNull(), weight * gain)).alias("shapley"))


