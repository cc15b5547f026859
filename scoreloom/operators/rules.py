"""Table-driven rules: validation, clamping, repair, gates, advice, tiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import tables as TB
from scoreloom.functions.scalars import finite, nan_to_null


def limits_frame(spark, mode: str = "research", extra: Sequence[tuple] = ()) -> DataFrame:
    """Limit table (action, arg, lo, hi); ``unsafe`` widens some ranges, ``extra`` adds or replaces rows."""
    rows = {(a, g): (lo, hi) for a, g, lo, hi in TB.ACTION_LIMITS}
    if mode == "unsafe":
        rows.update({(a, g): (lo, hi) for a, g, lo, hi in TB.ACTION_LIMITS_WIDE})
    rows.update({(a, g): (lo, hi) for a, g, lo, hi in extra})
    return spark.createDataFrame([(a, g, lo, hi) for (a, g), (lo, hi) in rows.items()],
                                 "action string, arg string, lo double, hi double")


def _limits_per_action(limits: DataFrame) -> DataFrame:
    # A catalogue: a few arguments for each of a few dozen actions.
    return limits.groupBy("action").agg(F.array_sort(F.collect_list(F.struct("arg", "lo", "hi"))).alias("__lim"))


def validate_actions(df: DataFrame, limits: DataFrame, tracks: str = "tracks") -> DataFrame:
    """Reasons against a proposal (action, track, args map): unknown action or track, missing or out-of-range
    arguments. An empty array means valid."""
    out = df.join(F.broadcast(_limits_per_action(limits)), "action", "left")
    lim = F.coalesce("__lim", F.array().cast("array<struct<arg:string,lo:double,hi:double>>"))

    def judge(x: Column) -> Column:
        v = F.element_at(F.col("args"), x["arg"])
        return (F.when(v.isNull(), F.concat(F.lit("missing:"), x["arg"]))
                .when(~v.between(x["lo"], x["hi"]), F.concat(F.lit("range:"), x["arg"])))

    head = F.array(F.when(F.col("__lim").isNull(), "unknown_action"),
                   F.when(F.col("track").isNotNull() & ~F.array_contains(tracks, F.col("track")), "unknown_track"))
    reasons = F.filter(F.concat(head, F.transform(lim, judge)), lambda r: r.isNotNull())
    return out.withColumn("reasons", reasons).drop("__lim")


def clamp_to_limits(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Bring every limited argument into its range; other arguments pass through."""
    per = _limits_per_action(limits).select("action", F.map_from_arrays("__lim.arg", "__lim").alias("__m"))
    out = df.join(F.broadcast(per), "action", "left")

    def clamp(k: Column, v: Column) -> Column:
        lim = F.element_at(F.col("__m"), k)
        return F.when(lim.isNull(), v).otherwise(F.greatest(lim["lo"], F.least(lim["hi"], v)))

    return out.withColumn("args", F.transform_values("args", clamp)).drop("__m")


def check_breakpoints(points: str = "breakpoints", lo: float = -18.0, hi: float = 12.0, max_points: int = 64,
                      window_sec: float | None = None) -> Column:
    """Reasons against an automation curve ``array<struct<t,v>>``."""
    p = F.col(points)
    ts = F.transform(p, lambda x: x["t"])
    first = F.get(ts, F.lit(0))
    tests = [F.when(F.coalesce(F.size(p), F.lit(0)) < 2, "too_few_points"),
             F.when((ts != F.array_sort(ts)) | (first < 0), "time_order"),
             F.when(F.exists(p, lambda x: ~x["v"].between(lo, hi)), "value_range"),
             F.when(F.size(p) > max_points, "too_many_points")]
    if window_sec is not None and window_sec > 0:
        tests.append(F.when(first >= window_sec, "outside_window"))
    return F.filter(F.array(*tests), lambda r: r.isNotNull())


def repair_track(df: DataFrame, tracks: str = "tracks") -> DataFrame:
    """Repair the track of a proposal: a whole-mix name turns a static action into its master twin, an unknown name
    becomes the first track that contains it or is contained in it, else the first track."""
    t = F.lower(F.trim("track"))
    master = F.element_at(F.create_map(*[F.lit(x) for kv in TB.STATIC_TO_MASTER.items() for x in kv]), F.col("action"))
    pseudo = F.col("track").isNotNull() & t.isin(*TB.PSEUDO_TRACKS)
    known = F.array_contains(tracks, F.col("track"))
    near = F.get(F.filter(tracks, lambda s: F.contains(F.lower(s), t) | F.contains(t, F.lower(s))), F.lit(0))
    first = F.get(tracks, F.lit(0))
    track = (F.when(F.col("track").isNull() | (pseudo & master.isNotNull()), F.lit(None).cast("string"))
             .when(pseudo & first.isNotNull(), first).when(known | first.isNull(), F.col("track")).otherwise(F.coalesce(near, first)))
    action = F.when(pseudo & master.isNotNull(), master).otherwise(F.col("action"))
    return df.withColumns({"repaired_action": action, "repaired_track": track})


def scope_match(df: DataFrame, scopes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Does the scope of the action fit the declared resolution? An unknown resolution allows everything."""
    per = allowed.groupBy("resolution").agg(F.collect_set("scope").alias("__allowed"))
    out = df.join(F.broadcast(scopes), "action", "left").join(F.broadcast(per), "resolution", "left")
    ok = F.col("scope").isNotNull() & (F.col("__allowed").isNull() | F.array_contains("__allowed", F.col("scope")))
    return out.withColumn("allowed", ok).drop("__allowed")


# --- candidate policy ----------------------------------------------------------------------------


def map_reward(scores: Column, weights: dict[str, float] | None = None,
               calib: dict[str, tuple[float, float]] | None = None) -> Column:
    """Weighted, calibrated mean over a score map (the Column form of ``weighted_reward``)."""
    weights = TB.REWARD_WEIGHTS if weights is None else weights
    calib = TB.REWARD_CALIBRATION if calib is None else calib
    total, mass = F.lit(0.0), F.lit(0.0)
    for key, w in weights.items():
        if w == 0:
            continue
        v = finite(F.element_at(scores, key))
        mean, std = calib.get(key, (0.0, 0.0))
        z = (v - mean) / std if std > 1e-9 else v
        total = total + F.coalesce(w * z, F.lit(0.0))
        mass = mass + F.when(v.isNotNull(), abs(w)).otherwise(0.0)
    return F.when(mass > 0, total / mass).otherwise(0.0)


@dataclass(frozen=True)
class Policy:
    target_lufs: float = -14.0
    lufs_tolerance: float = 6.0
    true_peak_max_db: float = -1.0
    stereo_corr_min: float = -0.3
    min_delta: float = 0.02
    epsilon: float = 0.005
    axes: Sequence[str] = ("audiobox.PQ", "audiobox.PC", "audiobox.CE", "audiobox.CU")
    weights: dict[str, float] | None = None
    calib: dict[str, tuple[float, float]] | None = None


def classify_candidate(df: DataFrame, prev: str = "prev", cand: str = "cand", policy: Policy = Policy()) -> DataFrame:
    """Hard gates, then a per-axis regression check, then the reward difference.

    A missing or NaN score passes every gate and axis check; a NaN reward is no improvement.
    """
    p, c = F.col(prev), F.col(cand)
    at = lambda m, k: nan_to_null(F.try_element_at(m, F.lit(k)))
    peak, lufs, corr = (at(c, k) for k in ("true_peak.true_peak_db", "lufs.integrated_lufs", "stereo.stereo_correlation"))
    delta = nan_to_null(map_reward(c, policy.weights, policy.calib) - map_reward(p, policy.weights, policy.calib))
    worst = F.coalesce(*[F.when(at(c, k) - at(p, k) < -3 * policy.epsilon, F.lit(k)) for k in policy.axes])
    gate = (F.when(peak > policy.true_peak_max_db, "true_peak")
            .when(F.abs(lufs - policy.target_lufs) > policy.lufs_tolerance, "loudness")
            .when(corr < policy.stereo_corr_min, "stereo"))
    out = df.withColumns({"__gate": gate, "__worst": worst, "__d": delta})
    d = F.col("__d")
    decision = (F.when(F.col("__gate").isNotNull(), "rollback").when(F.col("__worst").isNotNull(), "investigate")
                .when(d >= policy.min_delta, "accept").when(d >= -policy.epsilon, "weak").otherwise("rollback"))
    reason = (F.when(F.col("__gate").isNotNull(), F.concat(F.lit("gate:"), "__gate"))
              .when(F.col("__worst").isNotNull(), F.concat(F.lit("regressed:"), "__worst"))
              .when(d >= policy.min_delta, "improved").when(d >= -policy.epsilon, "no_change").otherwise("decreased"))
    return out.withColumns({"decision": decision, "reason": reason,
                            "delta_reward": F.when(F.col("__gate").isNull(), d)}).drop("__gate", "__worst", "__d")


def safety_flags(peak: Column, lufs: Column, corr: Column, policy: Policy = Policy()) -> Column:
    """Reasons of a level row outside the safety limits; silence (no positive peak, no finite loudness) is skipped."""
    peak_db = F.when(peak > 0, 20.0 * F.log10(peak + 1e-12))
    return F.filter(F.array(
        F.when(peak_db > policy.true_peak_max_db, "true_peak"),
        F.when(F.abs(finite(lufs) - policy.target_lufs) > policy.lufs_tolerance, "loudness"),
        F.when(finite(corr) < policy.stereo_corr_min, "stereo_correlation")), lambda r: r.isNotNull())


# --- advice --------------------------------------------------------------------------------------

Scores = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """When ``test(cur, prev)`` holds, suggest ``action`` with ``args`` at ``priority`` (1 first, 9 last)."""

    name: str
    test: Callable[[Scores, Scores], Column]
    action: str
    priority: int
    args: dict[str, float | Column] = field(default_factory=dict)
    target: str | Column | None = None


def _low(key: str, limit: float) -> Callable[[Scores, Scores], Column]:
    return lambda cur, prev: cur(key) < limit


def _high(key: str, limit: float) -> Callable[[Scores, Scores], Column]:
    return lambda cur, prev: cur(key) > limit


def _drop(key: str, by: float) -> Callable[[Scores, Scores], Column]:
    return lambda cur, prev: cur(key) - prev(key) < -by


# Keys the rules look at, per score map; each is read from its map once, into a column of its own.
_KEYS: dict[str, set[str]] = {}


def _get(scores: str):
    def read(key: str) -> Column:
        _KEYS.setdefault(scores, set()).add(key)
        return F.col(f"`__{scores}:{key}`")
    return read


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


_MOS = ("nisqa", "utmos", "dnsmos.ovrl_mos", "singmos")
_AXIS_FREQ = {"PQ": 80.0, "PC": 8000.0, "CE": 2500.0, "CU": 250.0}


def _mos_low(cur: Scores, prev: Scores) -> Column:
    vals = F.filter(F.array(*[cur(k) for k in _MOS]), lambda v: v.isNotNull())
    mean = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / F.size(vals)
    return (F.size(vals) >= 2) & (mean < 2.5)


def _weakest_axis(cur: Scores) -> Column:
    axes = F.filter(F.array(*[F.struct(cur(f"audiobox.{a}").alias("v"), F.lit(i).alias("i"), F.lit(a).alias("a"))
                              for i, a in enumerate(_AXIS_FREQ)]), lambda s: s["v"].isNotNull())
    return F.get(F.array_sort(axes), F.lit(0))["a"]


def _judge(cur: Scores) -> Column:
    plain = cur("qwen2_audio_judge")
    return F.when(plain != 0, plain).otherwise(cur("qwen2_audio_judge.score"))


def default_rules(target_lufs: float = -14.0, cur: str = "cur", stems: str = "stems", sections: str = "sections") -> list[Rule]:
    """The built-in rules in evaluation order."""
    get = _get(cur)
    lufs = get("lufs.integrated_lufs")
    vocal = F.get(F.filter(stems, lambda s: F.contains(F.lower(s), F.lit("vocal"))), F.lit(0))
    weak = _weakest_axis(get)
    freq = F.element_at(F.create_map(*[F.lit(x) for kv in _AXIS_FREQ.items() for x in kv]), weak)
    sec = F.filter(F.map_entries(sections), lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]))
    sec_low = F.get(F.array_sort(F.transform(sec, lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))), F.lit(0))["k"]
    vals = F.transform(sec, lambda e: e["value"])
    peak = get("true_peak.true_peak_db")
    rules = [
        Rule("true_peak", _high("true_peak.true_peak_db", -1.0), "apply_master_limiter", 1,
             {"ceiling_db": F.round(F.least(F.lit(-1.5), peak - 1.0), 2), "release_ms": 100.0}),
        Rule("too_loud", lambda c, p: lufs - target_lufs >= 3.0, "apply_master_limiter", 2,
             {"ceiling_db": -1.0, "release_ms": 100.0}),
        Rule("too_quiet", lambda c, p: lufs - target_lufs <= -3.0, "apply_master_eq", 4, {"freq": 80.0, "gain_db": 1.5, "q": 0.7}),
        Rule("stereo", _low("stereo.stereo_correlation", -0.1), "apply_static_width", 2, {"width": 0.6}, "__widest__"),
    ]
    for axis, f in _AXIS_FREQ.items():
        rules.append(Rule(f"axis_{axis}", _drop(f"audiobox.{axis}", 0.05), "apply_master_eq", 5,
                          {"freq": f, "gain_db": -2.0 if axis == "CU" else 1.5, "q": 0.7}))
    rules += [
        Rule("clap", _low("clap.clap_cosine", 0.85), "rollback", 2, target="best"),
        Rule("mert", _high("mert.mert_distance", 0.3), "rollback", 3, target="best"),
        Rule("vocal_unclear", lambda c, p: vocal.isNotNull() & (c("vocal_intelligibility.intelligibility") < 0.5),
             "apply_static_eq", 4, {"freq": 3000.0, "gain_db": 2.0, "q": 1.0}, vocal),
        Rule("vocal_wer", lambda c, p: vocal.isNotNull() & (c("vocal_intelligibility.wer") > 0.3),
             "apply_static_gain", 4, {"gain_db": 1.5}, vocal),
        Rule("section_spread", lambda c, p: (F.size(sec) >= 2) & (F.array_max(vals) - F.array_min(vals) >= 0.15),
             "apply_section_eq", 5, {"freq": 2500.0, "gain_db": 1.5, "q": 0.7}, sec_low),
        Rule("mos_low", _mos_low, "apply_master_eq", 3, {"freq": 10000.0, "gain_db": 1.5, "q": 0.7}),
        Rule("noise", _low("dnsmos.bak_mos", 3.0), "apply_master_compressor", 4,
             {"threshold_db": -30.0, "ratio": 1.5, "attack_ms": 10.0, "release_ms": 200.0}),
        Rule("scoreq", _low("scoreq", 0.5), "rollback", 3, target="best"),
        Rule("visqol", _drop("visqol_music.moslqo", 0.2), "rollback", 2, target="best"),
        Rule("cdpam", _high("cdpam.cdpam_distance", 0.5), "rollback", 3, target="best"),
        Rule("fad", _high("fad.fad", 5.0), "rollback", 3, target="best"),
        Rule("judge", lambda c, p: (_judge(c) < 5.0) & weak.isNotNull(), "apply_master_eq", 4,
             {"freq": freq, "gain_db": F.when(weak == "CU", -2.0).otherwise(1.5), "q": 0.7}),
        Rule("genre", lambda c, p: c("genre.genre_confidence") < p("genre.genre_confidence") - 0.15, "rollback", 3, target="best"),
        Rule("reseparation", lambda c, p: c("reseparation_sdr.sdr_mean") < p("reseparation_sdr.sdr_mean") - 1.0,
             "rollback", 3, target="best"),
        Rule("lra_narrow", _low("lra.lra", 4.0), "apply_master_compressor", 4,
             {"threshold_db": -18.0, "ratio": 1.2, "attack_ms": 30.0, "release_ms": 300.0}),
        Rule("lra_wide", _high("lra.lra", 15.0), "apply_master_compressor", 5,
             {"threshold_db": -20.0, "ratio": 2.0, "attack_ms": 15.0, "release_ms": 150.0}),
    ]
    return rules + list(_EXTRA)


_EXTRA: list[Rule] = []


def register_rule(rule: Rule) -> None:
    """Append a user rule to the built-in ones."""
    _EXTRA[:] = [r for r in _EXTRA if r.name != rule.name] + [rule]


def advise(df: DataFrame, rules: Sequence[Rule], cur: str = "cur", prev: str = "prev") -> DataFrame:
    """One row per fired rule: entity columns plus seq, rule, action, args, target and priority.

    A row first gets the numbers of the rules that fire. What a rule says is looked up by its number afterwards, so only
    fired rules build arguments, and only arguments that depend on the row are computed at all.
    """
    c, p = _get(cur), _get(prev)
    fired = F.array_compact(F.array(*[F.when(r.test(c, p), F.lit(i)) for i, r in enumerate(rules)]))
    seq = F.col("seq")
    pick = lambda values, kind: F.element_at(F.array(*values).cast(f"array<{kind}>"), seq + 1)  # noqa: E731  a literal

    def args_of(r: Rule) -> Column:
        return F.create_map(*[x for k, v in r.args.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(float(v)))]).cast("map<string,double>")

    def with_rows(fixed: Column, own: dict[int, Column]) -> Column:
        return F.coalesce(*[F.when(seq == i, v) for i, v in own.items()], fixed) if own else fixed

    none = F.create_map().cast("map<string,double>")
    moving = {i for i, r in enumerate(rules) if any(isinstance(v, Column) for v in r.args.values())}
    args = with_rows(pick([none if i in moving else args_of(r) for i, r in enumerate(rules)], "map<string,double>"),
                     {i: args_of(rules[i]) for i in sorted(moving)})
    targets = {i: r.target for i, r in enumerate(rules) if isinstance(r.target, Column)}
    target = with_rows(pick([F.lit(None if i in targets else r.target) for i, r in enumerate(rules)], "string"), targets)
    keep = [x for x in df.columns if x not in (cur, prev, "stems", "sections")]
    flat = {f"__{m}:{k}": finite_or_null(F.try_element_at(F.col(m), F.lit(k))) for m in (cur, prev) for k in sorted(_KEYS.get(m, ()))}
    return df.withColumns(flat).select("*", F.explode(fired).alias("seq")).select(
        *keep, "seq", pick([F.lit(r.name) for r in rules], "string").alias("rule"), pick([F.lit(r.action) for r in rules], "string").alias("action"),
        args.alias("args"), target.alias("target"), pick([F.lit(r.priority) for r in rules], "int").alias("priority"))


# --- rating screens and tiers --------------------------------------------------------------------


def screen_check(ratings: DataFrame, anchor: str, by: Sequence[str] = ("listener", "song", "screen"), tol: float = 1e-9,
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """Per screen: is the anchor above the median of the others, or are the others all (nearly) equal?

    One aggregation; ``extra`` aggregates ride along. The median holds the distinct scores of one screen, and a rating
    scale has few.
    """
    is_anchor = F.col("condition") == anchor
    other = F.when(~is_anchor, F.col("score"))
    out = ratings.groupBy(*by).agg(
        F.max(F.when(is_anchor, F.col("score"))).alias("anchor_score"), F.count_if(~is_anchor).alias("n_others"),
        F.stddev_pop(other).alias("std_others"), F.median(finite(other)).alias("median_others"),
        *[c.alias(n) for n, c in (extra or {}).items()])
    enough = F.col("n_others") >= 2
    fail = (enough & (F.col("anchor_score") > F.col("median_others"))) | (enough & (F.col("std_others") <= tol))
    return out.withColumn("failed", F.coalesce(fail, F.lit(False)))


TIER_THRESHOLDS = {"n_stems_easy_max": 4, "n_stems_hard_min": 5, "dyn_range_db_low": 6.0, "dyn_range_db_high": 12.0,
                   "masking_overlap_db_high": -3.0}


def tier_song(features: DataFrame, th: dict[str, float] = TIER_THRESHOLDS) -> DataFrame:
    """Tier A, B or C with the rule that fired."""
    easy = (F.col("n_stems") <= th["n_stems_easy_max"]) & (F.col("dynamic_range_db") < th["dyn_range_db_low"])
    signs = F.filter(F.array(
        F.when(F.col("n_stems") >= th["n_stems_hard_min"], "n_stems_high"),
        F.when(F.col("dynamic_range_db") >= th["dyn_range_db_high"], "dyn_range_high"),
        F.when(F.col("vocal_present") & (finite("masking_overlap_db") <= th["masking_overlap_db_high"]), "vocal_masked")),
        lambda s: s.isNotNull())
    hard = F.size(signs) >= 2
    return features.withColumns({
        "tier": F.when(easy, "A").when(hard, "C").otherwise("B"),
        "rule_fired": F.when(easy, "n_stems_low_AND_dyn_low").when(hard, F.array_join(signs, "+")).otherwise("default_medium")})
