"""Group summaries: ratings, logs, answers, levels, calibrated chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions import tables as TB
from scoreloom.functions.scalars import clip_gain, finite, is_vocal
from scoreloom.operators.joins import attach, pair_all_arms
from scoreloom.operators.quantiles import exact_median, exact_percentiles
from scoreloom.session import materialize


def sdr_db(df: DataFrame, by: Sequence[str], ref: str, est: str, eps: float = 1e-12) -> DataFrame:
    r, e = F.col(ref), F.col(ref) - F.col(est)
    return df.groupBy(*by).agg((10 * F.log10((F.sum(r * r) + eps) / (F.sum(e * e) + eps))).alias("sdr"))


def stat_block(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
                               F.sum(value).alias("total"), F.count(value).alias("n"))


def system_summary(ratings: DataFrame, system: str = "condition", value: str = "score") -> DataFrame:
    out = ratings.groupBy(system).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.withColumn("ci95_half", 1.96 * F.col("std") / F.sqrt(F.col("n")))


def condition_means(ratings: DataFrame) -> DataFrame:
    """Mean, sd, median and count over the listener means of each condition."""
    cells = ratings.groupBy("listener", "condition").agg(F.avg("score").alias("m"))
    out = cells.groupBy("condition").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("*").alias("n"))
    return attach(out, exact_median(cells, ["condition"], "m"), ["condition"])


def win_rate_matrix(pairs: DataFrame) -> DataFrame:
    """Wins and shown counts of each ordered pair; a tie counts only in the denominator."""
    sides = F.array(F.struct(F.col("a").alias("system"), F.col("b").alias("opponent")),
                    F.struct(F.col("b").alias("system"), F.col("a").alias("opponent")))
    both = pairs.where(F.col("a") != F.col("b")).select(F.explode(sides).alias("s"), "preferred").select("s.*", "preferred")
    won = F.coalesce(F.col("preferred") == F.col("system"), F.lit(False))
    out = both.groupBy("system", "opponent").agg(F.count_if(won).alias("wins"), F.count("*").alias("shown"))
    return out.withColumn("win_rate", F.col("wins") / F.col("shown"))


def win_rate_wide(matrix: DataFrame, systems: Sequence[str]) -> DataFrame:
    return matrix.groupBy("system").pivot("opponent", list(systems)).agg(F.first("win_rate"))


def rough_alpha(ratings: DataFrame, unit: Sequence[str], value: str = "score") -> DataFrame:
    """1 - observed / expected disagreement over all value pairs of a unit, from moments (no pairs are built)."""
    x = F.col(value)
    units = ratings.groupBy(*unit).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(x * x).alias("q"))
    pooled = units.agg(F.sum(F.col("n") * F.col("q") - F.col("s") * F.col("s")).alias("d"),
                       F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    spread = ratings.agg(F.var_pop(value).alias("v"), F.count(value).alias("n"))
    # Both sides are one-row aggregates.
    obs = F.when(F.col("pairs") > 0, F.col("d") / F.col("pairs")).otherwise(0.0)
    return pooled.join(F.broadcast(spread), F.lit(True)).select(
        F.when(F.col("n") >= 2, 1.0 - obs / (2 * F.col("v") + 1e-9)).alias("alpha"))


def proposal_funnel(log: DataFrame, by: Sequence[str] = ("action",)) -> DataFrame:
    """Counts per outcome (``status``: accepted, rejected, invalid, gated) and the accepted share of the evaluated."""
    s = F.col("status")
    out = log.groupBy(*by).agg(F.count("*").alias("proposed"), *[F.count_if(s == k).alias(k) for k in
                                                                ("accepted", "rejected", "invalid", "gated")])
    evaluated = F.col("accepted") + F.col("rejected")
    return out.withColumn("acceptance_rate", F.when(evaluated > 0, F.col("accepted") / evaluated))


def accepted_by_kind(replayed: DataFrame, by: Sequence[str] = ("song",), track: str = "track") -> DataFrame:
    """Accepted steps per action: count, tracks in first-seen order, summed gain, position by first appearance."""
    acc = replayed.where("accepted").withColumn("delta", F.col("reward") - F.col("best_before"))
    per = acc.groupBy(*by, "action", track).agg(F.min("step").alias("f"), F.count("*").alias("n"), F.sum("delta").alias("d"))
    seen = F.array_sort(F.collect_list(F.when(F.coalesce(F.col(track), F.lit("")) != "", F.struct("f", F.col(track).alias("t")))))
    out = per.groupBy(*by, "action").agg(F.sum("n").alias("n"), F.sum("d").alias("gain"), F.min("f").alias("first_step"),
                                         F.transform(seen, lambda s: s["t"]).alias("tracks"))
    # One row per catalogue action of a key is left here, so the window is tiny.
    return out.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy("first_step")))


def call_summary(calls: DataFrame, by: Sequence[str] = ("run", "song")) -> DataFrame:
    s = F.col("status")
    return calls.groupBy(*by).agg(
        F.count_if(s == "ok").alias("ok"), F.count_if(s == "invalid").alias("invalid"), F.count_if(s == "gated").alias("gated"),
        F.count_if(s == "empty").alias("empty"), F.count("*").alias("calls"), F.avg("latency").alias("mean_latency"),
        (F.count("*") - F.count_if(s == "ok")).alias("reasks"))


def value_histogram(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Counts per value as a map in value order (values are categories, not free text)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value).alias("key"), F.col("__c").alias("value"))))
    return counts.groupBy(*by).agg(F.map_from_entries(pairs).alias("histogram"))


def seed_mean(runs: DataFrame, expected: int, by: Sequence[str] = ("run", "song"), seed: str = "seed_idx",
              metrics: Sequence[str] = ("pq", "sb"), on_mismatch: str = "raise") -> DataFrame:
    """Mean over seeds per song; a song with another seed count fails the query (or is flagged)."""
    out = runs.groupBy(*by).agg(F.count_distinct(seed).alias("n_seeds"), *[F.avg(m).alias(m) for m in metrics])
    good = F.col("n_seeds") == expected
    if on_mismatch == "flag":
        return out.withColumn("complete", good)
    text = F.concat(F.lit(f"expected {expected} seeds, found "), F.col("n_seeds").cast("string"))
    # The check rides on a metric column so that column pruning cannot remove it.
    guarded = F.when(good, F.col(metrics[0])).otherwise(F.raise_error(text).cast("double"))
    return out.withColumn(metrics[0], guarded)


def song_set_digest(df: DataFrame, ident: str) -> DataFrame:
    """12 hex digits that name a set of ids: of the sha-256 over the sorted ids, one a line.

    A sha-256 is sequential by definition. The distinct ids are sorted by Spark (which spills) and one task feeds them to
    the hash batch by batch, so memory does not grow with the set.
    """
    ids = df.select(F.col(ident).cast("string").alias("i")).where(F.col("i").isNotNull()).distinct()
    out = ids.repartition(1).sortWithinPartitions("i").mapInArrow(_digest, "n bigint, digest string")
    return out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("digest").alias("digest"))  # a row for an empty set, too


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, n = hashlib.sha256(), 0
    for batch in batches:
        for ident in batch.column("i").to_pylist():
            state.update(("\n" if n else "").encode() + ident.encode())
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([state.hexdigest()[:12] if n else None], pa.string())], ["n", "digest"])



def weighted_reward(scores: DataFrame, by: Sequence[str], weights: dict[str, float] | None = None,
                    calib: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Weighted mean of (calibrated) scores per entity over finite keys; 0 when no weighted key is present."""
    weights = TB.REWARD_WEIGHTS if weights is None else weights
    calib = TB.REWARD_CALIBRATION if calib is None else calib
    v = finite("value")
    w, z = None, None
    for key, weight in weights.items():
        if weight == 0:
            continue
        mean, std = calib.get(key, (0.0, 0.0))
        zk = (v - mean) / std if std > 1e-9 else v
        hit = F.col("key") == key
        w = F.when(hit, F.lit(float(weight))) if w is None else w.when(hit, F.lit(float(weight)))
        z = F.when(hit, zk) if z is None else z.when(hit, zk)
    used = v.isNotNull()
    total = F.sum(F.when(used, w * z))
    mass = F.sum(F.when(used, F.abs(w)))
    return scores.groupBy(*by).agg(F.when(mass > 0, total / mass).otherwise(0.0).alias("reward"))


def relative_levels(energies: DataFrame, by: Sequence[str], role: str, energy: str) -> DataFrame:
    """Level of each role relative to the whole, in dB."""
    roles = energies.groupBy(*by, role).agg(F.sum(energy).alias("__e"))
    whole = roles.groupBy(*by).agg(F.sum("__e").alias("__t"))
    return attach(roles, whole, by).select(
        *by, role, (10 * F.log10(F.greatest(F.col("__e"), F.lit(1e-14)) / F.greatest(F.col("__t"), F.lit(1e-14))))
        .alias("relative_db"))


def match_profile(levels: DataFrame, target: DataFrame, role: str = "role", clip: float = 12.0) -> DataFrame:
    """Gain that brings each track's relative level to the target of its role; roles without a target drop out."""
    j = levels.join(target.select(role, F.col("relative_db").alias("__target")), role)
    gain = F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("__target") - F.col("relative_db")))
    return j.withColumn("gain_db", F.round(gain, 2)).drop("__target")


def resolution_rollup(frames: DataFrame, by: Sequence[str], section: str, window: str, frame: str, value: str) -> DataFrame:
    """One score at song, section, window and frame grain in one grouping-sets pass."""
    keys = list(by)
    sets = [[F.col(k) for k in keys], *[[*[F.col(k) for k in keys], F.col(x)] for x in (section, window, frame)]]
    out = frames.groupingSets(sets, *keys, section, window, frame).agg(
        F.grouping_id().alias("__g"), F.avg(value).alias("score"), F.count("*").alias("n"))
    name = {0b111: "global", 0b011: "section", 0b101: "short_term", 0b110: "momentary"}
    res = F.create_map(*[F.lit(x) for kv in name.items() for x in kv])
    unit = F.coalesce(F.col(section).cast("string"), F.col(window).cast("string"), F.col(frame).cast("string"), F.lit(""))
    return out.select(*keys, F.element_at(res, F.col("__g").cast("int")).alias("resolution"), unit.alias("unit"), "score", "n")


def trajectory_summary(series: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Mean, std, last minus first and p95 - p10 over the finite values; an empty series gives null and zeros."""
    v = finite(value)
    out = series.withColumn("__v", v).groupBy(*by).agg(
        F.avg("__v").alias("mean"), F.coalesce(F.stddev_pop("__v"), F.lit(0.0)).alias("std"),
        F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias("__last"),
        F.min_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias("__first"))
    spread = exact_percentiles(series, by, value, {"__p95": 0.95, "__p10": 0.10})
    return attach(out, spread, by).select(
        *by, "mean", "std", F.coalesce(F.col("__last") - F.col("__first"), F.lit(0.0)).alias("drift"),
        F.coalesce(F.col("__p95") - F.col("__p10"), F.lit(0.0)).alias("spread"))


def dynamic_range(frames: DataFrame, by: Sequence[str], stem: str, level: str, floor: float = -50.0) -> DataFrame:
    """p95 - p10 of the levels above the silence floor per stem (two or more), averaged per song; else 0."""
    loud = frames.where(finite(level) > floor)
    counts = loud.groupBy(*by, stem).agg(F.count("*").alias("__n"))
    q = exact_percentiles(loud, [*by, stem], level, {"__hi": 0.95, "__lo": 0.10})
    per = attach(q, counts, [*by, stem]).where(F.col("__n") >= 2)
    mean = per.groupBy(*by).agg(F.avg(F.col("__hi") - F.col("__lo")).alias("__dr"))
    return attach(frames.select(*by).distinct(), mean, by).select(
        *by, F.coalesce("__dr", F.lit(0.0)).alias("dynamic_range_db"))


def band_overlap(bands: DataFrame, by: Sequence[str], level: str, vocal: str | Column) -> DataFrame:
    """Strongest vocal-band level minus the strongest other one; null when a side is absent."""
    v = F.col(vocal) if isinstance(vocal, str) else vocal
    return bands.groupBy(*by).agg((F.max(F.when(v, F.col(level))) - F.max(F.when(~v, F.col(level)))).alias("masking_overlap_db"))


def tier_features(frames: DataFrame, by: Sequence[str], stem: str, at: str, level: str, band: str,
                  instrument: str | None = None, full_band_floor: float = -30.0) -> DataFrame:
    """Stem count, duration, dynamic range, vocal flag, masking difference and non-silent stems per song."""
    vocal = is_vocal(stem, instrument)
    per_stem = frames.groupBy(*by, stem).agg(
        F.max(vocal.cast("int")).alias("__voc"), F.max(at).alias("__end"), F.max(band).alias("__band"),
        F.sum(F.pow(F.lit(10.0), F.col(level) / 10)).alias("__e"))
    feats = per_stem.groupBy(*by).agg(
        F.count("*").alias("n_stems"), F.max("__end").alias("duration_sec"), (F.max("__voc") == 1).alias("vocal_present"),
        (F.max(F.when(F.col("__voc") == 1, F.col("__band"))) - F.max(F.when(F.col("__voc") == 0, F.col("__band"))))
        .alias("masking_overlap_db"),
        F.count_if(10 * F.log10(F.col("__e") + 1e-12) > full_band_floor).alias("n_full_band_stems"))
    return attach(feats, dynamic_range(frames, by, stem, level), by)


def axis_fit(chain: DataFrame, by: Sequence[str], axis: str, value: str = "reward") -> DataFrame:
    """Hidden (mu, sigma) of ``reward = (axis - mu) / sigma`` by least squares with the largest residual.

    No spread, a slope that is not positive or fewer than two points give nulls.
    """
    x, y = F.col(axis), F.col(value)
    both = x.isNotNull() & y.isNotNull()
    fit = chain.where(both).groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_sxx(y, x).alias("__sxx"), F.regr_slope(y, x).alias("__slope"),
        F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    ok = (F.col("__sxx") >= 1e-12) & (F.col("__slope") > 0) & (F.col("n") >= 2)
    fit = fit.withColumn("sigma", F.when(ok, 1.0 / F.col("__slope")))
    fit = fit.withColumn("mu", F.col("__mx") - F.col("__my") * F.col("sigma")).select(*by, "n", "mu", "sigma")
    res = attach(chain.where(both), fit, by).groupBy(*by).agg(
        F.max(F.abs((x - F.col("mu")) / F.col("sigma") - y)).alias("max_resid"))
    return attach(fit, res, by)


def z_delta(chains: DataFrame, inits: DataFrame, arms: Sequence[str], key: Sequence[str] = ("song", "seed_idx"),
            max_resid: float = 0.05, check_tol: float = 0.1, check_steps: int = 10) -> DataFrame:
    """Change over the search per arm in calibrated units.

    ``chains``: arm, key, step, pq, sb, reward of accepted steps; ``inits``: arm, key, init_reward. The scale of
    each axis is recovered from the single-axis arms; cells whose fit or whose min-arm check (of the first ``check_steps``
    accepted entries) fails are left out.
    """
    key = list(key)
    chains, inits = materialize(chains, "chains"), materialize(inits, "inits")
    cells = pair_all_arms(inits, list(arms), key, "arm")
    fp = axis_fit(chains.where(F.col("arm") == "pq_only"), key, "pq").select(
        *key, F.col("mu").alias("mu_p"), F.col("sigma").alias("sg_p"), F.col("max_resid").alias("__rp"))
    fs = axis_fit(chains.where(F.col("arm") == "sb_only"), key, "sb").select(
        *key, F.col("mu").alias("mu_s"), F.col("sigma").alias("sg_s"), F.col("max_resid").alias("__rs"))
    fits = fp.join(fs, key).where((F.col("__rp") <= max_resid) & (F.col("__rs") <= max_resid)).drop("__rp", "__rs")
    place = F.row_number().over(W.partitionBy(*key).orderBy("step"))  # Spark keeps the first few before it shuffles
    low = chains.where(F.col("arm") == "min").withColumn("__place", place).where(F.col("__place") <= check_steps).join(fits, key)
    z = F.least((F.col("pq") - F.col("mu_p")) / F.col("sg_p"), (F.col("sb") - F.col("mu_s")) / F.col("sg_s"))
    broken = low.where(F.abs(z - F.col("reward")) > check_tol).select(*key)
    fits = materialize(fits.join(broken, key, "left_anti"), "fits")
    init = cells.where(F.col("arm") == "pq_only").select(*key, F.col("init_reward").alias("__ip")).join(
        cells.where(F.col("arm") == "sb_only").select(*key, F.col("init_reward").alias("__is")), key)
    base = fits.join(init, key).withColumns({
        "pq0": F.col("mu_p") + F.col("sg_p") * F.col("__ip"), "sb0": F.col("mu_s") + F.col("sg_s") * F.col("__is")})
    last = chains.groupBy("arm", *key).agg(F.max_by(F.struct("pq", "sb"), "step").alias("__l"))
    rows = cells.select("arm", *key).join(base, key).join(last, ["arm", *key], "left")
    d_pq = F.coalesce(F.col("__l.pq"), F.col("pq0")) - F.col("pq0")
    d_sb = F.coalesce(F.col("__l.sb"), F.col("sb0")) - F.col("sb0")
    return rows.select("arm", *key, (d_pq / F.col("sg_p")).alias("dz_pq"), (d_sb / F.col("sg_s")).alias("dz_sb"),
                       d_pq.alias("d_pq_raw"), d_sb.alias("d_sb_raw"))


def z_delta_summary(rows: DataFrame) -> DataFrame:
    """Means per arm; for the single-axis arms also loss over gain and the share of cells that lose more than they gain."""
    opt = F.when(F.col("arm") == "pq_only", F.col("dz_pq")).when(F.col("arm") == "sb_only", F.col("dz_sb"))
    unm = F.when(F.col("arm") == "pq_only", F.col("dz_sb")).when(F.col("arm") == "sb_only", F.col("dz_pq"))
    out = rows.groupBy("arm").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("dz_pq", "dz_sb", "d_pq_raw", "d_sb_raw")],
        F.avg(opt).alias("__gain"), F.avg(unm).alias("__loss"), F.avg((-unm >= opt).cast("int")).alias("frac_loss_ge_gain"))
    return out.withColumn("loss_over_gain", -F.col("__loss") / F.col("__gain")).drop("__gain", "__loss")


def determinism_spread(df: DataFrame, by: Sequence[str], run: str, value: str) -> DataFrame:
    """Max minus min of a quantity measured in at least two runs."""
    out = df.groupBy(*by).agg(F.count_distinct(run).alias("n_runs"), (F.max(value) - F.min(value)).alias("spread"))
    return out.where(F.col("n_runs") >= 2)


def tally_flow(records: DataFrame, analysed: DataFrame) -> DataFrame:
    """Participant flow without any rating: started, questionnaires, completion codes, analysed."""
    rows = records.groupBy().agg(
        F.count_distinct("pid").alias("n_started"),
        F.count_distinct(F.when(F.col("type") == "screen_q", F.col("pid"))).alias("n_questionnaire"))
    n = analysed.agg(F.count_distinct("pid").alias("n_analysed"))
    head = rows.join(F.broadcast(n), F.lit(True)).select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("item"), F.col(k).alias("n")) for k in ("n_started", "n_questionnaire", "n_analysed")])))
    codes = records.where(F.col("code").isNotNull()).groupBy(F.concat(F.lit("code:"), "code").alias("item")).agg(
        F.count("*").alias("n"))
    return head.unionByName(codes)


def equal_level(levels: DataFrame, level: str, value: str, target: float, silence: float = -70.0) -> DataFrame:
    from scoreloom.functions.scalars import equal_level_gain
    gain = equal_level_gain(level, target, silence)
    return levels.withColumns({"gain": gain, value: F.col(value) * gain})


def pyramid_gain(levels: DataFrame, role: str = "role", level: str = "level") -> DataFrame:
    """Gain of each track towards the level target of its role."""
    target = F.create_map(*[F.lit(x) for kv in TB.LEVEL_TARGETS.items() for x in kv])
    return levels.withColumn("gain_db", clip_gain(F.coalesce(F.element_at(target, F.col(role)), F.lit(-20.0)), level))
