"""Operators over ordered proposal logs (one row per step of a search).

Running values go through :func:`prefix_scan`, so one very long log is spread over many tasks. A log has a dense
0-based ``step`` per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.scalars import ColumnOrName, col, nan_to_null
from scoreloom.operators.joins import attach
from scoreloom.operators.scan import (ordinal, prefix_scan, previous, range_blocks, running_count, running_last, running_max, running_sum,
                                      step_block)
from scoreloom.session import materialize

BY = ("song",)
STEP = "step"


def _scan(log: DataFrame, by: Sequence[str], **runs) -> DataFrame:
    return prefix_scan(log, by, [F.asc(STEP)], step_block(STEP), runs)


def _newest(by: Sequence[str], order: str | Column = STEP):
    return W.partitionBy(*by).orderBy(F.desc(order) if isinstance(order, str) else order)


def best_so_far(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return _scan(log, by, best=running_max(nan_to_null("reward")))


def replay_acceptance(log: DataFrame, init: ColumnOrName | float, by: Sequence[str] = BY) -> DataFrame:
    """Accepted: strictly better than the start value and every earlier reward; NaN is never accepted."""
    start = F.lit(float(init)) if isinstance(init, (int, float)) else col(init)
    log = _scan(log, by, __m=running_max(nan_to_null("reward"), inclusive=False))
    log = log.withColumn("best_before", F.greatest(start, "__m")).drop("__m")
    return log.withColumn("accepted", F.coalesce(nan_to_null("reward") > F.col("best_before"), F.lit(False)))


def step_delta(replayed: DataFrame) -> DataFrame:
    """Reward minus the best before the step (negative for rejected steps)."""
    return replayed.withColumn("delta", nan_to_null("reward") - F.col("best_before"))


def state_values(replayed: DataFrame, metrics: Sequence[str] = ("pq", "sb"), by: Sequence[str] = BY) -> DataFrame:
    """Metric values of the state in force before each step; null while the start state still holds."""
    runs = {f"state_{m}": running_last(F.when(F.col("accepted"), F.col(m)), inclusive=False) for m in metrics}
    return _scan(replayed, by, **runs)


def budget_curve(replayed: DataFrame, budgets: Sequence[int], init: float, by: Sequence[str] = BY) -> DataFrame:
    """Best reward and accepted count at every budget, all from one log (a budget is a prefix of the log)."""
    reward = nan_to_null("reward")
    aggs = []
    for b in budgets:
        within = F.col(STEP) < b
        aggs += [F.max(F.when(within, reward)).alias(f"__r{b}"),
                 F.count_if(within & F.col("accepted")).alias(f"__n{b}")]
    wide = replayed.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(b).cast("bigint").alias("budget"),
                              F.greatest(F.lit(init), F.col(f"__r{b}")).alias("best"),
                              F.col(f"__n{b}").alias("n_accepted")) for b in budgets])
    return wide.select(*by, F.inline(rows))


def stall_length(replayed: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Rejected steps in a row right before each step."""
    out = _scan(replayed, by, __a=running_last(F.when(F.col("accepted"), F.col(STEP)), inclusive=False))
    return out.withColumn("stall", F.col(STEP) - F.coalesce("__a", F.lit(-1)) - 1).drop("__a")


def stalled_steps(replayed: DataFrame, window: int, by: Sequence[str] = BY) -> DataFrame:
    return stall_length(replayed, by).groupBy(*by).agg(
        F.count_if(F.col("stall") >= window).alias("stall_steps"), F.max("stall").alias("max_stall"))


def switch_point(replayed: DataFrame, fixed: int, stall: int, by: Sequence[str] = BY) -> DataFrame:
    """First step at which the fixed or the stall trigger fires (the fixed one is checked first)."""
    s = stall_length(replayed, by)
    trigger = F.when(F.col(STEP) >= fixed, F.lit(f"fixed_step_{fixed}"))
    if stall > 0:
        trigger = trigger.when(F.col("stall") >= stall, F.lit(f"stall_{stall}"))
    first = F.min(F.when(trigger.isNotNull(), F.struct(F.col(STEP).alias("s"), trigger.alias("t"))))
    return s.groupBy(*by).agg(first.alias("__f")).select(
        *by, F.col("__f.s").alias("switch_step"), F.col("__f.t").alias("trigger"))


def with_epoch(replayed: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Number of acceptances before the step: it names the state the step was proposed from."""
    return _scan(replayed, by, epoch=running_sum(F.col("accepted").cast("bigint"), inclusive=False)).withColumn(
        "epoch", F.coalesce("epoch", F.lit(0).cast("bigint")))


def repeat_in_state(replayed: DataFrame, signature: str = "sig", by: Sequence[str] = BY) -> DataFrame:
    """Was the same proposal already evaluated from the current state?"""
    log = with_epoch(replayed, by)
    key = [*by, "epoch", signature]
    firsts = log.groupBy(*key).agg(F.min(STEP).alias("__first"))
    return attach(log, firsts, key).withColumn("is_repeat", F.col(STEP) > F.col("__first")).drop("__first")


def tool_coverage(log: DataFrame, catalogue: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """Per step the catalogue actions tried before and those still untried (arrays in name order)."""
    names = sorted(catalogue)
    firsts = log.groupBy(*by).agg(*[F.min(F.when(F.col("action") == a, F.col(STEP))).alias(f"__f{i}")
                                    for i, a in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.col(f"__f{i}").alias("f")) for i, a in enumerate(names)])
    out = attach(log, firsts.select(*by, pairs.alias("__p")), by)
    used = lambda p: F.coalesce(p["f"] < F.col(STEP), F.lit(False))
    tried = F.transform(F.filter("__p", lambda p: used(p)), lambda p: p["a"])
    untried = F.transform(F.filter("__p", lambda p: ~used(p)), lambda p: p["a"])
    return out.withColumns({"tried": tried, "untried": untried}).drop("__p")


def recent(replayed: DataFrame, n: int, by: Sequence[str] = BY) -> DataFrame:
    """Last n accepted and last n rejected steps per key; the rank filter is pushed below the shuffle."""
    rn = F.row_number().over(_newest([*by, "accepted"]))
    return replayed.withColumn("recency", rn).where(F.col("recency") <= n)


def diverse_recent(replayed: DataFrame, per: int, n: int, by: Sequence[str] = BY) -> DataFrame:
    """Newest accepted steps, at most ``per`` per action and n overall, with the count left out."""
    acc = replayed.where("accepted")
    kept = (acc.withColumn("__k", F.row_number().over(_newest([*by, "action"]))).where(F.col("__k") <= per)
            .withColumn("__n", F.row_number().over(_newest(by))).where(F.col("__n") <= n).drop("__k", "__n"))
    shown = kept.groupBy(*by).agg(F.count("*").alias("__shown"))
    totals = acc.groupBy(*by).agg(F.count("*").alias("__all")).join(shown, list(by)).select(
        *by, (F.col("__all") - F.col("__shown")).alias("hidden"))
    return attach(kept, totals, by)


def distinct_rejected(replayed: DataFrame, n: int, signature: str = "sig", by: Sequence[str] = BY) -> DataFrame:
    """Rejected proposals with repeat counts; the n whose first appearance is the latest."""
    sigs = replayed.where(~F.col("accepted")).groupBy(*by, signature).agg(
        F.min(STEP).alias("first_step"), F.count("*").alias("n_proposed"))
    return (sigs.withColumn("__r", F.row_number().over(_newest(by, "first_step")))
            .where(F.col("__r") <= n).drop("__r"))


def last_outcome(replayed: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Outcome of the step before: ``accepted`` / ``rejected`` with its action and reward."""
    out = _scan(replayed, by, __p=previous(F.struct("accepted", "action", "reward")))
    p = F.col("__p.v")
    return out.withColumns({
        "last_outcome": F.when(p["accepted"], "accepted").when(~p["accepted"], "rejected"),
        "last_action": p["action"], "last_reward": p["reward"]}).drop("__p")


def forbidden_now(replayed: DataFrame, n: int, signature: str = "sig", by: Sequence[str] = BY) -> DataFrame:
    """The n latest distinct rejected proposals that are still valid for the final state."""
    last = replayed.groupBy(*by).agg(F.max(F.when(F.col("accepted"), F.col(STEP))).alias("__a"))
    live = attach(replayed, last, by).where(F.col(STEP) > F.coalesce("__a", F.lit(-1)))
    sigs = live.groupBy(*by, signature).agg(F.min(STEP).alias("first_step"))
    return (sigs.withColumn("__r", F.row_number().over(_newest(by, "first_step")))
            .where(F.col("__r") <= n).drop("__r"))


def chain_prefix(replayed: DataFrame, n: int, by: Sequence[str] = BY) -> DataFrame:
    """Accepted steps below step n and the values reached there (warm start)."""
    return replayed.where(F.col("accepted") & (F.col(STEP) < n)).groupBy(*by).agg(
        F.count("*").alias("chain_length"), F.max(STEP).alias("last_step"),
        *[F.max_by(m, STEP).alias(m) for m in ("pq", "sb", "reward")])


def progress_snapshots(replayed: DataFrame, every: int, actions: Sequence[str], init: float,
                       by: Sequence[str] = BY) -> DataFrame:
    """Every N steps: accepted so far, best so far and the accepted-action mix."""
    ok = F.col("accepted")
    runs = {"n_accepted": running_sum(ok.cast("bigint"), inclusive=False)}
    for i, a in enumerate(actions):
        runs[f"__m{i}"] = running_sum((ok & (F.col("action") == a)).cast("bigint"), inclusive=False)
    out = _scan(replayed, by, **runs).where(F.col(STEP) % every == 0)
    zero = F.lit(0).cast("bigint")
    mix = F.array(*[F.struct(F.lit(a).alias("action"), F.coalesce(f"__m{i}", zero).alias("n"))
                    for i, a in enumerate(actions)])
    mix = F.filter(mix, lambda m: m["n"] > 0)
    return out.select(*by, STEP, F.coalesce("n_accepted", zero).alias("n_accepted"),
                      F.greatest(F.lit(init), "best_before").alias("best"), mix.alias("mix"))


def best_iteration(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """First arg-max step and its reward."""
    r = nan_to_null("reward")
    top = F.max(F.when(r.isNotNull(), F.struct(r.alias("r"), (-F.col(STEP)).alias("s"))))
    return log.groupBy(*by).agg(top.alias("__t")).select(
        *by, (-F.col("__t.s")).alias("best_step"), F.col("__t.r").alias("best_reward"))


def stop_step(decisions: DataFrame, patience: int, max_iter: int, by: Sequence[str] = BY) -> DataFrame:
    """First iteration after which the search stops: ``patience`` bad decisions in a row, or the maximum."""
    bad = F.col("decision").isin("rollback", "weak")
    d = _scan(decisions, by, __g=running_last(F.when(~bad, F.col(STEP))))
    run = F.col(STEP) - F.coalesce("__g", F.lit(-1))
    reason = F.when(F.col(STEP) >= max_iter, F.lit("max_iterations")).when(run >= patience, F.lit("patience"))
    first = F.min(F.when(reason.isNotNull(), F.struct(F.col(STEP).alias("s"), reason.alias("r"))))
    return d.groupBy(*by).agg(first.alias("__f")).select(
        *by, F.col("__f.s").alias("stop_step"), F.col("__f.r").alias("stop_reason"))


def recovery_rate(decisions: DataFrame, k: int, by: Sequence[str] = BY) -> DataFrame:
    """Rollbacks followed within k rows by an accept of another scope; steps may have gaps.

    Rows are numbered first. Every rollback asks for its k next numbers, so the lookup is an equi join on (key, number):
    no windows over whole logs and no pairs beyond k per rollback.
    """
    decisions = _scan(decisions, by, __n=running_count())
    back = decisions.where(F.col("decision") == "rollback").select(*by, F.col("__n").alias("__at"),
                                                                   F.coalesce("scope", F.lit("")).alias("__scope"))
    asks = back.withColumn("__n", F.explode(F.sequence(F.col("__at") + 1, F.col("__at") + k)))
    accepts = decisions.where(F.col("decision") == "accept").select(
        *by, "__n", F.coalesce("scope", F.lit("")).alias("__other"))
    hits = (asks.join(accepts, [*by, "__n"]).where(F.col("__other") != F.col("__scope"))
            .groupBy(*by).agg(F.count_distinct("__at").alias("n_recovered")))
    totals = back.groupBy(*by).agg(F.count("*").alias("n_rollbacks"))
    out = attach(totals, hits, by).withColumn("n_recovered", F.coalesce("n_recovered", F.lit(0).cast("bigint")))
    return out.withColumn("rec", F.col("n_recovered") / F.col("n_rollbacks"))


def scope_alignment(turns: DataFrame, scopes: DataFrame, aligned: DataFrame, key: str = "turn_id") -> DataFrame:
    """Share of turns whose used scopes hit the declared resolution; turns without countable calls are skipped.

    ``turns``: key, target_resolution, tool_calls array<string>; ``scopes``: name, scope; ``aligned``: resolution,
    scope. Both tables are catalogues of a few dozen rows.
    """
    calls = turns.select(key, "target_resolution", F.explode("tool_calls").alias("name"))
    known = aligned.select(F.col("resolution").alias("target_resolution")).distinct()
    used = (calls.join(F.broadcast(scopes), "name").where(~F.col("scope").isin("perception", "state"))
            .join(F.broadcast(known), "target_resolution", "left_semi"))
    hit = used.join(F.broadcast(aligned.select(F.col("resolution").alias("target_resolution"), "scope",
                                               F.lit(True).alias("__hit"))), ["target_resolution", "scope"], "left")
    per_turn = hit.groupBy(key).agg(F.max(F.coalesce("__hit", F.lit(False))).alias("__ok"))
    return per_turn.agg(F.count_if("__ok").alias("aligned"), F.count("*").alias("counted")).withColumn(
        "sra", F.when(F.col("counted") > 0, F.col("aligned") / F.col("counted")))


def section_diagnoses(turns: DataFrame) -> DataFrame:
    """Section-targeted turns, all turns and their rate."""
    real = (F.size(F.coalesce("tool_calls", F.array().cast("array<string>"))) > 0) | F.col("target_resolution").isNotNull()
    section = F.coalesce(F.col("target_resolution") == "section", F.lit(False)) | F.coalesce(
        F.lower("target_scope").rlike("verse|chorus|bridge|intro|outro|section"), F.lit(False))
    out = turns.where(real).agg(F.count_if(section).alias("dps"), F.count("*").alias("n_turns"))
    return out.withColumn("dps_rate", F.when(F.col("n_turns") > 0, F.col("dps") / F.col("n_turns")).otherwise(0.0))


def budget_breach(costs: DataFrame, run_cap: float, total_cap: float, order: Sequence[str],
                  block: Column | Sequence[Column], run: str = "run", usd: str = "usd") -> DataFrame:
    """Running spend per run and in total on every cost row, with the cap that row exceeds."""
    asc = [F.asc(o) for o in order]
    out = prefix_scan(costs, [run], asc, block, {"spent_run": running_sum(usd)})
    out = prefix_scan(out, [], asc, block, {"spent_total": running_sum(usd)})
    over = F.when(F.col("spent_run") > run_cap, F.lit("per_run")).when(F.col("spent_total") > total_cap, F.lit("total"))
    return out.withColumn("breach", over)


def first_breach(spend: DataFrame, order: Sequence[str], run: str = "run") -> DataFrame:
    """First row over a cap per run."""
    at = F.struct(*[F.col(o) for o in order], "breach", "spent_run", "spent_total")
    return (spend.where(F.col("breach").isNotNull()).groupBy(run).agg(F.min(at).alias("__m"))
            .select(run, *[F.col(f"__m.{o}").alias(o) for o in order], "__m.breach", "__m.spent_run", "__m.spent_total"))


def spend_by_source(costs: DataFrame, source: str = "source", usd: str = "usd") -> DataFrame:
    return costs.groupBy(source).agg(F.sum(usd).alias("spent"))


def song_index(plan: DataFrame, split_rank: Column, song: str, block: Column) -> DataFrame:
    """Stable 0-based index over the whole plan: split order first, then song order."""
    ranked = plan.withColumn("split_rank", split_rank)
    out = ordinal(ranked, [], [F.asc("split_rank"), F.asc(song)], [F.col("split_rank"), block], "song_index")
    return out.withColumn("song_index", F.col("song_index") - 1)


def plan_chunk(indexed: DataFrame, offset: int, limit: int | None) -> DataFrame:
    out = indexed.where(F.col("song_index") >= offset)
    return out if limit is None else out.where(F.col("song_index") < offset + limit)


def select_songs(plan: DataFrame, split: str, tiers: DataFrame | None, limit: int, song: str = "song") -> DataFrame:
    """First ``limit`` songs of a split in song order, optionally only those with a tier row."""
    out = plan.where(F.col("split") == split)
    if tiers is not None:
        out = out.join(tiers.select(song).distinct(), song, "left_semi")
    return out.orderBy(song).limit(limit)


def dedupe_last(df: DataFrame, key: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Last record per key in arrival order; an aggregate, so resends are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*seq)) if rest else None
    if best is None:
        return df.select(*key).distinct()
    out = df.groupBy(*key).agg(best.alias("__r"))
    return out.select(*[F.col(c) if c in key else F.col(f"__r.{c}").alias(c) for c in df.columns])


def dedupe_counts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Records, distinct keys and dropped resends."""
    return df.groupBy(*key).agg(F.count("*").alias("__n")).agg(
        F.sum("__n").alias("n_records"), F.count("*").alias("n_unique"),
        (F.sum("__n") - F.count("*")).alias("n_dropped"))


def dedupe_first(df: DataFrame, ident: str, seq: Sequence[str]) -> DataFrame:
    """First row per id; rows with a blank id are all kept and flagged."""
    blank = F.coalesce(F.trim(F.col(ident).cast("string")), F.lit("")) == ""
    rest = [c for c in df.columns if c != ident]
    firsts = df.where(~blank).groupBy(ident).agg(F.min_by(F.struct(*rest), F.struct(*seq)).alias("__r"))
    firsts = firsts.select(*[F.col(c) if c == ident else F.col(f"__r.{c}").alias(c) for c in df.columns])
    return firsts.withColumn("blank_id", F.lit(False)).unionByName(df.where(blank).withColumn("blank_id", F.lit(True)))


def center_within(df: DataFrame, value: str, by: Sequence[str], name: str = "centered") -> DataFrame:
    """Value minus its mean within the group; null becomes 0."""
    means = df.groupBy(*by).agg(F.avg(value).alias("__mean"))
    return attach(df, means, by).withColumn(
        name, F.coalesce(F.col(value) - F.col("__mean"), F.lit(0.0))).drop("__mean")


def top_suggestions(advice: DataFrame, n: int, by: Sequence[str] = BY) -> DataFrame:
    """First n suggestions per entity by priority; equal priorities keep their rule order."""
    w = W.partitionBy(*by).orderBy("priority", "seq")
    return advice.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def rank_no_ties(df: DataFrame, by: Sequence[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """0-based order rank without averaging; equal values are ranked by ``tie``.

    Rows are numbered within ranges of (by, value, tie) and the counts of earlier ranges are added, so neither a hot key
    nor a table without keys ends up in one task.
    """
    order = [F.asc(value), F.asc(tie)]
    out = ordinal(range_blocks(df, by, order), by, order, F.col("__range"), name)
    return out.withColumn(name, F.col(name) - 1).drop("__range")
