"""Frame series: windows, sections, presence, excerpts, boundaries.

``song`` may be one item that holds a large share of all frames, so nothing here gathers the frames of a song in
one task except where the result itself is a short per-song list (section boundaries).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.scalars import rms_db
from scoreloom.operators.joins import attach
from scoreloom.operators.quantiles import exact_percentiles
from scoreloom.operators.scan import BLOCK_ROWS, prefix_scan, previous, running_count, running_sum
from scoreloom.session import materialize


def section_windows(bounds: DataFrame, ends: DataFrame, by: Sequence[str], whole: str = "whole") -> DataFrame:
    """Adjacent boundaries to half-open [start, end) windows; an item without boundaries is one window.

    ``ends`` has one row per item with ``end_sec``.
    """
    width = 86400.0
    nxt = prefix_scan(bounds, by, [F.desc("start_sec"), F.desc("label")],
                      F.floor(F.col("start_sec") / width).cast("bigint"), {"__n": previous("start_sec")}, backwards=True)
    out = attach(ends, bounds.groupBy(*by).agg(F.count("*").alias("__c")), by)
    some = nxt.join(out.where(F.col("__c") > 0).drop("__c"), list(by))
    rows = some.withColumn("__e", F.coalesce(F.col("__n.v"), F.col("end_sec"))).where(F.col("__e") > F.col("start_sec")).select(
        *by, F.col("start_sec").cast("double").alias("start_sec"), F.col("__e").cast("double").alias("end_sec"), "label")
    none = out.where(F.col("__c").isNull()).select(*by, F.lit(0.0).alias("start_sec"), F.col("end_sec").cast("double"),
                                                   F.lit(whole).alias("label"))
    return rows.unionByName(none)


def frame_rms(samples: DataFrame, by: Sequence[str], index: str, value: str, win: int, hop: int) -> DataFrame:
    """Energy in dB over overlapping frames of ``win`` samples every ``hop``; partial frames at the end are left out.

    When win is a multiple of hop the samples are summed per hop first, so each row is shuffled once, not win/hop times.
    """
    x2 = F.col(value) * F.col(value)
    # Runs of gcd(win, hop) samples share their frames.
    unit = math.gcd(win, hop)
    per_unit = samples.groupBy(*by, F.floor(F.col(index) / unit).cast("bigint").alias("__u")).agg(
        F.sum(x2).alias("__s"), F.count("*").alias("__c"))
    first = F.ceil((F.col("__u") * unit + unit - win) / hop)
    last = F.floor(F.col("__u") * unit / hop)
    frames = per_unit.where(last >= F.greatest(first, F.lit(0))).withColumn(
        "frame_idx", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("bigint"), last.cast("bigint"))))
    out = frames.groupBy(*by, "frame_idx").agg(F.sum("__s").alias("__s"), F.sum("__c").alias("__c"))
    return out.where(F.col("__c") == win).select(*by, "frame_idx", rms_db(F.col("__s") / win).alias("rms_db"))


def sliding_windows(items: DataFrame, win: float, hop: float, duration: str = "duration_sec", shortest: float = 0.5) -> DataFrame:
    """Windows [start, end) of every item; one whole window when the item is shorter than a window."""
    d = F.col(duration)
    last = F.floor((d + 1e-6 - win) / hop)
    starts = F.when(last >= 0, F.transform(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), lambda i: F.struct(
        i.alias("win_idx"), (i * hop).alias("start_sec"), (i * hop + win).alias("end_sec"))))
    short = F.when(d > shortest, F.array(F.struct(F.lit(0).cast("bigint").alias("win_idx"), F.lit(0.0).alias("start_sec"), d.alias("end_sec"))))
    keep = [c for c in items.columns if c not in ("start_sec", "end_sec", "win_idx")]
    return items.select(*keep, F.inline(F.coalesce(starts, short)))


def window_membership(frames: DataFrame, at: str, win: float, hop: float) -> DataFrame:
    """Repeat each frame for the windows [i·hop, i·hop + win) that contain it (at most win / hop + 1 rows)."""
    t = F.col(at)
    first = F.greatest(F.floor((t - win) / hop) + 1, F.lit(0))
    return frames.withColumn("win_idx", F.explode(F.sequence(first.cast("bigint"), F.floor(t / hop).cast("bigint"))))


def short_term_levels(frames: DataFrame, by: Sequence[str], at: str, energy: str, win: float, hop: float,
                      shortest: float = 1.0) -> DataFrame:
    """Level in dB of each full sliding window; items shorter than ``shortest`` give none.

    Frames are summed per hop first; only these partial sums are repeated for the overlapping windows.
    """
    if abs(win / hop - round(win / hop)) < 1e-9:
        steps = int(round(win / hop))
        part = frames.groupBy(*by, F.floor(F.col(at) / hop).cast("bigint").alias("__h")).agg(
            F.sum(energy).alias("__s"), F.count("*").alias("__c"), F.max(at).alias("__t"))
        spread = part.withColumn("win_idx", F.explode(F.sequence(F.greatest(F.col("__h") - (steps - 1), F.lit(0).cast("bigint")), F.col("__h"))))
        out = spread.groupBy(*by, "win_idx").agg(F.sum("__s").alias("__s"), F.sum("__c").alias("n"))
    else:
        out = window_membership(frames, at, win, hop).groupBy(*by, "win_idx").agg(F.sum(energy).alias("__s"), F.count("*").alias("n"))
    ends = frames.groupBy(*by).agg(F.max(at).alias("__end"))
    out = out.join(ends, list(by)).where((F.col("__end") >= shortest) & (F.col("win_idx") * hop + win <= F.col("__end") + 1e-9))
    return out.select(*by, "win_idx", "n", (10 * F.log10(F.col("__s") / F.col("n") + 1e-12)).alias("level_db"))


def moving_mean_std(frames: DataFrame, by: Sequence[str], index: str, value: str, n: int) -> DataFrame:
    """Mean and population std over the n frames from each frame on; starts without n frames are dropped.

    Prefix sums within blocks: the cost does not grow with n, and each block (plus its n-1 following frames) is a task.
    """
    block = max(BLOCK_ROWS, n)
    b = F.floor(F.col(index) / block).cast("bigint")
    mine = frames.select(*by, F.col(index).alias("__i"), F.col(value).cast("double").alias("__x"), b.alias("__b"), F.lit(True).alias("__own"))
    # The first n-1 frames of a block also belong to the tail of the block before.
    tail = mine.where((F.col("__i") % block < n - 1) & (F.col("__b") > 0)).withColumns({"__b": F.col("__b") - 1, "__own": F.lit(False)})
    both = mine.unionByName(tail)
    w = W.partitionBy(*by, "__b").orderBy("__i")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumns({"__s": F.sum("__x").over(upto), "__q": F.sum(F.col("__x") * F.col("__x")).over(upto)})
    ahead = lambda c: F.lead(c, n - 1).over(w)
    out = both.withColumns({"__ei": ahead("__i"), "__es": ahead("__s"), "__eq": ahead("__q")})
    mean = (F.col("__es") - F.col("__s") + F.col("__x")) / n
    square = (F.col("__eq") - F.col("__q") + F.col("__x") * F.col("__x")) / n
    out = out.where(F.col("__own") & (F.col("__ei") == F.col("__i") + n - 1))
    return out.select(*by, F.col("__i").alias(index), mean.alias("mean"),
                      F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))


def stem_presence(frames: DataFrame, by: Sequence[str], level: str = "rms_db") -> DataFrame:
    """Level of each frame relative to its stem's own p95, capped at 0."""
    p95 = exact_percentiles(frames, by, level, {"__p95": 0.95})
    return attach(frames, p95, by).withColumn("presence_db", F.least(F.col(level) - F.col("__p95"), F.lit(0.0))).drop("__p95")


def best_excerpt(frames: DataFrame, stems: Sequence[str], length: float, hop: float = 0.25, head: float = 0.15, tail: float = 0.12,
                 lam: float = 0.25, floor_db: float = -18.0, max_end: float | None = 240.0, song: str = "song") -> DataFrame:
    """Start of the best excerpt per song.

    ``frames``: song, stem, frame_idx, rms_db, with the whole mix as stem ``mixture``. Score of a start: the weakest
    stem's mean presence minus ``lam`` times the spread of the mix level, over an allowed range of starts; the first
    maximum wins. Songs that lack a stem, are too short, have no allowed start or too little activity get a reason.
    """
    names = [*stems, "mixture"]
    w_fr = _half_even(length / hop)
    seen = frames.where(F.col("stem").isin(*names))
    counts = seen.groupBy(song, "stem").agg(F.count("*").alias("__n"))
    per_song = counts.groupBy(song).agg(F.min("__n").alias("n_frames"), F.collect_set("stem").alias("__have"),
                                        F.max(F.when(F.col("stem") == "mixture", F.col("__n"))).alias("__mix_n"))
    lacking = F.coalesce(*[F.when(~F.array_contains("__have", s), F.lit(f"missing_stem_{s}")) for s in names])
    n = F.col("n_frames")
    lo0, span = F.bround(head * n).cast("bigint"), F.bround((1.0 - tail) * n).cast("bigint") - w_fr
    capped = max_end is not None and max_end > length
    cap = F.lit(math.floor((max_end - length) / hop)).cast("bigint") if capped else None
    hi0 = F.least(span, cap) if capped else span
    free = F.least(n - w_fr, cap) if capped else n - w_fr
    wide = hi0 <= lo0
    per_song = per_song.withColumns({"__lo": F.when(wide, F.lit(0).cast("bigint")).otherwise(lo0), "__hi": F.when(wide, free).otherwise(hi0)})
    reason = F.coalesce(lacking, F.when(n <= w_fr + 2, "too_short").when(F.col("__hi") <= F.col("__lo"), "no_valid_window"))
    per_song = materialize(per_song.withColumn("__reason", reason), "excerpt-songs")
    # The p95 of a stem is taken over its whole series, before the series are cut to a common length.
    rel = stem_presence(seen.where(F.col("stem") != "mixture"), [song, "stem"])
    lens = per_song.where(F.col("__reason").isNull()).select(song, "n_frames", "__lo", "__hi")
    rel = rel.join(lens, song).where(F.col("frame_idx") < F.col("n_frames"))
    mix = seen.where(F.col("stem") == "mixture").join(lens, song).where(F.col("frame_idx") < F.col("n_frames"))
    rel_mean = moving_mean_std(rel, [song, "stem"], "frame_idx", "presence_db", w_fr)
    wide_stems = rel_mean.groupBy(song, "frame_idx").agg(*[F.max(F.when(F.col("stem") == s, F.col("mean"))).alias(f"stem_{s}") for s in stems])
    mix_ms = moving_mean_std(mix, [song], "frame_idx", "rms_db", w_fr).select(song, "frame_idx", F.col("mean").alias("mix_mean"), F.col("std").alias("mix_std"))
    cand = wide_stems.join(mix_ms, [song, "frame_idx"]).join(lens, song)
    cand = cand.where((F.col("frame_idx") >= F.col("__lo")) & (F.col("frame_idx") < F.col("__hi")))
    weakest = F.least(*[F.col(f"stem_{s}") for s in stems]) if len(stems) > 1 else F.col(f"stem_{stems[0]}")
    cand = cand.withColumn("min_stem", weakest).withColumn("score", F.col("min_stem") - lam * F.col("mix_std"))
    cols = ["frame_idx", "score", "min_stem", "mix_mean", "mix_std", *[f"stem_{s}" for s in stems]]
    best = cand.groupBy(song).agg(F.max_by(F.struct(*cols), F.struct("score", -F.col("frame_idx"))).alias("b"))
    active = sum((F.when(F.col(f"b.stem_{s}") >= floor_db, 1).otherwise(0) for s in stems), F.lit(0))
    best = best.withColumn("n_active_stems", active)
    quiet = F.when(F.col("n_active_stems") < 3, F.concat(F.lit("only_"), F.col("n_active_stems").cast("string"), F.lit("_active_stems"))) \
        .when(F.col("b.min_stem") < floor_db - 12.0, "weakest_stem_too_quiet")
    best = best.withColumn("__quiet", quiet)
    out = per_song.join(best, song, "left")
    why = F.coalesce("__reason", "__quiet")
    start = F.col("b.frame_idx") * hop
    return out.select(song, (F.col("__mix_n") * hop).alias("duration_sec"), start.alias("start_sec"), (start + length).alias("end_sec"),
                      F.col("b.score").alias("score_db"), F.col("b.min_stem").alias("min_stem_db"), F.col("b.mix_mean").alias("mix_rms_mean_db"),
                      F.col("b.mix_std").alias("mix_rms_std_db"), "n_active_stems", why.isNotNull().alias("excluded"), why.alias("exclude_reason"))


def _half_even(x: float) -> int:
    return int(round(x))


def excerpt_bounds(songs: DataFrame, length: float, rate: int, start: str = "start_sec", total: str = "total_samples") -> DataFrame:
    """Sample window of an excerpt: shifted inside the item, the whole item when it is not longer."""
    n = F.bround(F.lit(float(length)) * rate).cast("bigint")
    whole = (n <= 0) | (n >= F.col(total))
    at = F.bround(F.col(start) * rate).cast("bigint")
    inside = F.least(F.greatest(F.lit(0).cast("bigint"), at), F.col(total) - n)
    return songs.withColumns({"start_n": F.when(whole, F.lit(0).cast("bigint")).otherwise(inside),
                              "n_samples": F.when(whole, F.col(total)).otherwise(n)})


def center_crop(frames: DataFrame, by: Sequence[str], index: str, keep: int) -> DataFrame:
    """Frames of the centred window of at most ``keep`` frames."""
    total = frames.groupBy(*by).agg(F.count("*").alias("__n"))
    first = F.floor((F.col("__n") - keep) / 2)
    out = attach(frames, total, by)
    inside = (F.col("__n") <= keep) | ((F.col(index) >= first) & (F.col(index) < first + keep))
    return out.where(inside).drop("__n")


def energy_boundaries(frames: DataFrame, by: Sequence[str], index: str, at: str, value: str, n_sections: int, min_gap: float,
                      labels: Sequence[str]) -> DataFrame:
    """Boundaries at the largest level changes, at least ``min_gap`` apart: n-1 rounds of "take the largest, drop its
    neighbours". Items with fewer than 2·n frames are one section. Ties take the later frame first."""
    diff = prefix_scan(frames, by, [F.asc(index)], F.floor(F.col(index) / BLOCK_ROWS).cast("bigint"),
                       {"__p": previous(F.struct(F.col(value).alias("x"), F.col(at).alias("t")))})
    counts = frames.groupBy(*by).agg(F.count("*").alias("__n"))
    ok = F.col("__n") >= n_sections * 2
    cand = attach(diff, counts, by).where(ok & F.col("__p").isNotNull()).select(
        *by, F.abs(F.col(value) - F.col("__p.v.x")).alias("__d"), F.col(index).alias("__i"), F.col(at).cast("double").alias("__t"))
    # The picks of a key form an array of at most n-1 times, so a round is one aggregate and one filter.
    cand = materialize(cand, "level-changes")
    picks = counts.select(*by, F.array().cast("array<double>").alias("__picks"), ok.alias("__ok"))
    for _ in range(n_sections - 1):
        far = F.forall("__picks", lambda p: F.abs(F.col("__t") - p) >= min_gap)
        best = attach(cand, picks.select(*by, "__picks"), by).where(far).groupBy(*by).agg(
            F.max_by("__t", F.struct("__d", "__i")).alias("__new"))
        picks = attach(picks, best, by).withColumn(
            "__picks", F.when(F.col("__new").isNull(), F.col("__picks")).otherwise(F.array_append("__picks", F.col("__new")))).drop("__new")
        picks = materialize(picks, "picks")
    names = F.array(*[F.lit(x) for x in labels])
    rows = F.transform(F.array_sort("__picks"), lambda p, i: F.struct(
        p.alias("start_sec"), F.coalesce(F.get(names, i), F.concat(F.lit("section_"), (i + 1).cast("string"))).alias("label")))
    head = F.array(F.struct(F.lit(0.0).alias("start_sec"), F.when(F.col("__ok"), "intro").otherwise("whole").alias("label")))
    return picks.select(*by, F.inline(F.concat(head, rows)))


def merge_boundaries(bounds: DataFrame, by: Sequence[str], min_sec: float, duration: str = "duration_sec",
                     width: float = 86400.0) -> DataFrame:
    """Greedy merge of boundaries closer than ``min_sec``; a last section shorter than that is dropped.

    Every boundary at least ``min_sec`` after its predecessor is kept whatever came before, so the boundaries fall
    into independent clusters of close neighbours; only a cluster is folded, never the boundaries of a whole item.
    """
    items = bounds.groupBy(*by).agg(F.max(duration).alias("__d"))
    inner = bounds.where((F.col("start_sec") > 0) & (F.col("start_sec") < F.col(duration))).select(
        *by, F.col("start_sec").cast("double").alias("__t")).distinct()
    rows = inner.unionByName(items.select(*by, F.lit(0.0).alias("__t")))
    block = F.floor(F.col("__t") / width).cast("bigint")
    rows = prefix_scan(rows, by, [F.asc("__t")], block, {"__p": previous("__t")})
    starts = F.coalesce(F.col("__t") - F.col("__p.v") >= min_sec, F.lit(True)).cast("bigint")
    rows = materialize(rows.select(*by, "__t", starts.alias("__new")), "boundary-starts")
    rows = prefix_scan(rows, by, [F.asc("__t")], block, {"__cluster": running_sum("__new")})
    packed = rows.groupBy(*by, "__cluster").agg(F.array_sort(F.collect_list("__t")).alias("__a"))
    fold = F.aggregate(F.slice("__a", 2, F.greatest(F.size("__a"), F.lit(1))), F.slice("__a", 1, 1), lambda acc, x: F.when(
        x - F.element_at(acc, -1) >= min_sec, F.array_append(acc, x)).otherwise(acc))
    kept = materialize(packed.select(*by, F.explode(fold).alias("start_sec")), "boundaries")
    last = attach(items, kept.groupBy(*by).agg(F.max("start_sec").alias("__last")), by)
    kept = attach(kept, last, by).where(
        (F.col("start_sec") < F.col("__last")) | (F.col("start_sec") == 0) | (F.col("__d") - F.col("__last") >= min_sec))
    kept = prefix_scan(kept.select(*by, "start_sec"), by, [F.asc("start_sec")], F.floor(F.col("start_sec") / width).cast("bigint"),
                       {"__n": running_count()})
    return kept.select(*by, "start_sec", F.concat(F.lit("seg_"), (F.col("__n") - 1).cast("string")).alias("label"))


def stereo_stats(samples: DataFrame, by: Sequence[str], left: str, right: str) -> DataFrame:
    """Channel correlation (1 when a channel is flat) and side-to-mid ratio in dB."""
    a, b = F.col(left), F.col(right)
    mid, side = 0.5 * (a + b), 0.5 * (a - b)
    out = samples.groupBy(*by).agg(F.corr(a, b).alias("__c"), F.stddev_pop(a).alias("__sa"), F.stddev_pop(b).alias("__sb"),
                                   F.sqrt(F.avg(mid * mid) + 1e-12).alias("__m"), F.sqrt(F.avg(side * side) + 1e-12).alias("__s"))
    flat = (F.col("__sa") < 1e-7) | (F.col("__sb") < 1e-7) | F.col("__c").isNull() | F.isnan("__c")
    return out.select(*by, F.when(flat, 1.0).otherwise(F.col("__c")).alias("correlation"),
                      (20 * F.log10((F.col("__s") + 1e-12) / (F.col("__m") + 1e-12))).alias("ms_ratio_db"))


def level_trajectory(levels: DataFrame, by: Sequence[str], value: str = "level_db") -> DataFrame:
    """Spread of the window levels of an item over its trajectory: count, mean, std, extremes."""
    return levels.groupBy(*by).agg(F.count("*").alias("n_windows"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                   F.min(value).alias("min"), F.max(value).alias("max"))


def window_pool(vectors: DataFrame, by: Sequence[str], index: str, vector: str, win: int, min_tail: int, dim: int) -> DataFrame:
    """Mean vector over fixed windows of ``win`` rows per item (each window is first averaged); a tail shorter than
    ``min_tail`` is dropped, but at least one window stays."""
    total = vectors.groupBy(*by).agg(F.count("*").alias("__n"))
    j = attach(vectors, total, by).withColumn("__w", F.floor(F.col(index) / win).cast("bigint"))
    full = (F.col("__w") * win + min_tail <= F.col("__n")) | (F.col("__w") == 0)
    avg = [F.avg(F.col(vector)[i].cast("double")).alias(f"__v{i}") for i in range(dim)]
    per = j.where(full).groupBy(*by, "__w").agg(*avg)
    out = per.groupBy(*by).agg(*[F.avg(f"__v{i}").alias(f"__v{i}") for i in range(dim)], F.count("*").alias("n_windows"))
    return out.select(*by, "n_windows", F.array(*[F.col(f"__v{i}") for i in range(dim)]).alias(vector))
