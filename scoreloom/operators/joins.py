"""Lookups, pairings, set differences, interval and nearest-event joins.

No hint forces a broadcast of data that grows: plain equi joins leave the choice (and skew splitting) to AQE.
Only catalogue tables written in the code or the config are broadcast by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.scalars import ColumnOrName, col, file_stem
from scoreloom.session import materialize


def attach(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on the named keys, null keys included; ``other`` must be unique on them."""
    keys = list(on)
    renamed = other.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return df.join(renamed, test, "left").drop(*[f"__r_{k}" for k in keys])


def apply_gains(levels: DataFrame, gains: DataFrame, on: Sequence[str], level: str, in_db: bool = False) -> DataFrame:
    """Multiply (or in dB add) the gain of each row's key; a key without a gain passes through."""
    joined = levels.join(gains.select(*on, F.col("gain").alias("__g")), list(on), "left")
    new = (F.col(level) + F.coalesce("__g", F.lit(0.0)) if in_db else F.col(level) * F.coalesce("__g", F.lit(1.0)))
    return joined.withColumn(level, new).drop("__g")


def deblind(ratings: DataFrame, manifest: DataFrame, key: str = "blind_key") -> DataFrame:
    """Blind key to (song, condition): the exact key first, else its file stem; unknown keys are dropped."""
    exact = manifest.select(F.col("key").alias(key), F.struct("song", "condition").alias("__exact"))
    stems = manifest.select(F.col("key").alias("__stem"), F.struct("song", "condition").alias("__by_stem"))
    out = (ratings.withColumn("__stem", file_stem(key)).join(exact, key, "left").join(stems, "__stem", "left")
           .withColumn("__hit", F.coalesce("__exact", "__by_stem")).where(F.col("__hit").isNotNull()))
    return out.select(*[c for c in ratings.columns if c not in ("song", "condition")],
                      F.col("__hit.song").alias("song"), F.col("__hit.condition").alias("condition"))


def resolve_song(df: DataFrame, trial_map: DataFrame, column: str = "song") -> DataFrame:
    """Trial id to song; ids that are no trial pass through."""
    lookup = trial_map.select(F.col("trial_id").alias(column), F.col("song").alias("__song"))
    return df.join(lookup, column, "left").withColumn(column, F.coalesce("__song", column)).drop("__song")


def pair_arms(a: DataFrame, b: DataFrame, key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Inner pairing of two arms; metric columns get the suffixes ``_a`` and ``_b``."""
    left = a.select(*key, *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = b.select(*key, *[F.col(m).alias(f"{m}_b") for m in metrics])
    return left.join(right, list(key))


def pair_all_arms(df: DataFrame, arms: Sequence[str], key: Sequence[str], arm: str = "run") -> DataFrame:
    """Rows of the keys that occur in every listed arm."""
    mine = df.where(F.col(arm).isin(*arms))
    full = (mine.groupBy(*key).agg(F.count_distinct(arm).alias("__n")).where(F.col("__n") == len(set(arms)))
            .select(*key))
    return mine.join(full, list(key), "left_semi")


def arm_gap(a: DataFrame, b: DataFrame, key: Sequence[str], samples: int = 3) -> DataFrame:
    """Keys of only one side: a count and the first few keys per direction."""
    def side(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        only = x.select(*key).distinct().join(y.select(*key), list(key), "left_anti")
        first = only.orderBy(*key).limit(samples).agg(
            F.array_sort(F.collect_list(F.struct(*key))).alias("sample"))
        return only.agg(F.count("*").alias("n")).join(F.broadcast(first), F.lit(True)).select(F.lit(name).alias("side"), "n", "sample")
    return side(a, b, "only_a").unionByName(side(b, a, "only_b"))


def pending(plan: DataFrame, records: DataFrame, key: str = "song") -> DataFrame:
    """Plan rows without a terminal record; a record with status ``error`` is retried."""
    terminal = records.where(F.col("status").isin("done", "excluded")).select(key)
    return plan.join(terminal, key, "left_anti")


def crn_parity(a: DataFrame, b: DataFrame, key: Sequence[str] = ("song",), n_seeds: int = 2, gain_tol: float = 1e-12,
               common_tol: float = 1e-9, dry_tol: float = 1e-6) -> DataFrame:
    """Same corruption realisation in two runs? One row per song of ``a``.

    Rows: key, seed_idx, seed, common_gain, gains map<string,double>, dry_pq, norm. All of the first ``n_seeds``
    seeds must be present on both sides, equal seeds, non-null common gains, gains and dry scores within tolerance.
    """
    seeds = F.col("seed_idx") < n_seeds
    cols = ["seed", "common_gain", "gains", "dry_pq", "norm"]
    right = b.where(seeds).select(*key, "seed_idx", *[F.col(c).alias(f"{c}_b") for c in cols], F.lit(1).alias("__there"))
    j = a.where(seeds).join(right, [*key, "seed_idx"], "left")
    same_gains = F.forall(F.map_keys("gains"), lambda k: F.coalesce(
        F.abs(F.element_at("gains", k) - F.element_at("gains_b", k)) <= gain_tol, F.lit(False)))
    same = ((F.col("seed") == F.col("seed_b")) & (F.abs(F.col("common_gain") - F.col("common_gain_b")) <= common_tol)
            & same_gains & (F.abs(F.col("dry_pq") - F.col("dry_pq_b")) <= dry_tol)
            & F.col("norm").eqNullSafe(F.col("norm_b")))
    ok = F.coalesce(same, F.lit(False))
    out = j.groupBy(*key).agg(F.count_if(ok).alias("__ok"), F.count_if(F.col("__there").isNotNull()).alias("n_paired"))
    return out.select(*key, "n_paired", (F.col("__ok") == n_seeds).alias("identical"))


def build_pool(base: DataFrame, others: Sequence[tuple[str, DataFrame]], files: DataFrame, conditions: Sequence[str],
               key: str = "song") -> DataFrame:
    """Songs of the base run with the first reason that drops them (null: usable).

    ``others``: (run name, parity table of :func:`crn_parity`); ``files``: key, condition of the existing renders.
    """
    songs = base.select(key, "split").distinct()
    reasons: list[Column] = []
    out = songs
    for run, parity in others:
        p = parity.select(key, F.col("n_paired").alias(f"__n_{run}"), F.col("identical").alias(f"__i_{run}"))
        out = out.join(p, key, "left")
        there = F.coalesce(F.col(f"__n_{run}"), F.lit(0)) > 0
        reasons.append(F.when(~there, F.lit(f"missing_in_{run}"))
                       .when(~F.coalesce(F.col(f"__i_{run}"), F.lit(False)), F.lit(f"crn_break_{run}")))
    have = (files.where(F.col("condition").isin(*conditions)).groupBy(key)
            .agg(F.count_distinct("condition").alias("__files")))
    out = out.join(have, key, "left")
    reasons.append(F.when(F.coalesce("__files", F.lit(0)) < len(set(conditions)), F.lit("missing_wav")))
    return out.select(key, "split", F.coalesce(*reasons).alias("dropped_for"))


def pool_reasons(pool: DataFrame) -> DataFrame:
    return pool.groupBy(F.coalesce("dropped_for", F.lit("usable")).alias("reason")).agg(F.count("*").alias("n"))


def keep_listeners(df: DataFrame, kept: DataFrame, key: str = "listener") -> DataFrame:
    return df.join(kept.select(key), key, "left_semi")


def excerpt_start(songs: DataFrame, index: DataFrame, analysed: DataFrame, length: float, key: str = "song") -> DataFrame:
    """Start of the excerpt with its origin: index row, else analysed row, else the centred window."""
    i = index.where(~F.col("excluded") & F.col("start_sec").isNotNull()
                    & (F.abs(F.col("length_sec") - length) < 1e-6)).select(key, F.col("start_sec").alias("__i"))
    a = analysed.where(F.col("start_sec").isNotNull()).select(
        key, F.col("start_sec").alias("__a"), F.when(F.col("excluded"), F.concat(
            F.lit("analyse_song(excluded:"), F.coalesce("exclude_reason", F.lit("")), F.lit(")")))
        .otherwise("analyse_song").alias("__tag"))
    centred = F.greatest(F.lit(0.0), (F.col("duration_sec") - length) / 2.0)
    out = songs.join(i, key, "left").join(a, key, "left")
    return out.select(*songs.columns, F.coalesce("__i", "__a", centred).alias("start_sec"),
                      F.when(F.col("__i").isNotNull(), "index").when(F.col("__a").isNotNull(), F.col("__tag"))
                      .otherwise("centered_fallback").alias("origin"))


def interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: ColumnOrName, start: str, end: str,
                  width: float, how: str = "inner") -> DataFrame:
    """Match points to half-open intervals through a time-bucket equi key.

    An interval is repeated once per bucket it touches, so no task compares all points with all intervals.
    """
    bucket = lambda c: F.floor(c / width).cast("bigint")
    right = intervals.withColumn("__b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    right = right.select(*[F.col(b).alias(f"__r_{b}") for b in by], *[c for c in intervals.columns if c not in by], "__b")
    left = points.withColumn("__at", col(at)).withColumn("__pb", bucket(F.col("__at")))
    test = (F.col("__pb") == F.col("__b")) & (F.col("__at") >= F.col(start)) & (F.col("__at") < F.col(end))
    for b in by:
        test = test & (F.col(b) == F.col(f"__r_{b}"))
    return left.join(right, test, how).drop("__at", "__pb", "__b", *[f"__r_{b}" for b in by])


def assign_sections(frames: DataFrame, sections: DataFrame, by: Sequence[str] = ("song",), at: str = "t_sec",
                    width: float = 60.0) -> DataFrame:
    """Frame to section by ``start <= t < end``; frames outside every section keep a null label."""
    return interval_join(frames, sections, by, at, "start_sec", "end_sec", width, "left")


def nearest_event(starts: DataFrame, events: DataFrame, by: Sequence[str], start: str, event: str, tol: float,
                  fits: Column | None = None, width: float = 3600.0) -> DataFrame:
    """Snap a start to the nearest event within ``tol`` (the earlier one on ties), else leave it.

    Starts and events are merged in time order and scanned forwards and backwards for the neighbours: linear, and
    no start-event pairs are built. ``fits`` may refuse a snap (an expression over ``snapped``).
    """
    from scoreloom.operators.scan import prefix_scan, running_last
    keep = [c for c in starts.columns if c not in by and c != start]
    none = F.lit(None).cast("double")
    s = starts.select(*by, F.col(start).cast("double").alias("__t"), F.lit(1).alias("__kind"), none.alias("__ev"),
                      F.struct(*keep).alias("__row") if keep else F.lit(None).alias("__row"))
    e = events.select(*by, F.col(event).cast("double").alias("__t"), F.lit(0).alias("__kind"),
                      F.col(event).cast("double").alias("__ev")).withColumn("__row", F.lit(None).cast(s.schema["__row"].dataType))
    both = s.unionByName(e)
    block = F.floor(F.col("__t") / width).cast("bigint")
    fwd = prefix_scan(both, by, [F.asc("__t"), F.asc("__kind")], block, {"__prev": running_last("__ev")})
    fwd = materialize(fwd, "neighbours")
    # Backwards an event at the very same time is already the forward neighbour.
    bwd = prefix_scan(fwd, by, [F.desc("__t"), F.desc("__kind")], block, {"__next": running_last("__ev")}, backwards=True)
    out = bwd.where(F.col("__kind") == 1)
    dp, dn = F.col("__t") - F.col("__prev"), F.col("__next") - F.col("__t")
    near = F.when(dn.isNull() | (dp <= dn), F.col("__prev")).otherwise(F.col("__next"))
    out = out.withColumn("snapped", near)
    ok = F.coalesce((F.abs(F.col("snapped") - F.col("__t")) <= tol) & (fits if fits is not None else F.lit(True)), F.lit(False))
    return out.select(*by, F.col("__t").alias(start), *([F.col(f"__row.{c}").alias(c) for c in keep]),
                      F.when(ok, F.col("snapped")).otherwise(F.col("__t")).alias("snapped_sec"), ok.alias("snapped"))


def match_repeats(afc: DataFrame, listener: str = "listener") -> DataFrame:
    """Repeat trials with the choice of their original: by ``repeat_of``, else the first trial of the song."""
    rows = afc.where(F.col("choice").isNotNull())
    orig = rows.where(~F.col("is_repeat"))
    by_idx = orig.groupBy(listener, "pair_index").agg(F.min_by("choice", "pair_index").alias("__by_idx"))
    by_song = orig.groupBy(listener, "song").agg(F.min_by("choice", "pair_index").alias("__by_song"))
    reps = rows.where("is_repeat")
    reps = reps.join(by_idx.withColumnRenamed("pair_index", "repeat_of"), [listener, "repeat_of"], "left")
    reps = reps.join(by_song, [listener, "song"], "left")
    return reps.withColumn("original_choice", F.coalesce("__by_idx", "__by_song")).drop("__by_idx", "__by_song")


def policy_lookup(df: DataFrame, policy: DataFrame, genre: str = "genre", role: str = "role") -> DataFrame:
    """(genre, role) to value; an unknown genre uses ``default``, an unknown role the genre's ``other``."""
    known = policy.select(F.col("genre").alias(genre), F.lit(True).alias("__known")).distinct()
    exact = policy.select(F.col("genre").alias("__g"), F.col("role").alias(role), F.col("value").alias("__v"))
    other = policy.where(F.col("role") == "other").select(F.col("genre").alias("__g"), F.col("value").alias("__o"))
    out = df.join(F.broadcast(known), genre, "left").withColumn(
        "__g", F.when(F.col("__known"), F.col(genre)).otherwise("default"))
    out = out.join(F.broadcast(exact), ["__g", role], "left").join(F.broadcast(other), "__g", "left")
    return out.withColumn("value", F.coalesce("__v", "__o", F.lit(0.0))).drop("__g", "__known", "__v", "__o")


def rater_cells(ratings: DataFrame, rater: str, item: str, value: str, seq: Sequence[str]) -> DataFrame:
    """One value per (rater, item); the last one wins."""
    return ratings.groupBy(rater, item).agg(F.max_by(value, F.struct(*seq)).alias(value))


def subset_pairs(grid: DataFrame, elements: int) -> DataFrame:
    """Every (S, S + {e}) pair of a subset grid keyed by bitmask; the equi key is the smaller mask."""
    bits = F.explode(F.array(*[F.lit(i) for i in range(elements)]))
    with_e = grid.select(F.col("mask").alias("mask_with"), F.col("value").alias("value_with"), bits.alias("element"))
    with_e = with_e.where(F.expr("(mask_with & shiftleft(1, element)) != 0")).withColumn(
        "mask", F.expr("mask_with - shiftleft(1, element)"))
    return with_e.join(grid.select("mask", F.col("value").alias("value_without")), "mask")


def score_delta(prev: DataFrame, cur: DataFrame, on: Sequence[str]) -> DataFrame:
    """Per-key difference where both sides are finite numbers."""
    from scoreloom.functions.scalars import finite
    p = prev.select(*on, finite("value").alias("__p"))
    c = cur.select(*on, finite("value").alias("__c"))
    return p.join(c, list(on)).where(F.col("__p").isNotNull() & F.col("__c").isNotNull()).select(
        *on, (F.col("__c") - F.col("__p")).alias("delta"))


def profile_distance(a: DataFrame, b: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Mean absolute difference over shared keys per group, then the mean of the groups that have any."""
    j = a.select(*entity, "grp", "key", F.col("value").alias("__a")).join(
        b.select(*entity, "grp", "key", F.col("value").alias("__b")), [*entity, "grp", "key"])
    per = j.groupBy(*entity, "grp").agg(F.avg(F.abs(F.col("__a") - F.col("__b"))).alias("__d"))
    return per.groupBy(*entity).agg(F.avg("__d").alias("distance"))


def fingerprint_diff(client: DataFrame, server: DataFrame, on: Sequence[str], strict: str, relax: Sequence[str] = ()) -> DataFrame:
    """Mismatching keys of two fingerprints (long form: on, key, value). The ``strict`` key is never relaxed;
    null on both sides agrees, null on one side does not; keys only the server has are not checked."""
    c = client.select(*on, "key", F.col("value").alias("client_value"))
    s = server.select(*on, "key", F.col("value").alias("server_value"))
    j = c.join(s, [*on, "key"], "left")
    free = F.col("key").isin(*relax) & (F.col("key") != strict) if relax else F.lit(False)
    return j.where(~F.col("client_value").eqNullSafe(F.col("server_value")) & ~free)
