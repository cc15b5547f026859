"""Deterministic draws, samples, splits, grids and distribution tables.

Everything random is a hash of keys, never ``rand()``: the same key gives the same draw in every run, arm and
partitioning (common random numbers).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.scalars import ColumnOrName, col, hash_uniform
from scoreloom.operators.joins import attach
from scoreloom.operators.scan import ordinal


def seed_key(index: ColumnOrName, seed_idx: ColumnOrName, base: int = 0, stride: int = 100) -> Column:
    return F.lit(base) + col(index) * stride + col(seed_idx)


def gain(lo: float, hi: float, mode: str = "linear", seed: ColumnOrName = "seed", track: ColumnOrName = "track") -> Column:
    """The draw of (seed, track) as a gain in [lo, hi]; the same draw for every range and mode."""
    level = lo + (hi - lo) * hash_uniform(seed, track)
    return F.pow(F.lit(10.0), level / 20.0) if mode == "db" else level


def sample_gains(songs: DataFrame, seeds: int, tracks: Sequence[str], lo: float, hi: float, mode: str = "linear",
                 base: int = 0, stride: int = 100, index: str = "song_index") -> DataFrame:
    """One gain per (song, seed, track): uniform in [lo, hi], linear or in dB."""
    if hi < lo:
        raise ValueError("gain range needs lo <= hi")
    if seeds > stride:
        raise ValueError("stride must exceed the number of seeds")
    rows = songs.withColumn("seed_idx", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    rows = rows.withColumn("seed", seed_key(index, "seed_idx", base, stride))
    rows = rows.withColumn("track", F.explode(F.array(*[F.lit(t) for t in sorted(tracks)])))
    return rows.withColumn("gain", gain(lo, hi, mode))


def stratified_nested_sample(plan: DataFrame, n: int, seed: int, song: str = "song", split: str = "split") -> DataFrame:
    """Largest-remainder quota per split, filled from a fixed hash order, so a smaller sample is inside a larger one."""
    sizes = plan.groupBy(split).agg(F.count("*").alias("__c"))
    total = sizes.agg(F.sum("__c").alias("__t"))
    q = sizes.join(F.broadcast(total), F.lit(True)).withColumn("__raw", F.least(F.lit(n), "__t") * F.col("__c") / F.col("__t"))
    q = q.withColumns({"__f": F.floor("__raw"), "__rem": F.col("__raw") - F.floor("__raw")})
    from pyspark.sql import Window as W
    one = W.partitionBy(F.lit(0))  # splits are a handful of names
    q = q.withColumn("__rest", F.least(F.lit(n), "__t") - F.sum("__f").over(one))
    q = q.withColumn("__rk", F.row_number().over(one.orderBy(F.desc("__rem"), F.asc(split))))
    q = q.select(split, (F.col("__f") + (F.col("__rk") <= F.col("__rest")).cast("int")).alias("quota"))
    u = plan.withColumn("__u", hash_uniform(F.lit(seed), song))
    ranked = ordinal(u, [split], [F.asc("__u"), F.asc(song)], F.floor(F.col("__u") * 1024).cast("bigint"), "draw")
    return ranked.join(q, split).where(F.col("draw") <= F.col("quota")).drop("__u", "quota")


def build_splits(songs: DataFrame, song: str, tier: str, source: str, block: Column, forced_tier: str = "C") -> DataFrame:
    """train as it is; the source test set is halved within each tier (first half dev, second test); the forced tier
    always goes to test."""
    test = songs.where(F.col(source) == "test")
    counts = test.groupBy(tier).agg(F.count("*").alias("__n"))
    ranked = attach(ordinal(test, [tier], [F.asc(song)], block), counts, [tier])
    half = F.when((F.col(tier) != forced_tier) & (F.col("rn") <= F.ceil(F.col("__n") / 2)), "dev").otherwise("test")
    return ranked.withColumn("split", half).drop("rn", "__n").unionByName(
        songs.where(F.col(source) == "train").withColumn("split", F.lit("train")))


def experiment_grid(songs: DataFrame, cells: Sequence[tuple[str, Sequence[str], Sequence[str]]], seeds: Sequence[int]) -> DataFrame:
    """Songs x cells x seeds; a cell is (name, resolutions, scopes). Cells and seeds are exploded from literals."""
    lit = F.array(*[F.struct(F.lit(n).alias("cell"), F.array(*[F.lit(r) for r in rs]).alias("resolutions"),
                             F.array(*[F.lit(s) for s in ss]).alias("scopes")) for n, rs, ss in cells])
    out = songs.select("*", F.inline(lit))
    return out.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def element_mask(present: Sequence[Column]) -> Column:
    """Bitmask of the present elements."""
    out = F.lit(0)
    for i, p in enumerate(present):
        out = out + F.when(p, 1 << i).otherwise(0)
    return out


def mix_in(probs: Sequence[tuple[str, float]], name: str, p_new: float) -> list[tuple[str, float]]:
    """Give a new kind probability ``p_new``; the ratios of the others stay."""
    scaled = [(k, p * (1.0 - p_new)) for k, p in probs] + [(name, p_new)]
    total = sum(p for _, p in scaled)
    return [(k, p / total) for k, p in scaled]


def categorical_draw(u: ColumnOrName, probs: Sequence[tuple[str, float]]) -> Column:
    """Kind whose cumulative range contains the uniform ``u``."""
    cum, out = 0.0, None
    for kind, p in probs[:-1]:
        cum += p
        out = F.when(col(u) < cum, F.lit(kind)) if out is None else out.when(col(u) < cum, F.lit(kind))
    last = F.lit(probs[-1][0])
    return last if out is None else out.otherwise(last)


def histogram_draw(df: DataFrame, prior: DataFrame, u_bin: ColumnOrName, u_in: ColumnOrName, on: Sequence[str] = ("action", "arg"),
                   lo: str = "legal_lo", hi: str = "legal_hi") -> DataFrame:
    """Bin by probability, uniform inside the bin, clipped to the legal range; null where there is no histogram.

    ``prior``: on, bin_idx, bin_lo, bin_hi, prob, legal range. A histogram is a short list of bins, so it travels as
    one array per (action, argument).
    """
    bins = F.array_sort(F.collect_list(F.struct("bin_idx", "bin_lo", "bin_hi", "prob")))
    h = prior.groupBy(*on).agg(bins.alias("__h"), F.first(lo).alias(lo), F.first(hi).alias(hi))
    out = df.join(h, list(on), "left")
    mass = F.aggregate("__h", F.lit(0.0), lambda a, b: a + b["prob"])
    state = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("int").alias("i"))

    def step(acc: Column, b: Column) -> Column:
        c = acc["c"] + b["prob"] / mass
        return F.struct(c.alias("c"), F.coalesce(acc["i"], F.when(col(u_bin) < c, b["bin_idx"].cast("int"))).alias("i"))

    pick = F.aggregate("__h", state, step, lambda acc: acc["i"])
    chosen = F.coalesce(F.get(F.filter("__h", lambda b: b["bin_idx"] == F.col("__i")), F.lit(0)), F.element_at("__h", -1))
    out = out.withColumn("__i", pick).withColumn("__b", chosen)
    value = F.col("__b.bin_lo") + col(u_in) * (F.col("__b.bin_hi") - F.col("__b.bin_lo"))
    return out.withColumn("value", F.least(F.greatest(value, F.col(lo)), F.col(hi))).drop("__h", "__i", "__b", lo, hi)


def renormalise_support(prior: DataFrame, available: DataFrame, entity: str, prefer: DataFrame | None = None) -> DataFrame:
    """Distribution (track, prob) restricted to the tracks each entity has, renormalised.

    An entity without any supported track falls back to its preferred tracks, else to all of its tracks, uniformly.
    """
    j = available.join(prior.select("track", "prob"), "track", "left")
    if prefer is not None:
        j = j.join(prefer.select("track", F.lit(True).alias("__pref")), "track", "left")
    else:
        j = j.withColumn("__pref", F.lit(None).cast("boolean"))
    tot = j.groupBy(entity).agg(F.sum("prob").alias("__p"), F.count_if("__pref").alias("__np"), F.count("*").alias("__n"))
    j = attach(j, tot, [entity])
    p = (F.when(F.col("__p") > 0, F.coalesce(F.col("prob") / F.col("__p"), F.lit(0.0)))
         .when(F.col("__np") > 0, F.when(F.col("__pref"), 1.0 / F.col("__np")).otherwise(0.0)).otherwise(1.0 / F.col("__n")))
    return j.withColumn("p", p).where(F.col("p") > 0).select(entity, "track", "p")


def build_prior(log: DataFrame, ranges: dict[tuple[str, str], tuple[float, float]], bins: int) -> DataFrame:
    """Histogram per (action, argument) of the accepted values weighted by their gain, over the legal range.

    ``log``: action, arg, value, gain. Every bin of every histogram is present, also the empty ones.
    """
    spec = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(g).alias("arg"), F.lit(lo).alias("legal_lo"), F.lit(hi).alias("legal_hi"))
                     for (a, g), (lo, hi) in ranges.items()])
    grid = log.sparkSession.range(1).select(F.inline(spec)).withColumn("bin_idx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    legal = log.join(F.broadcast(grid.select("action", "arg", "legal_lo", "legal_hi").distinct()), ["action", "arg"])
    at = F.floor((F.col("value") - F.col("legal_lo")) / (F.col("legal_hi") - F.col("legal_lo")) * bins)
    at = F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int")
    w = legal.where(F.col("gain") > 0).groupBy("action", "arg", at.alias("bin_idx")).agg(F.sum("gain").alias("__w"))
    out = attach(grid, w, ["action", "arg", "bin_idx"])
    tot = w.groupBy("action", "arg").agg(F.sum("__w").alias("__t"))
    out = attach(out, tot, ["action", "arg"])
    width = (F.col("legal_hi") - F.col("legal_lo")) / bins
    return out.select("action", "arg", "bin_idx", (F.col("legal_lo") + F.col("bin_idx") * width).alias("bin_lo"),
                      (F.col("legal_lo") + (F.col("bin_idx") + 1) * width).alias("bin_hi"),
                      F.when(F.col("__t") > 0, F.coalesce(F.col("__w") / F.col("__t"), F.lit(0.0))).otherwise(1.0 / bins).alias("prob"),
                      "legal_lo", "legal_hi")


def weight_table(log: DataFrame, axes: Sequence[str], weight: str = "gain") -> DataFrame:
    """Raw weight per cell of a table with the given axis columns."""
    return log.where(F.col(weight) > 0).groupBy(*axes).agg(F.sum(weight).alias("weight"))


def smooth_table(weights: DataFrame, axes: dict[str, Sequence], alpha: float) -> DataFrame:
    """(W + alpha) / (sum W + alpha * cells) over the full grid of axis values, empty cells included."""
    grid = weights.sparkSession.range(1).select()
    cells = 1
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
        cells *= len(values)
    inside = weights.join(F.broadcast(grid), list(axes), "left_semi")
    total = inside.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("__t"))
    out = attach(grid, inside, list(axes)).join(F.broadcast(total), F.lit(True))
    return out.select(*axes, ((F.coalesce("weight", F.lit(0.0)) + alpha) / (F.col("__t") + alpha * cells)).alias("prob"))


def validate_prior(prior: DataFrame, ranges: dict[tuple[str, str], tuple[float, float]], tol: float = 1e-6) -> DataFrame:
    """Violations of a distribution table: missing or surplus histograms, mass, legal range, gaps between bins."""
    want = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(g).alias("arg"), F.lit(float(lo)).alias("__lo"), F.lit(float(hi)).alias("__hi"))
                     for (a, g), (lo, hi) in ranges.items()])
    spec = prior.sparkSession.range(1).select(F.inline(want))
    have = prior.groupBy("action", "arg").agg(
        F.sum("prob").alias("__mass"), F.count("*").alias("__n"), F.count_distinct("bin_idx").alias("__d"), F.max("bin_idx").alias("__mx"),
        F.min("bin_lo").alias("__b0"), F.max("bin_hi").alias("__b1"), F.sum(F.col("bin_hi") - F.col("bin_lo")).alias("__w"),
        F.min("legal_lo").alias("__l0"), F.max("legal_hi").alias("__l1"), F.lit(True).alias("__have"))
    j = spec.withColumn("__want", F.lit(True)).join(have, ["action", "arg"], "full_outer")
    found = F.filter(F.array(
        F.when(F.col("__have").isNull(), "missing_histogram"), F.when(F.col("__want").isNull(), "unexpected_histogram"),
        F.when(F.abs(F.col("__mass") - 1.0) > tol, "mass_not_one"),
        F.when((F.col("__l0") != F.col("__lo")) | (F.col("__l1") != F.col("__hi")), "legal_range"),
        F.when((F.col("__n") != F.col("__d")) | (F.col("__mx") != F.col("__n") - 1), "bin_index"),
        F.when(F.abs(F.col("__w") - (F.col("__b1") - F.col("__b0"))) > tol, "edges")), lambda v: v.isNotNull())
    return j.select("action", "arg", F.explode(found).alias("violation"))


def bootstrap_counts(songs: DataFrame, replicates: int, seed: int, song: str = "song", by: Sequence[str] = (),
                     block: Column | None = None) -> DataFrame:
    """(rep, song, count) of n draws with replacement per replicate; arms with the same songs get the same draws.

    Draw d of replicate r is position floor(u·n) of the song order of its group, so no random state is carried.
    """
    by = list(by)
    block = F.floor(F.col(song) / 100_000).cast("bigint") if block is None else block
    ids = ordinal(songs.select(*by, song).distinct(), by, [F.asc(song)], block, "__pos")
    n = ids.groupBy(*by).agg(F.count("*").alias("__n"))
    draws = attach(ids, n, by) if by else ids.join(F.broadcast(n), F.lit(True))
    draws = draws.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    at = F.floor(hash_uniform(F.lit(seed), "rep", "__pos") * F.col("__n")) + 1
    picked = draws.select(*by, "rep", at.cast("bigint").alias("__at")).groupBy(*by, "rep", "__at").agg(F.count("*").alias("count"))
    ids = ids.withColumnRenamed("__pos", "__at")
    return picked.join(ids, [*by, "__at"]).select(*by, "rep", song, "count")
