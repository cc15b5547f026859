"""Distances between sets of embedding vectors.

A kernel sum over all vector pairs is quadratic by definition. Vectors are hashed into strips of a few thousand; a task
handles one pair of strips, tile by tile as matrix products, so memory per task is fixed, a hot arm spreads over many tasks,
and a vector is copied once per strip of the other side, not once per tile. Only counts and sums per (song, song) leave a
task: vector pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.joins import attach
from scoreloom.operators.quality import require
from scoreloom.operators.quantiles import exact_percentiles
from scoreloom.session import materialize

STRIP = 4096
TILE = 1024


def with_strips(x: DataFrame, by: Sequence[str], ident: str | Sequence[str], strip: int = STRIP) -> DataFrame:
    """Strip of every row and the number of strips of its group (about ``strip`` rows each)."""
    n = x.groupBy(*by).agg(F.ceil(F.count("*") / strip).cast("int").alias("__nb"))
    out = attach(x, n, by) if by else x.join(F.broadcast(n), F.lit(True))
    names = [ident] if isinstance(ident, str) else list(ident)
    return out.withColumn("__blk", F.pmod(F.xxhash64(*names), F.col("__nb")).cast("int"))


def _sq_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.maximum(d, 0.0)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 1))


def _tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Squared distances of two strips, a tile at a time."""
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            yield slice(i, i + TILE), slice(j, j + TILE), _sq_dist(a[i:i + TILE], b[j:j + TILE])


def _self_cells(x: DataFrame, by: Sequence[str], cols: Sequence[str], ident: str, strip: int):
    """Both sides of the strip pairs (i <= j) within each group."""
    b = with_strips(x, by, ident, strip)
    keep = [*by, *cols]
    last = F.col("__nb") - 1
    left = b.select(*keep, F.col("__blk").alias("__i"), F.explode(F.sequence(F.col("__blk"), last)).alias("__j"))
    right = b.select(*keep, F.explode(F.sequence(F.lit(0), F.col("__blk"))).alias("__i"), F.col("__blk").alias("__j"))
    return left, right


def _cross_cells(x: DataFrame, ref: DataFrame, cols: Sequence[str], ident: str, vector: str, strip: int):
    """Both sides of the strip pairs between x and the reference; all arms of x share the strips."""
    xb, rb = with_strips(x, [], ident, strip), with_strips(ref.select(ident, vector), [], ident, strip)
    other = lambda df: df.agg(F.ceil(F.count("*") / strip).cast("int").alias("__n"))  # noqa: E731  one row
    spread = lambda df, o: df.join(F.broadcast(o), F.lit(True)).where("__n > 0")
    each = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    left = spread(xb, other(ref)).select(*cols, F.col("__blk").alias("__i"), each.alias("__j"))
    right = spread(rb, other(x)).select(F.col(vector).alias("__rv"), each.alias("__i"), F.col("__blk").alias("__j"))
    return left, right


def nothing(*columns: str) -> pd.DataFrame:
    """No rows; columns of objects fit any type."""
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _cogroup(left: DataFrame, right: DataFrame, keys: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    # Both sides may stem from one frame; toDF gives them columns of their own.
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(fn, schema)


def _types(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)


def median_bandwidth(ref: DataFrame, ident: str, vector: str = "embedding", bins: int = 65536, strip: int = STRIP) -> DataFrame:
    """One row ``sigma``: exact median distance over all pairs of the reference plus 1e-9 (null for fewer than two vectors).

    The pairs are never listed. A positive float orders like its bit pattern, so the pattern of a middle rank is found by
    counting: every pass counts the distances below and in ``bins`` equal cells of the range that still holds the rank, and
    the next range is one cell; four passes reach a single pattern. Each pass is a job that returns at most ``bins`` + 2
    counts for each of the two ranks.
    """
    spark = ref.sparkSession
    n = ref.count()
    pairs = n * (n - 1) // 2
    if not pairs:
        return spark.createDataFrame([(None,)], "sigma double")
    left, right = _self_cells(ref.select(ident, vector), [], [ident, vector], ident, strip)
    ranges = dict.fromkeys(((pairs - 1) // 2, pairs // 2), (0, 2**63))
    while any(high - low > 1 for low, high in ranges.values()):
        cells = sorted({(low, -(-(high - low) // bins)) for low, high in ranges.values()})

        counted = _cogroup(left, right, ["__i", "__j"], _pattern_counts(cells, bins, ident, vector), "row bigint, at bigint, n bigint").groupBy("row", "at").agg(F.sum("n")).collect()
        hist = np.zeros((len(cells), bins + 2), np.int64)
        for row, at, c in counted:
            hist[row, at + 1] = c
        for rank, (low, high) in ranges.items():
            step = -(-(high - low) // bins)
            upto = np.cumsum(hist[cells.index((low, step))])
            cell = min(max(int(np.searchsorted(upto, rank, "right")) - 1, 0), bins - 1)
            ranges[rank] = (low + cell * step, min(high, low + (cell + 1) * step))
    middle = [float(np.int64(low).view(np.float64)) for low, _ in ranges.values()]
    return spark.createDataFrame([(sum(middle) / len(middle) + 1e-9,)], "sigma double")


def _pattern_counts(cells: list[tuple[int, int]], bins: int, ident: str, vector: str) -> Callable:
    """Counts of distances by bit pattern: for each (low, step) of ``cells`` in ``bins`` cells, -1 below and ``bins`` above them."""
    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros((len(cells), bins + 2), np.int64)
        if len(a) and len(b):
            a, b = a.sort_values(ident), b.sort_values(ident)
            same = a["__i"].iloc[0] == a["__j"].iloc[0]
            ids_a, ids_b = a[ident].to_numpy(), b[ident].to_numpy()
            for i, j, d in _tiles(_matrix(a[vector]), _matrix(b[vector])):
                d = np.sqrt(d)
                bits = (d[ids_a[i][:, None] < ids_b[j][None, :]] if same else d.ravel()).view(np.int64)
                for row, (low, step) in enumerate(cells):
                    found[row] += np.bincount(np.clip((bits - low) // step, -1, bins) + 1, minlength=bins + 2)
        row, at = np.nonzero(found)
        return pd.DataFrame({"row": row, "at": at - 1, "n": found[row, at]})
    return count


def within_kernel(x: DataFrame, sigma: DataFrame, by: Sequence[str] = ("run",), song: str = "song", ident: str = "vec_id",
                  vector: str = "embedding", strip: int = STRIP) -> DataFrame:
    """Gaussian kernel sums per song pair of each arm, self pairs included."""
    by = list(by)
    xs = x.select(*by, song, ident, vector).join(F.broadcast(sigma), F.lit(True))
    left, right = _self_cells(xs, by, [song, vector, "sigma"], ident, strip)

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return nothing(*by, "song_a", "song_b", "k")
        sa, ua = pd.factorize(a[song], use_na_sentinel=False)
        sb, ub = pd.factorize(b[song], use_na_sentinel=False)
        scale, both = 2.0 * a["sigma"].iloc[0] ** 2, np.zeros((len(ub), len(ua)))
        for i, j, d in _tiles(_matrix(a[vector]), _matrix(b[vector])):
            left_sum = np.zeros((len(ua), d.shape[1]))
            np.add.at(left_sum, sa[i], np.exp(-d / scale))
            np.add.at(both, sb[j], left_sum.T)
        g = pd.DataFrame({"song_a": np.tile(ua, len(ub)), "song_b": np.repeat(ub, len(ua)), "k": both.ravel()})
        if a["__i"].iloc[0] != a["__j"].iloc[0]:
            g = pd.concat([g, g.rename(columns={"song_a": "song_b", "song_b": "song_a"})])
        for c in by:
            g[c] = a[c].iloc[0]
        return g[[*by, "song_a", "song_b", "k"]]

    st = x.schema[song].dataType.simpleString()
    schema = ", ".join(filter(None, [_types(x, by), f"song_a {st}, song_b {st}, k double"]))
    return _cogroup(left, right, [*by, "__i", "__j"], cell, schema).groupBy(*by, "song_a", "song_b").agg(F.sum("k").alias("k"))


def _against_reference(x: DataFrame, ref: DataFrame, keys: Sequence[str], ident: str, vector: str, strip: int, stats: Callable,
                       names: dict[str, str]) -> DataFrame:
    """Per (keys): columns of ``names`` (name: type) that ``stats(tile)`` gives per row, merged by name within a strip pair."""
    more = ["sigma"] if "sigma" in x.columns else []
    left, right = _cross_cells(x.select(*keys, ident, vector, *more), ref, [*keys, vector, *more], ident, vector, strip)
    merge = {n: {"lo": "min", "hi": "max"}.get(n, "sum") for n in names}

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return nothing(*keys, *names)
        parts = []
        for i, _, d in _tiles(_matrix(a[vector]), _matrix(b["__rv"])):
            part = a[list(keys)].iloc[i].reset_index(drop=True)
            parts.append(part.assign(**stats(d, a["sigma"].iloc[0] if more else None)))
        return pd.concat(parts).groupby(list(keys), as_index=False, dropna=False).agg(merge)[[*keys, *names]]

    schema = f"{_types(x, keys)}, " + ", ".join(f"{n} {t}" for n, t in names.items())
    aggs = {"min": F.min, "max": F.max, "sum": F.sum}
    return _cogroup(left, right, ["__i", "__j"], cell, schema).groupBy(*keys).agg(*[aggs[merge[n]](n).alias(n) for n in names])


def cross_kernel(x: DataFrame, ref: DataFrame, sigma: DataFrame, by: Sequence[str] = ("run",), song: str = "song", ident: str = "vec_id",
                 vector: str = "embedding", strip: int = STRIP) -> DataFrame:
    """Per song: kernel sum against the whole reference, its vectors and the size of the reference."""
    keys = [*by, song]
    xs = x.select(*keys, ident, vector).join(F.broadcast(sigma), F.lit(True))
    kxy = _against_reference(xs, ref, keys, ident, vector, strip, lambda d, s: {"k": np.exp(-d / (2.0 * s * s)).sum(1)}, {"k": "double"})
    sizes = x.groupBy(*keys).agg(F.count("*").alias("n_vectors"))
    n_ref = ref.agg(F.count("*").alias("n_ref"))
    return attach(sizes, kxy, keys).join(F.broadcast(n_ref), F.lit(True))


def song_kernel(x: DataFrame, ref: DataFrame, sigma: DataFrame, by: Sequence[str] = ("run",), song: str = "song", ident: str = "vec_id",
                vector: str = "embedding", strip: int = STRIP) -> tuple[DataFrame, DataFrame]:
    """(within, cross) kernel sums, computed once and written to the shared folder: every bootstrap replicate reuses
    them with its resample counts."""
    args = (sigma, by, song, ident, vector, strip)
    return (materialize(within_kernel(x, *args), "kernel"),
            materialize(cross_kernel(x, ref, *args), "kernel-ref"))


def pairwise_sq_dist(x: DataFrame, ref: DataFrame, by: Sequence[str] = ("run",), song: str = "song", ident: str = "vec_id",
                     vector: str = "embedding", strip: int = STRIP) -> DataFrame:
    """Squared distances of every vector to every reference vector, summed per song with the smallest and largest."""
    out = _against_reference(x, ref, [*by, song], ident, vector, strip,
                             lambda d, _: {"s": d.sum(1), "lo": d.min(1), "hi": d.max(1), "n": d.shape[1]},
                             {"s": "double", "lo": "double", "hi": "double", "n": "bigint"})
    return out.withColumnsRenamed({"s": "sum_sq", "lo": "min_sq", "hi": "max_sq", "n": "n_pairs"})


def reference_term(ref: DataFrame, sigma: DataFrame, ident: str = "vec_id", vector: str = "embedding", strip: int = STRIP) -> DataFrame:
    """One row ``syy``: mean kernel over the different pairs of the reference."""
    one = ref.select(F.lit(0).alias("run"), F.lit(0).alias("song"), ident, vector)
    k = within_kernel(one, sigma, ("run",), "song", ident, vector, strip).agg(F.sum("k").alias("k"))
    # Both sides are single rows.
    j = k.join(F.broadcast(ref.agg(F.count("*").cast("double").alias("m"))), F.lit(True))
    return j.select(F.when(F.col("m") > 1, (F.col("k") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).otherwise(0.0).alias("syy"))


def mmd2_unbiased(kernel: tuple[DataFrame, DataFrame], syy: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Unbiased squared MMD per arm from the kernel sums; the self pairs (kernel 1) are taken out."""
    kxx, cross = kernel
    sx = kxx.groupBy(*by).agg(F.sum("k").alias("__kxx"))
    sy = cross.groupBy(*by).agg(F.sum("k").alias("__kxy"), F.sum("n_vectors").cast("double").alias("n"), F.max("n_ref").alias("m"))
    n = F.col("n")
    sxx = F.when(n > 1, (F.col("__kxx") - n) / (n * (n - 1))).otherwise(0.0)
    out = attach(sy, sx, by).join(F.broadcast(syy), F.lit(True))
    return out.select(*by, n.cast("bigint").alias("n_vectors"), (sxx + F.col("syy") - 2 * F.col("__kxy") / (n * F.col("m"))).alias("mmd2"))


def bootstrap_mmd(kernel: tuple[DataFrame, DataFrame], syy: DataFrame, counts: DataFrame, reps: int, by: Sequence[str] = ("run",),
                  song: str = "song", cut: bool = True, strip: int = 1024) -> DataFrame:
    """Squared MMD of every replicate 1..``reps`` from resample counts: sum of c_a c_b K_ab minus the resampled vectors.

    Counts become one row per song with an array over the replicates. The kernel is cut into song strip by song strip; a task
    multiplies one such piece with the count matrices of its two strips and gives one number per replicate, so rows per
    (song, song, replicate) never exist.
    """
    kxx, cross = kernel
    by = list(by)
    packed = counts.groupBy(*by, song).agg(F.map_from_entries(F.collect_list(F.struct("rep", "count"))).alias("__m")).select(
        *by, song, F.transform(F.sequence(F.lit(1), F.lit(reps)), lambda r: F.coalesce(F.try_element_at("__m", r), F.lit(0)).cast("int")).alias("__c"))
    own = materialize(with_strips(attach(cross, packed, [*by, song]), by, song, strip), "resamples")
    place = own.select(*by, F.col(song).alias("__s"), "__blk", "__nb")
    at = lambda side: place.select(*[F.col(c).alias(f"__{side}_{c}") for c in by], F.col("__s").alias(f"__{side}"), F.col("__blk").alias(f"__b{side}"))

    def on(side):
        test = F.col(f"song_{side}").eqNullSafe(F.col(f"__{side}"))
        for c in by:
            test = test & F.col(c).eqNullSafe(F.col(f"__{side}_{c}"))
        return test

    left = kxx.join(at("a"), on("a")).join(at("b"), on("b")).select(
        *by, "song_a", "song_b", "k", F.col("__ba").alias("__i"), F.col("__bb").alias("__j"))
    others = F.explode(F.sequence(F.lit(0), F.col("__nb") - 1))
    rows = own.where(F.col("__c").isNotNull()).select(*by, song, "__c", "__blk", others.alias("__o"))
    right = rows.select(*by, song, "__c", F.col("__blk").alias("__i"), F.col("__o").alias("__j")).unionByName(
        rows.where("__blk <> __o").select(*by, song, "__c", F.col("__o").alias("__i"), F.col("__blk").alias("__j")))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return nothing(*by, "rep", "k")
        c = _matrix(b["__c"])
        songs = pd.Index(b[song])
        i, j = songs.get_indexer(a["song_a"]), songs.get_indexer(a["song_b"])
        known = (i >= 0) & (j >= 0)  # a song that no replicate drew counts nowhere
        k = np.zeros((len(songs), len(songs)))
        k[i[known], j[known]] = a["k"].to_numpy()[known]
        g = pd.DataFrame({"rep": np.arange(1, reps + 1), "k": (c * (k @ c)).sum(0)})
        for col in by:
            g[col] = a[col].iloc[0]
        return g[[*by, "rep", "k"]]

    schema = ", ".join(filter(None, [_types(kxx, by), "rep int, k double"]))
    xx = _cogroup(left, right, [*by, "__i", "__j"], product, schema).groupBy(*by, "rep").agg(F.sum("k").alias("__kxx"))
    xy = own.where(F.col("__c").isNotNull()).select(*by, "k", "n_vectors", "n_ref", F.posexplode("__c").alias("__p", "__n")).groupBy(
        *by, (F.col("__p") + 1).alias("rep")).agg(
        F.sum(F.col("__n") * F.col("k")).alias("__kxy"), F.sum(F.col("__n") * F.col("n_vectors")).cast("double").alias("n"), F.max("n_ref").alias("m"))
    n = F.col("n")
    sxx = F.when(n > 1, (F.col("__kxx") - n) / (n * (n - 1))).otherwise(0.0)
    out = attach(xy, xx, [*by, "rep"]).join(F.broadcast(syy), F.lit(True))
    out = out.select(*by, "rep", (sxx + F.col("syy") - 2 * F.col("__kxy") / (n * F.col("m"))).alias("mmd2"))
    return materialize(out, "replicates") if cut else out


def bootstrap_ci(replicates: DataFrame, by: Sequence[str] = ("run",), value: str = "mmd2") -> DataFrame:
    q = exact_percentiles(replicates, by, value, {"ci_lo": 0.025, "ci_hi": 0.975})
    return attach(replicates.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n_rep")), q, by)


def bootstrap_diff(replicates: DataFrame, songs: DataFrame, a: object, b: object, arm: str = "run", song: str = "song") -> DataFrame:
    """Interval of the paired difference a - b on equal resamples; fails unless both arms cover the same songs."""
    own = lambda x: songs.where(F.col(arm) == x).select(song).distinct()
    gap = own(a).join(own(b), song, "left_anti").unionByName(own(b).join(own(a), song, "left_anti"))
    d = replicates.where(F.col(arm) == a).select("rep", F.col("mmd2").alias("__a")).join(
        replicates.where(F.col(arm) == b).select("rep", F.col("mmd2").alias("__b")), "rep")
    d = require(d.select(F.lit(f"{a} - {b}").alias("pair"), (F.col("__a") - F.col("__b")).alias("diff")), gap, "arms differ in songs")
    d = materialize(d, "differences")
    out = bootstrap_ci(d, ["pair"], "diff")
    return out.withColumn("excludes_zero", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def restrict_songs(x: DataFrame, wanted: DataFrame, by: Sequence[str] = ("run",), song: str = "song") -> DataFrame:
    """Rows of the listed songs; fails when an arm does not cover the whole list."""
    mine = x.join(wanted.select(song).distinct(), song, "left_semi")
    n = wanted.agg(F.count_distinct(song).alias("__want"))
    # Arms without any listed song are incomplete too, so the check starts from all arms.
    cover = attach(x.select(*by).distinct(), mine.groupBy(*by).agg(F.count_distinct(song).alias("__have")), by)
    bad = cover.join(F.broadcast(n), F.lit(True)).where(F.coalesce("__have", F.lit(0)) != F.col("__want"))
    return require(mine, bad, "arms that do not cover the song list")


def moments(x: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """Count, vector sum and outer-product sum per group as (by, pos, value) sums; partial sums leave each partition."""
    by = list(by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, g in pdf.groupby(by, sort=False):
                m = np.hstack([np.ones((len(g), 1)), _matrix(g[vector])])
                acc[key] = acc.get(key, 0.0) + m.T @ m
        for key, m in acc.items():
            yield pd.DataFrame({**{c: [v] for c, v in zip(by, key)}, "m": [m.ravel()]})

    part = x.select(*by, vector).mapInPandas(partial, f"{_types(x, by)}, m array<double>")
    return part.select(*by, F.posexplode("m").alias("pos", "value")).groupBy(*by, "pos").agg(F.sum("value").alias("value"))


def frechet_distance(x: DataFrame, ref: DataFrame, by: Sequence[str] = ("run",), vector: str = "embedding") -> DataFrame:
    """Fréchet distance of each arm to the reference from means and covariances (divisor n - 1).

    The data pass is distributed; the closing step sees one (d+1)x(d+1) matrix per arm.
    """
    by = list(by)
    m = moments(x, by, vector)
    r = moments(ref.select(F.lit(0).alias("__g"), vector), ["__g"], vector)
    ref_row = r.agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("l")).select(F.transform("l", lambda s: s["value"]).alias("ref"))
    rows = m.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("l")).select(
        *by, F.transform("l", lambda s: s["value"]).alias("own")).join(F.broadcast(ref_row), F.lit(True))

    def gaussian(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = int(round(np.sqrt(len(flat))))
        full = np.asarray(flat, dtype=np.float64).reshape(d, d)
        n, s, q = full[0, 0], full[0, 1:], full[1:, 1:]
        return s / n, (q - np.outer(s, s) / n) / (n - 1)

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[by].copy()
            vals = []
            for own, other in zip(pdf["own"], pdf["ref"]):
                (mx, cx), (my, cy) = gaussian(own), gaussian(other)
                root = np.sqrt(np.maximum(np.linalg.eigvals(cx @ cy).real, 0.0)).sum()
                vals.append(float((mx - my) @ (mx - my) + np.trace(cx) + np.trace(cy) - 2.0 * root))
            out["frechet"] = vals
            yield out

    return rows.mapInPandas(close, f"{_types(x, by)}, frechet double")
