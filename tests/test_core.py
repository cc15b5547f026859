"""Scans, exact percentiles and joins against plain windows, with one key holding most rows."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions import stats as ST
from scoreloom.functions.scalars import hash_uniform
from scoreloom.operators import joins as J
from scoreloom.operators import logs as L
from scoreloom.operators import quantiles as Q
from scoreloom.operators import scan as S


def skewed(spark, n=3000):
    """Two thirds of all rows belong to key 0."""
    key = F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7)
    df = spark.range(n).select(key.alias("k"), "id", hash_uniform(F.lit(1), "id").alias("v"))
    return df.withColumn("step", F.row_number().over(W.partitionBy("k").orderBy("id")) - 1).withColumn(
        "v", F.when(F.col("id") % 11 > 0, F.col("v")))


@pytest.mark.parametrize("rows", [7, 100000])
def test_prefix_scan_equals_windows(spark, rows):
    df = skewed(spark)
    out = S.prefix_scan(df, ["k"], [F.asc("step")], S.step_block("step", rows), {
        "m": S.running_max("v", inclusive=False), "s": S.running_sum("v"), "c": S.running_count(), "l": S.running_last("v"), "p": S.previous("v")})
    w = W.partitionBy("k").orderBy("step")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    bad = out.withColumns({"m2": F.max("v").over(before), "s2": F.sum("v").over(upto), "c2": F.row_number().over(w),
                           "l2": F.last("v", True).over(upto), "p2": F.lag("v").over(w)}).where(~(
                               F.col("m").eqNullSafe(F.col("m2")) & F.coalesce(F.abs(F.col("s") - F.col("s2")) < 1e-9, F.col("s").isNull() & F.col("s2").isNull()) & (F.col("c") == F.col("c2"))
                               & F.col("l").eqNullSafe(F.col("l2")) & F.col("p.v").eqNullSafe(F.col("p2"))))
    assert out.count() == 3000 and bad.count() == 0


def test_prefix_scan_backwards(spark):
    out = S.prefix_scan(skewed(spark), ["k"], [F.desc("step")], S.step_block("step", 10), {"n": S.previous("v")}, backwards=True)
    out = out.withColumn("want", F.lead("v").over(W.partitionBy("k").orderBy("step")))
    assert out.where(~F.col("n.v").eqNullSafe(F.col("want"))).count() == 0


@pytest.mark.parametrize("accuracy", [10000, 100])
def test_exact_percentiles(spark, accuracy):
    """Also with a coarse sketch; many ties, one hot key."""
    df = skewed(spark, 9000).withColumn("v", F.when(F.col("id") % 5 == 0, F.lit(0.5)).otherwise(F.col("v")))
    probs = {"a": 0.5, "b": 0.95, "c": 0.1, "d": 0.0, "e": 1.0}
    got = {r["k"]: [r[n] for n in probs] for r in Q.exact_percentiles(df, ["k"], "v", probs, accuracy).collect()}
    want = df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs.values()])).alias("q")).collect()
    for r in want:
        assert np.allclose(got[r["k"]], r["q"], atol=1e-12)
    total = Q.exact_percentiles(df, [], "v", {"m": 0.5}, accuracy).first()["m"]
    assert abs(total - df.agg(F.percentile("v", 0.5)).first()[0]) < 1e-12


def test_upper_median_is_not_interpolated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert Q.upper_median(df, [], "v").first()[0] == 3.0


def test_rank_no_ties_with_ties(spark):
    df = skewed(spark).withColumn("x", F.col("id") % 3)
    out = L.rank_no_ties(df, ["k"], "x", "id")
    out = out.withColumn("want", F.row_number().over(W.partitionBy("k").orderBy("x", "id")) - 1)
    assert out.where("rank <> want").count() == 0


def test_nearest_event_brute_force(spark):
    rng = np.random.default_rng(3)
    starts = [(i % 2, float(x), i) for i, x in enumerate(rng.uniform(0, 100, 60))] + [(1, 50.0, 99)]
    events = [(i % 2, float(x)) for i, x in enumerate(rng.uniform(0, 100, 40))] + [(1, 49.0), (1, 51.0)]
    out = J.nearest_event(spark.createDataFrame(starts, "k int, t double, id int"), spark.createDataFrame(events, "k int, e double"),
                          ["k"], "t", "e", 1.5, width=10.0)
    for r in out.collect():
        near = min((abs(e - r["t"]), e) for k, e in events if k == r["k"])
        want = near[1] if near[0] <= 1.5 else r["t"]
        assert r["snapped_sec"] == want


def test_interval_join_brute_force(spark):
    pts = [(0, i * 0.7) for i in range(100)]
    secs = [(0, 3.0, 20.0, "a"), (0, 20.0, 21.0, "b"), (0, 40.0, 69.0, "c")]
    out = J.assign_sections(spark.createDataFrame(pts, "song int, t_sec double"),
                            spark.createDataFrame(secs, "song int, start_sec double, end_sec double, label string"), width=5.0).collect()
    assert len(out) == 100
    for r in out:
        assert r["label"] == next((s[3] for s in secs if s[1] <= r["t_sec"] < s[2]), None)


def test_distribution_functions(spark):
    r = spark.range(1).select(
        ST.norm_cdf(F.lit(1.96)).alias("n"), ST.norm_cdf(F.lit(-1.0)).alias("m"), ST.t_cdf(F.lit(2.0), F.lit(5)).alias("t5"),
        ST.t_cdf(F.lit(-2.0), F.lit(6)).alias("t6"), ST.t_ppf(0.975, F.lit(21)).alias("q"), ST.binom_tail_half(F.lit(60), F.lit(100)).alias("b"),
        ST.binom_tail_half(F.lit(3), F.lit(5)).alias("h"), ST.t_cdf(F.lit(None).cast("double"), F.lit(5)).alias("null")).first()
    want = {"n": 0.9750021048517795, "m": 0.15865525393145707, "t5": 0.9490302605850709, "t6": 0.0462131557657659, "q": 2.0796138447276626,
            "b": 0.02844396682049039, "h": 0.5}
    for k, v in want.items():
        assert abs(r[k] - v) < 1e-9, k
    assert r["null"] is None


def test_nan_is_never_accepted(spark):
    log = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, float("nan"), 2.0, 2.0, 3.0])], "song int, step bigint, reward double")
    got = [r["accepted"] for r in L.replay_acceptance(log, 1.0).orderBy("step").collect()]
    assert got == [False, False, True, False, True]


def test_replay_is_independent_of_partitioning_and_prefixes(spark):
    log = skewed(spark).select(F.col("k").alias("song"), "step", F.col("v").alias("reward"))
    a = L.replay_acceptance(log, 0.2)
    b = L.replay_acceptance(log.repartition(7), 0.2)
    assert a.exceptAll(b.select(*a.columns)).count() == 0
    curve = L.budget_curve(a, [10, 100, 10 ** 9], 0.2).where("budget = 1000000000")
    final = a.groupBy("song").agg(F.greatest(F.lit(0.2), F.max("reward")).alias("best"), F.count_if("accepted").alias("n_accepted"))
    assert curve.select("song", "best", "n_accepted").exceptAll(final).count() == 0


def test_dedupe_ignores_resends(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5), ("", 1, 7), ("", 2, 8)], "pid string, seq int, v int")
    assert {(r["pid"], r["v"]) for r in L.dedupe_last(df.where("pid <> ''"), ["pid"], ["seq"]).collect()} == {("a", 20), ("b", 5)}
    first = L.dedupe_first(df, "pid", ["seq"])
    assert sorted((r["pid"], r["v"], r["blank_id"]) for r in first.collect()) == [("", 7, True), ("", 8, True), ("a", 10, False), ("b", 5, False)]


def test_t_and_binomial_keep_their_digits():
    import math
    from fractions import Fraction

    import numpy as np
    t = np.array([0.0, 1e-3, 0.5, 1.0, 3.0, 50.0, 1e4, 1e8])
    assert np.allclose(ST.t_tail(t, np.ones(8)), np.arctan2(1, t) / math.pi, rtol=1e-11, atol=0)
    root = np.sqrt(2 + t * t)
    assert np.allclose(ST.t_tail(t, np.full(8, 2.0)), 1 / (root * (root + t)), rtol=1e-11, atol=0)
    for df, rtol in ((1e6, 1e-10), (1e9, 1e-12)):  # the normal tail with Fisher's first terms
        for x in (0.5, 2.0, 5.0):
            g = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
            want = math.erfc(x / math.sqrt(2)) / 2 + g * ((x**3 + x) / (4 * df) + (3 * x**7 - 7 * x**5 - 5 * x**3 - 3 * x) / (96 * df**2))
            assert math.isclose(ST.t_tail(np.array([x]), np.array([df]))[0], want, rel_tol=rtol)
    assert np.allclose(ST._t_quantile(0.9999, np.array([1.0])), math.tan(math.pi * 0.4999), rtol=1e-9)
    for p in (0.6, 0.975, 1 - 1e-9, 1 - 1e-12):
        df = np.array([1.0, 2.0, 3.0, 7.0, 64.0, 65.0, 1e5, 1e9])
        assert np.allclose(ST.t_tail(ST._t_quantile(p, df), df), 1 - p, rtol=1e-10, atol=0)
        assert np.allclose(ST._t_quantile(1 - p, df), -ST._t_quantile(p, df), rtol=1e-3)
    for k, m in ((0, 5), (6, 5), (3, 5), (5, 5), (60, 100), (450, 1000), (700, 1000), (5200, 10000)):
        want = float(Fraction(sum(math.comb(m, i) for i in range(k, m + 1)), 2**m))
        assert math.isclose(ST._binom_tail(k, m), want, rel_tol=1e-11)


def test_percentiles_of_small_and_large_groups(spark):
    import numpy as np
    from scoreloom.operators.quantiles import exact_percentiles
    sizes = {0: 1, 1: 2, 2: 3, 3: 4, 4: 7, 5: 10, 6: 11, 7: 100, 8: 999, 9: 40_000}
    rows = [(g, float((i * 7919) % n) ** 1.5 if g % 3 else float(i % 3)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.9, "f": 0.975, "h": 1.0}
    for accuracy in (100_000, 200):  # with the coarse sketch the brackets of the large groups hold few of their values
        got = {r.g: r for r in exact_percentiles(df, ["g"], "v", probs, accuracy).collect()}
        for g in sizes:
            want = np.quantile([v for k, v in rows if k == g], list(probs.values()))
            assert np.allclose([got[g][n] for n in probs], want)
    assert exact_percentiles(df.where("g < 0"), [], "v", {"m": 0.5}).count() == 0
