"""Inference queries."""

from pyspark.sql import functions as F

from scoreloom.operators import inference as I
from scoreloom.operators import joins as J
from scoreloom.plans.q_aggregates import r6
from scoreloom.plans.q_joins import AFC, CELLS, GRID, afc, cells, grid
from scoreloom.plans.registry import query


def sql_norm_sf(x: str) -> str:
    """1 - Phi(x) for x >= 0, from the same integral in gamma-function form."""
    series = (f"list_sum(list_transform(range(0, 160), lambda j: exp((2 * j + 1) * ln({x}) - (j + 1) * ln(2) - lgamma(j + 1.5) + ln(pi()) / 2)))")
    return f"CASE WHEN {x} = 0 THEN 0.5 WHEN {x} > 8 THEN 0.0 ELSE 0.5 - exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {series} END"


def sql_t_cdf(t: str, df: str) -> str:
    th = f"atan(({t}) / sqrt({df}))"
    odd = (f"coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 "
           f"* pow(cos({th}), 2 * j))), 0)")
    even = (f"coalesce(list_sum(list_transform(range(0, {df} // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) "
            f"* pow(cos({th}), 2 * j))), 0)")
    return (f"CASE WHEN {df} % 2 = 1 THEN 0.5 + ({th} + sin({th}) * cos({th}) * {odd}) / pi() ELSE 0.5 + 0.5 * sin({th}) * {even} END")


def sql_t_ppf(name: str, p: float, source: str) -> str:
    """Recursive bisection for the quantile of every df in ``source`` (column df)."""
    cdf = sql_t_cdf("(lo + hi) / 2", "df")
    return (f"{name}_b(df, lo, hi, i) AS (SELECT DISTINCT df, -1000.0::DOUBLE, 1000.0::DOUBLE, 0 FROM {source} UNION ALL "
            f"SELECT df, CASE WHEN c < {p} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN c < {p} THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM "
            f"(SELECT *, {cdf} AS c FROM {name}_b WHERE i < 60)), {name} AS (SELECT df, (lo + hi) / 2 AS q FROM {name}_b WHERE i = 60)")


CON = [("c1", "RF", "AF", "noninf", "primary_noninf"), ("c2", "AF", "NO", "greater", "primary"), ("c3", "NO", "NF", "greater", "primary"),
       ("c4", "RF", "NF", "two", "secondary"), ("c5", "RF", "XX", "none", "check")]
PAIR = """pr AS (SELECT a.song, a.pq AS pa, b.pq AS pb, a.sb AS sa, b.sb AS sbb FROM song_arms a JOIN song_arms b ON a.song = b.song
          WHERE a.run = '1-URGENT' AND b.run = '5-LOW')"""
ARMS = ["arms", "song_arms"]


def pairs(t):
    s = t.song_arms()
    return J.pair_arms(s.where("run = '1-URGENT'"), s.where("run = '5-LOW'"), ["song"], ["pq", "sb"])


@query("paired_contrast", f"""WITH {PAIR} SELECT 'low-urgent' AS label, count(*) AS n, round(avg(pb - pa), 6) AS d_pq_mean,
    round(avg((pb > pa)::INT), 6) AS pq_win, round(avg(sbb - sa), 6) AS d_sb_mean, round(avg((sbb > sa)::INT), 6) AS sb_win FROM pr""", ARMS)
def paired_contrast(t):
    out = I.paired_contrast(pairs(t).withColumn("label", F.lit("low-urgent")), ["label"])
    return r6(out, "d_pq_mean", "pq_win", "d_sb_mean", "sb_win")


@query("contrast_subsets", f"""WITH {PAIR}, d AS (SELECT song, max(duration) AS d FROM arms WHERE o_orderkey % 3 = 0 GROUP BY 1),
    x AS (SELECT pr.*, d FROM pr LEFT JOIN d ON pr.song = d.song), y AS (SELECT 'all' AS subset, * FROM x UNION ALL SELECT 'short', * FROM x WHERE d <= 300)
    SELECT 'l' AS label, subset, count(*) AS n, round(avg(pb - pa), 6) AS d_pq_mean, round(avg((pb > pa)::INT), 6) AS pq_win,
      (SELECT count(*) FROM x WHERE d IS NULL) AS n_unknown_duration FROM y GROUP BY subset""", ARMS)
def contrast_subsets(t):
    dur = t.arms().where("o_orderkey % 3 = 0").groupBy("song").agg(F.max("duration").alias("duration"))
    out = I.contrast_subsets(pairs(t).withColumn("label", F.lit("l")), dur, ["label"], metrics=["pq"])
    return r6(out, "d_pq_mean", "pq_win")


@query("wilcoxon_signed_rank", f"""WITH {PAIR}, d AS (SELECT 'pq' AS metric, round(pb - pa, 12) AS d FROM pr UNION ALL
      SELECT 'sb', round(sbb - sa, 12) FROM pr),
    r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2.0::DOUBLE AS rk,
      count(*) OVER (PARTITION BY metric, abs(d)) AS c FROM d WHERE d <> 0),
    s AS (SELECT metric, count(*) AS n, sum(rk) FILTER (d > 0) AS w_plus, sum(c * c - 1.0::DOUBLE) AS ties FROM r GROUP BY 1),
    z AS (SELECT *, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1.0::DOUBLE) * (2 * n + 1) / 24 - ties / 48) AS z FROM s)
    SELECT metric, n, w_plus, round(z, 6) AS z, round(2 * ({sql_norm_sf('abs(z)')}), 8) AS p_two,
      round(CASE WHEN z < 0 THEN 1 - ({sql_norm_sf('abs(z)')}) ELSE {sql_norm_sf('abs(z)')} END, 8) AS p_greater FROM z""", ARMS)
def wilcoxon(t):
    rows = F.array(F.struct(F.lit("pq").alias("metric"), (F.col("pq_b") - F.col("pq_a")).alias("d")),
                   F.struct(F.lit("sb").alias("metric"), (F.col("sb_b") - F.col("sb_a")).alias("d")))
    out = I.wilcoxon_signed_rank(pairs(t).select(F.inline(rows)), ["metric"], "d")
    return r6(r6(out, "z"), "p_two", "p_greater", digits=8)


@query("complete_screens", """SELECT listener, song, condition, screen, score FROM ratings r JOIN (SELECT listener, song FROM ratings GROUP BY 1, 2
    HAVING count(DISTINCT condition) = 4) f USING (listener, song)""", ["ratings"])
def complete_screens(t):
    return I.complete_screens(t.ratings(), 4).select("listener", "song", "condition", "screen", "score")


DIFF = """cell AS (SELECT listener, song, condition, avg(score) AS m, min(screen) AS screen FROM ratings GROUP BY 1, 2, 3),
    cons AS (SELECT unnest(['c1', 'c2', 'c3', 'c4']) AS contrast, unnest(['RF', 'AF', 'NO', 'RF']) AS a, unnest(['AF', 'NO', 'NF', 'NF']) AS b),
    scr AS (SELECT listener, song, min(screen) AS screen FROM ratings WHERE condition IN ('RF', 'AF', 'NO', 'NF') GROUP BY 1, 2),
    d AS (SELECT contrast, x.listener, x.song, x.m - y.m AS d, scr.screen FROM cons JOIN cell x ON x.condition = a JOIN cell y ON y.condition = b
      AND x.listener = y.listener AND x.song = y.song JOIN scr ON scr.listener = x.listener AND scr.song = x.song)"""
CROSS = f"""{DIFF}, ml AS (SELECT contrast, listener, avg(d) AS ml FROM d GROUP BY 1, 2), ms AS (SELECT contrast, song, avg(d) AS ms FROM d GROUP BY 1, 2),
    mm AS (SELECT contrast, avg(d) AS mu, count(*) AS n FROM d GROUP BY 1),
    rs AS (SELECT d.contrast, stddev_samp(d.d - ml - ms + mu) AS sigma FROM d JOIN ml ON ml.contrast = d.contrast AND ml.listener = d.listener
      JOIN ms ON ms.contrast = d.contrast AND ms.song = d.song JOIN mm ON mm.contrast = d.contrast GROUP BY 1),
    tl AS (SELECT contrast, count(*) AS L, stddev_samp(ml) AS tau_l, avg(ml) AS mml FROM ml GROUP BY 1),
    tsg AS (SELECT contrast, count(*) AS S, stddev_samp(ms) AS tau_s FROM ms GROUP BY 1),
    cr AS (SELECT mm.contrast, n, L, S, mu, mml, tau_l, tau_s, sigma, sqrt(tau_l * tau_l / L + tau_s * tau_s / S + sigma * sigma / (L * 9.0::DOUBLE))
      AS se, tau_l / sqrt(L) AS se_listener, CAST(greatest(least(L, S) - 1, 2) AS INT) AS df FROM mm JOIN tl ON tl.contrast = mm.contrast
      JOIN tsg ON tsg.contrast = mm.contrast JOIN rs ON rs.contrast = mm.contrast)"""


def diffs(t):
    return I.screen_differences(t.ratings(), CON, order="screen")


def crossed(t):
    return I.crossed_contrast(diffs(t), 9.0)


@query("screen_differences", f"WITH {DIFF} SELECT contrast, listener, song, round(d, 6) AS d FROM d", ["ratings"])
def screen_differences(t):
    return r6(diffs(t), "d").select("contrast", "listener", "song", "d")


@query("crossed_contrast", f"""WITH {CROSS} SELECT contrast, n, L, S, round(mu, 6) AS mu, round(tau_l, 6) AS tau_l, round(tau_s, 6) AS tau_s,
    round(sigma, 6) AS sigma, round(se, 6) AS se, round(se_listener, 6) AS se_listener, round({sql_norm_sf('(abs(mu) / se)')}, 8) AS p_one,
    round(2 * ({sql_norm_sf('(abs(mml) / se_listener)')}), 8) AS p_listener,
    n < 8 AS too_few_pairs FROM cr""", ["ratings"])
def crossed_contrast(t):
    out = r6(crossed(t), "mu", "tau_l", "tau_s", "sigma", "se", "se_listener")
    return r6(out, "p_one", "p_listener", digits=8)


@query("crossed_components", f"""WITH {DIFF}, c AS (SELECT contrast, listener, song, count(*) AS k, sum(d) AS t, sum(d * d) AS q FROM d GROUP BY 1, 2, 3),
    l AS (SELECT contrast, count(*) AS g, sum(t * t / n) AS tt, sum(n * n) AS nn, sum(c / n) AS k FROM (SELECT contrast, listener, sum(k) AS n,
      sum(t) AS t, sum(k * k) AS c FROM c GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT contrast, count(*) AS g, sum(t * t / n) AS tt, sum(n * n) AS nn, sum(c / n) AS k FROM (SELECT contrast, song, sum(k) AS n,
      sum(t) AS t, sum(k * k) AS c FROM c GROUP BY 1, 2) GROUP BY 1),
    m AS (SELECT contrast, CAST(sum(k) AS DOUBLE) AS n0, sum(t) AS t, sum(q) AS q FROM c GROUP BY 1),
    e AS (SELECT m.contrast, n0 AS n, m.t / n0 AS mu, n0 - l.nn / n0 AS a1, s.k - l.nn / n0 AS a2, l.nn / n0 - s.k AS a3, l.k - s.nn / n0 AS b1, n0 - s.nn / n0 AS b2,
      s.nn / n0 - l.k AS b3, l.g - 1 AS c1, s.g - 1 AS c2, n0 - l.g - s.g + 1 AS c3, l.tt - m.t * m.t / n0 AS r1, s.tt - m.t * m.t / n0 AS r2,
      q - l.tt - s.tt + m.t * m.t / n0 AS r3 FROM m JOIN l ON l.contrast = m.contrast JOIN s ON s.contrast = m.contrast),
    f AS (SELECT *, a1 * (b2 * c3 - b3 * c2) - b1 * (a2 * c3 - a3 * c2) + c1 * (a2 * b3 - a3 * b2) AS det FROM e)
    SELECT contrast, CAST(n AS BIGINT) AS n, round(mu, 6) AS mu,
      round(sqrt(greatest(0, (r1 * (b2 * c3 - b3 * c2) - b1 * (r2 * c3 - r3 * c2) + c1 * (r2 * b3 - r3 * b2)) / det)), 5) AS sd_listener,
      round(sqrt(greatest(0, (a1 * (r2 * c3 - r3 * c2) - r1 * (a2 * c3 - a3 * c2) + c1 * (a2 * r3 - a3 * r2)) / det)), 5) AS sd_song,
      round(sqrt(greatest(0, (a1 * (b2 * r3 - b3 * r2) - b1 * (a2 * r3 - a3 * r2) + r1 * (a2 * b3 - a3 * b2)) / det)), 5) AS sd_resid
    FROM f""", ["ratings"])
def crossed_components(t):
    return r6(r6(I.crossed_components(diffs(t)), "mu"), "sd_listener", "sd_song", "sd_resid", digits=5)


TT = f"""WITH RECURSIVE {CROSS}, {sql_t_ppf('q975', 0.975, 'cr')}, {sql_t_ppf('q95', 0.95, 'cr')},
    tt AS (SELECT cr.*, mu / se AS t, {sql_t_cdf('mu / se', 'cr.df')} AS p_less, {sql_t_cdf('abs(mu) / se', 'cr.df')} AS pa, q975.q * se AS h95,
      q95.q * se AS h90, {sql_t_cdf('(mu + 10) / se', 'cr.df')} AS pn FROM cr JOIN q975 ON q975.df = cr.df JOIN q95 ON q95.df = cr.df)"""


@query("t_tests", f"""{TT} SELECT contrast, df, round(t, 6) AS t, round(1 - p_less, 8) AS p_greater, round(p_less, 8) AS p_less,
    round(2 * (1 - pa), 8) AS p_two, round(mu - h95, 6) AS ci95_lo, round(mu + h95, 6) AS ci95_hi, round(mu - h90, 6) AS ci90_lo,
    round(mu + h90, 6) AS ci90_hi FROM tt""", ["ratings"])
def t_tests(t):
    out = r6(I.t_tests(crossed(t)), "t", "ci95_lo", "ci95_hi", "ci90_lo", "ci90_hi")
    return r6(out, "p_greater", "p_less", "p_two", digits=8).select(
        "contrast", "df", "t", "p_greater", "p_less", "p_two", "ci95_lo", "ci95_hi", "ci90_lo", "ci90_hi")


@query("noninferiority", f"""{TT} SELECT contrast, 10.0::DOUBLE AS noninf_margin, round((mu + 10) / se, 6) AS t_noninf, round(1 - pn, 8) AS p_noninf,
    round(mu - h90, 6) AS ci95_lower, mu - h90 > -10 AS noninferior FROM tt""", ["ratings"])
def noninferiority(t):
    out = I.noninferiority(I.t_tests(crossed(t)), 10.0)
    return r6(r6(out, "t_noninf", "ci95_lower"), "p_noninf", digits=8).select(
        "contrast", "noninf_margin", "t_noninf", "p_noninf", "ci95_lower", "noninferior")


@query("tost", f"""{TT} SELECT contrast, mu - h95 > -1 AND mu + h95 < 1 AS equivalent_95, mu - h90 > -1 AND mu + h90 < 1 AS equivalent_90
    FROM tt""", ["ratings"])
def tost(t):
    return I.tost(I.t_tests(crossed(t)), -1.0, 1.0).select("contrast", "equivalent_95", "equivalent_90")


@query("order_slope", f"WITH {DIFF} SELECT contrast, round(regr_slope(d, screen), 6) AS order_slope FROM d GROUP BY 1", ["ratings"])
def order_slope(t):
    return r6(I.order_slope(diffs(t), "screen"), "order_slope")


PS = """ps AS (SELECT l_returnflag AS family, l_linenumber AS test, avg(l_tax) * avg(l_discount) * 10 * l_linenumber AS p FROM lineitem GROUP BY 1, 2)"""


@query("holm", f"""WITH {PS}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) - 1 AS i, count(*) OVER (PARTITION BY family) AS m FROM ps)
    SELECT family, test, round(p, 8) AS p, round(least(1, max((m - i) * p) OVER (PARTITION BY family ORDER BY p, test)), 8) AS p_holm FROM r""")
def holm(t):
    ps = t.lineitem.groupBy(F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("test")).agg(
        F.avg("l_tax").alias("a"), F.avg("l_discount").alias("b"))
    ps = ps.select("family", "test", (F.col("a") * F.col("b") * 10 * F.col("test")).alias("p"))
    return r6(I.holm(ps, "p", ["family"], "test"), "p", "p_holm", digits=8)


@query("primary_family", f"""{TT}, f AS (SELECT contrast, CASE contrast WHEN 'c1' THEN 'noninf' ELSE 'greater' END AS side,
      CASE contrast WHEN 'c1' THEN 1 - pn ELSE 1 - p_less END AS p FROM tt WHERE contrast <> 'c4'),
    r AS (SELECT *, row_number() OVER (ORDER BY p, contrast) - 1 AS i FROM f),
    h AS (SELECT *, least(1, max((3 - i) * p) OVER (ORDER BY p, contrast)) AS ph FROM r)
    SELECT contrast, side, round(p, 8) AS p_raw, round(ph, 8) AS p_holm, ph < 0.05 AS significant,
      CASE contrast WHEN 'c2' THEN 'demoted' ELSE '' END AS note FROM h""", ["ratings"])
def primary_family(t):
    res = I.noninferiority(I.t_tests(crossed(t)), 10.0)
    return r6(I.primary_family(res, CON, 3, demote=["c2"]), "p_raw", "p_holm", digits=8)


@query("preference_rate", f"""WITH RECURSIVE {AFC}, r AS (SELECT listener, avg((choice = 'proposed')::INT) AS r, count(*) AS n FROM orig GROUP BY 1),
    s AS (SELECT count(*) AS nl, CAST(sum(n) AS BIGINT) AS nt, avg(r) AS m, stddev_samp(r) AS sd, CAST(count(*) - 1 AS INT) AS df FROM r),
    {sql_t_ppf('q', 0.975, 's')}
    SELECT nl AS n_listeners, nt AS n_trials, round(m, 6) AS rate_mean, round(sd, 6) AS rate_sd, round(m - q.q * sd / sqrt(nl), 6) AS ci_lo,
      round(m + q.q * sd / sqrt(nl), 6) AS ci_hi, m - q.q * sd / sqrt(nl) > 0.44 AND m + q.q * sd / sqrt(nl) < 0.56 AS equivalent
    FROM s JOIN q ON q.df = s.df""")
def preference_rate(t):
    return r6(I.preference_rate(afc(t), "proposed"), "rate_mean", "rate_sd", "ci_lo", "ci_hi")


@query("preference_by_song", f"WITH {AFC} SELECT song, round(avg((choice = 'proposed')::INT), 6) AS rate, count(*) AS n FROM orig GROUP BY 1")
def preference_by_song(t):
    return r6(I.preference_by_song(afc(t), "proposed"), "rate")


@query("repeat_agreement", f"""WITH {AFC} SELECT listener, round(avg((choice = original_choice)::INT), 6) AS agreement, count(*) AS n_repeats FROM rep
    WHERE original_choice IS NOT NULL GROUP BY 1""")
def repeat_agreement(t):
    return r6(I.repeat_agreement(afc(t)), "agreement")


@query("abx_accuracy", f"""WITH RECURSIVE a AS (SELECT doc_id % 20 AS listener, avg(quality) AS a, count(*) AS n, sum(quality) AS k FROM labels GROUP BY 1),
    s AS (SELECT count(*) AS nl, CAST(sum(n) AS BIGINT) AS nt, CAST(sum(k) AS BIGINT) AS nc, avg(a) AS m, stddev_samp(a) AS sd,
      CAST(count(*) - 1 AS INT) AS df FROM a), {sql_t_ppf('q', 0.975, 's')}
    SELECT nl AS n_listeners, nt AS n_trials, nc AS n_correct, round(m, 6) AS accuracy, round(m - q.q * sd / sqrt(nl), 6) AS ci_lo,
      round(m + q.q * sd / sqrt(nl), 6) AS ci_hi, round((SELECT sum(exp(lgamma(nt + 1) - lgamma(i + 1) - lgamma(nt - i + 1) - nt * ln(2)))
      FROM range(0, nt + 1) r(i) WHERE i >= nc), 8) AS p_binom, m <= 0.6 AS demote FROM s JOIN q ON q.df = s.df""")
def abx_accuracy(t):
    abx = t.labels.select((F.col("doc_id") % 20).alias("listener"), (F.col("quality") == 1).alias("correct"))
    return r6(r6(I.abx_accuracy(abx), "accuracy", "ci_lo", "ci_hi"), "p_binom", digits=8)


@query("metric_vs_human", """WITH h AS (SELECT l.doc_id AS item, quality + n_chars / 1e6 AS value, n_chars, length(text) % 97 AS x, toxic FROM labels l JOIN
      documents d ON d.doc_id = l.doc_id),
    a AS (SELECT item, 'chars' AS metric, n_chars * 1.0::DOUBLE AS score, value FROM h UNION ALL SELECT item, 'mod', x, value FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score, item) AS ra, row_number() OVER (PARTITION BY metric ORDER BY value, item)
      AS rh FROM a)
    SELECT metric, count(*) AS n, round(corr(ra, rh), 6) AS spearman, round(corr(score, value), 6) AS pearson FROM r GROUP BY 1""")
def metric_vs_human(t):
    h = t.labels.join(t.documents, "doc_id").select(
        F.col("doc_id").alias("item"), (F.col("quality") + F.col("n_chars") / 1e6).alias("value"), "n_chars",
        (F.length("text") % 97).alias("x"), "toxic")
    rows = F.array(F.struct(F.lit("chars").alias("metric"), F.col("n_chars").cast("double").alias("score")),
                   F.struct(F.lit("mod").alias("metric"), F.col("x").cast("double").alias("score")))
    auto = h.select("item", F.inline(rows))
    part = h.where("toxic = 0").select("item", F.lit("partial").alias("metric"), F.lit(1.0).alias("score"))
    return r6(I.metric_vs_human(auto.unionByName(part), h.select("item", "value")), "spearman", "pearson")


@query("rater_agreement", f"""WITH {CELLS}, p AS (SELECT a.listener AS rater_a, b.listener AS rater_b, row_number() OVER (PARTITION BY a.listener, b.listener
      ORDER BY a.score, a.item) AS ra, row_number() OVER (PARTITION BY a.listener, b.listener ORDER BY b.score, a.item) AS rb FROM cells a JOIN cells b
      ON a.item = b.item AND a.listener < b.listener)
    SELECT rater_a, rater_b, count(*) AS n_shared, round(corr(ra, rb), 6) AS rho FROM p GROUP BY 1, 2 HAVING count(*) >= 3""", ["ratings"])
def rater_agreement(t):
    return r6(I.rater_agreement(cells(t), "listener", "item", "score"), "rho")


@query("shapley", f"""WITH {GRID} SELECT e AS element, round(sum(CASE bit_count(a.mask) WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 2 END / 6.0::DOUBLE *
    (b.value - a.value)), 6) AS shapley FROM grid a, (SELECT unnest([0, 1, 2]) AS e) x, grid b WHERE (a.mask & (1 << e)) = 0
    AND b.mask = a.mask + (1 << e) GROUP BY 1""")
def shapley(t):
    return r6(I.shapley(grid(t), 3), "shapley")
