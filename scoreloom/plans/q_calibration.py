"""Calibration and reward queries."""

from pyspark.sql import functions as F

from scoreloom.operators import calibration as C
from scoreloom.plans.q_aggregates import r6
from scoreloom.plans.registry import query
from scoreloom.session import spread

CAL, Z = ["pool", "calib"], ["pool", "calib", "zpool"]
STATS = ("pq_mean", "pq_std_measured", "pq_std", "sb_mean", "sb_std_measured", "sb_std")


@query("fit_calibration", f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in STATS)}) FROM calib", CAL)
def fit_calibration(t):
    return r6(t.calib(), *STATS)


SMALL = """small AS (SELECT *, CASE WHEN sb_std_measured < 0.316 THEN true ELSE false END AS f FROM calib)"""


def floored(t):
    return C.fit_calibration(t.pool(), ["song"], floors={"sb": 0.316})


@query("guard_reliable", f"WITH {SMALL} SELECT song, NOT f AND n_samples >= 600 AS reliable FROM small", CAL)
def guard_reliable(t):
    return floored(t).select("song", C.guard_reliable("sb", 600).alias("reliable"))


@query("warn_weak_calibration", f"""WITH {SMALL} SELECT song, concat_ws(',', CASE WHEN n_samples < 600 THEN 'few_samples' END,
    CASE WHEN f THEN 'sb_floored' END, CASE WHEN pq_floored THEN 'pq_floored' END) AS warnings FROM small""", CAL)
def warn_weak(t):
    return floored(t).select("song", F.array_join(C.warn_weak_calibration(600), ",").alias("warnings"))


@query("zscore", "SELECT song, pq, sb, round(z_pq, 6) AS z_pq, round(z_sb, 6) AS z_sb FROM zpool", Z)
def zscore(t):
    return r6(t.zpool(), "z_pq", "z_sb")


FORMS = [("reward_min", "least(z_pq, z_sb)", C.reward_min),
         ("reward_weighted", "0.3 * z_pq + 0.7 * z_sb", lambda: C.reward_weighted(w=0.3)),
         ("reward_penalized", "z_pq - 0.5 * abs(z_pq - z_sb)", C.reward_penalized),
         ("reward_single", "z_sb", lambda: C.reward_single("sb"))]


def reward_counts(t, form):
    r = t.zpool().select("song", F.round(form(), 6).alias("r"))
    return spread(r, t.lineitem.count(), "song", "r").groupBy("song", "r").agg(F.count("*").alias("n"))


for _name, _sql, _form in FORMS:
    query(_name, f"SELECT song, round({_sql}, 6) AS r, count(*) AS n FROM zpool GROUP BY 1, 2", Z)(
        lambda t, form=_form: reward_counts(t, form))


@query("reward_forms", """SELECT song, round(avg(least(z_pq, z_sb)), 6) AS min, round(avg((z_pq + z_sb) / 2), 6) AS mean,
    round(avg(z_pq - 0.25 * abs(z_pq - z_sb)), 6) AS penalized, round(max(z_pq), 6) AS pq_only, round(max(z_sb), 6) AS sb_only
    FROM zpool GROUP BY 1""", Z)
def reward_forms(t):
    agg = [F.avg(C.reward("min")).alias("min"), F.avg(C.reward("mean")).alias("mean"),
           F.avg(C.reward("penalized", lam=0.25)).alias("penalized"), F.max(C.reward("pq_only")).alias("pq_only"),
           F.max(C.reward("sb_only")).alias("sb_only")]
    return r6(t.zpool().groupBy("song").agg(*agg), "min", "mean", "penalized", "pq_only", "sb_only")


@query("rescore", """WITH m AS (SELECT l_suppkey AS song, l_returnflag AS method, avg(l_quantity) / 10 AS pq, avg(l_discount) * 10 AS sb
    FROM lineitem GROUP BY 1, 2) SELECT m.song, method, round(least((m.pq - pq_mean) / pq_std, (m.sb - sb_mean) / sb_std), 6) AS reward
    FROM m JOIN calib c ON m.song = c.song""", CAL)
def rescore(t):
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("song"), F.col("l_returnflag").alias("method")).agg(
        (F.avg("l_quantity") / 10).alias("pq"), (F.avg("l_discount") * 10).alias("sb"))
    return r6(C.rescore(m, t.calib(), ["song"]).select("song", "method", "reward"), "reward")


LOGZ = """lc AS (SELECT song, avg(pq) AS pm, greatest(stddev_pop(pq), 0.05) AS ps, avg(sb) AS sm, greatest(stddev_pop(sb), 0.05) AS ss
      FROM search_log GROUP BY 1),
    lz AS (SELECT l.song, l.step, (pq - pm) / ps AS z_pq, (sb - sm) / ss AS z_sb FROM search_log l JOIN lc ON l.song = lc.song),
    lr AS (SELECT *, least(z_pq, z_sb) > greatest(0.0, coalesce(max(least(z_pq, z_sb)) OVER (PARTITION BY song ORDER BY step
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS accepted FROM lz)"""


def z_log(t):
    from scoreloom.operators.logs import replay_acceptance
    log = t.search_log().select("song", "step", "pq", "sb")
    z = C.zscore(log, C.fit_calibration(log, ["song"]), ["song"])
    return replay_acceptance(z.withColumn("reward", C.reward("min")), init=0.0)


@query("binding_axis", f"""WITH {LOGZ} SELECT song, count(*) AS n_accepted, round(avg((z_sb < z_pq)::INT), 6) AS sb_share,
    round(avg((z_sb >= z_pq)::INT), 6) AS pq_share FROM lr WHERE accepted GROUP BY 1""", ["search_log"])
def binding_axis(t):
    return r6(C.binding_axis(z_log(t), ["song"]), "sb_share", "pq_share")


@query("veto_share", f"""WITH {LOGZ}, s AS (SELECT *, coalesce(last_value(CASE WHEN accepted THEN z_pq END IGNORE NULLS) OVER w, 0) AS sp,
      coalesce(last_value(CASE WHEN accepted THEN z_sb END IGNORE NULLS) OVER w, 0) AS ss FROM lr
      WINDOW w AS (PARTITION BY song ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT song, z_pq > sp AS one, least(z_pq, z_sb) > least(sp, ss) AS low FROM s)
    SELECT song, count(*) FILTER (one) AS n_axis, count(*) FILTER (one AND NOT low) AS n_vetoed, count(*) FILTER (low) AS n_min,
      count(*) FILTER (low AND NOT one) AS n_driven,
      round(count(*) FILTER (one AND NOT low) / nullif(count(*) FILTER (one), 0), 6) AS veto_share,
      round(count(*) FILTER (low AND NOT one) / nullif(count(*) FILTER (low), 0), 6) AS driven_share FROM b GROUP BY 1""",
       ["search_log"])
def veto_share(t):
    return r6(C.veto_share(C.with_state_z(z_log(t), ["song"]), ["song"]), "veto_share", "driven_share")


@query("chunk_mean_score", """SELECT song, round(avg(m), 6) AS score, count(*) AS n_chunks FROM (SELECT song, floor(t_sec / 259200) AS c,
    avg(rms_db) AS m FROM frames GROUP BY 1, 2) GROUP BY 1""", ["frames"])
def chunk_mean_score(t):
    return r6(C.chunk_mean_score(t.frames(), ["song"], "t_sec", "rms_db", 259200.0), "score")


@query("floor_rate", f"""SELECT 'pq' AS metric, count(*) AS n, round(avg(pq_floored::INT), 6) AS floor_rate,
      round(quantile_cont(pq_std, 0.5), 6) AS median_std FROM calib
    UNION ALL SELECT 'sb', count(*), round(avg((sb_std_measured < 0.316)::INT), 6),
      round(quantile_cont(greatest(sb_std_measured, 0.316), 0.5), 6) FROM calib""", CAL)
def floor_rate(t):
    return r6(C.floor_rate(floored(t)), "floor_rate", "median_std")


@query("reward", "SELECT song, pq, sb, round(0.2 * z_pq + 0.8 * z_sb, 6) AS reward FROM zpool", Z)
def reward(t):
    return r6(t.zpool().select("song", "pq", "sb", C.reward("weighted", weight=0.2).alias("reward")), "reward")
