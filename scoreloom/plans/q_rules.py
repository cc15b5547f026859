"""Rule queries."""

from pyspark.sql import functions as F

from scoreloom.functions import tables as TB
from scoreloom.operators import rules as R
from scoreloom.operators import screening as S
from scoreloom.plans.q_aggregates import PX6_CRITERIA, r6
from scoreloom.plans.registry import query

LI = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
KIND = """CASE l_linenumber WHEN 1 THEN 'static_eq' WHEN 2 THEN 'static_gain' WHEN 3 THEN 'master_limiter' WHEN 4 THEN 'static_pan'
          ELSE 'echo' END"""


def proposals(t):
    args = F.map_filter(F.create_map(
        F.lit("freq"), F.col("l_extendedprice") / 3, F.lit("gain_db"), F.col("l_quantity") - 25,
        F.lit("q"), F.when(F.col("l_tax") > 0, F.col("l_tax") * 100), F.lit("pan"), F.col("l_discount") * 20 - 1,
        F.lit("ceiling_db"), -F.col("l_quantity") / 10, F.lit("release_ms"), F.col("l_quantity") * 12),
        lambda k, v: v.isNotNull())
    return t.lineitem.select(*LI, F.expr(KIND).alias("action"), args.alias("args"),
                             F.when(F.col("l_returnflag") == "R", "vocals").otherwise(F.lower("l_linestatus")).alias("track"),
                             F.array(F.lit("vocals"), F.lit("o")).alias("tracks"))


def sql_range(v, lo, hi, name):
    return f"CASE WHEN {v} IS NULL THEN 'missing:{name}' WHEN NOT {v} BETWEEN {lo} AND {hi} THEN 'range:{name}' END"


@query("validate_actions", f"""WITH p AS (SELECT *, {KIND} AS a, CASE WHEN l_returnflag = 'R' THEN 'vocals' ELSE lower(l_linestatus)
      END AS tr, CASE WHEN l_tax > 0 THEN l_tax * 100 END AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, concat_ws(',', CASE WHEN a = 'echo' THEN 'unknown_action' END,
      CASE WHEN tr NOT IN ('vocals', 'o') THEN 'unknown_track' END,
      CASE WHEN a = 'static_eq' THEN {sql_range('l_extendedprice / 3', 20, 20000, 'freq')} END,
      CASE WHEN a = 'static_eq' THEN {sql_range('l_quantity - 25', -6, 6, 'gain_db')} END,
      CASE WHEN a = 'static_eq' THEN {sql_range('q', 0.1, 10, 'q')} END,
      CASE WHEN a = 'static_gain' THEN {sql_range('l_quantity - 25', -18, 12, 'gain_db')} END,
      CASE WHEN a = 'static_pan' THEN {sql_range('l_discount * 20 - 1', -1, 1, 'pan')} END,
      CASE WHEN a = 'master_limiter' THEN {sql_range('-l_quantity / 10', -3, -0.3, 'ceiling_db')} END,
      CASE WHEN a = 'master_limiter' THEN {sql_range('l_quantity * 12', 50, 500, 'release_ms')} END) AS reasons FROM p""")
def validate_actions(t):
    out = R.validate_actions(proposals(t), R.limits_frame(t.spark))
    return out.select(*LI, F.array_join("reasons", ",").alias("reasons"))


@query("clamp_to_limits", f"""WITH p AS (SELECT *, {KIND} AS a FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(CASE a WHEN 'static_eq' THEN greatest(-12, least(12, l_quantity - 25))
      WHEN 'static_gain' THEN greatest(-18, least(12, l_quantity - 25)) ELSE l_quantity - 25 END, 6) AS gain_db,
      round(CASE a WHEN 'static_eq' THEN greatest(20, least(20000, l_extendedprice / 3)) ELSE l_extendedprice / 3 END, 6) AS freq FROM p""")
def clamp_to_limits(t):
    out = R.clamp_to_limits(proposals(t), R.limits_frame(t.spark, "unsafe"))
    return out.select(*LI, F.round(F.element_at("args", "gain_db"), 6).alias("gain_db"),
                      F.round(F.element_at("args", "freq"), 6).alias("freq"))


@query("check_breakpoints", """WITH k AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value / 10 AS v FROM events)
    SELECT event_id, concat_ws(',', CASE WHEN k % 11 = 0 THEN 'too_few_points' END,
      CASE WHEN k % 11 > 0 AND k % 3 = 0 THEN 'time_order' END, CASE WHEN NOT v - 20 BETWEEN -18 AND 12 THEN 'value_range' END,
      CASE WHEN k >= 30 THEN 'outside_window' END) AS reasons FROM k""")
def check_breakpoints(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    v = F.col("value") / 10 - 20
    pt = lambda tt, vv: F.struct(tt.cast("double").alias("t"), vv.cast("double").alias("v"))
    pts = F.when(k % 11 == 0, F.array(pt(k, v))).otherwise(F.array(
        pt(k, v), pt(F.when(k % 3 == 0, k - 1).otherwise(k + 2), F.lit(0.0)), pt(k + 3, F.lit(1.0))))
    return t.events.select("event_id", pts.alias("breakpoints")).select(
        "event_id", F.array_join(R.check_breakpoints(window_sec=30.0), ",").alias("reasons"))


TRACK = "CASE p_size % 5 WHEN 0 THEN 'Master' WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN 'vocal' WHEN 3 THEN 'Drums' ELSE 'zz' END"
ACTION = "CASE p_size % 3 WHEN 0 THEN 'apply_static_eq' WHEN 1 THEN 'apply_reverb' ELSE 'apply_static_compressor' END"


@query("repair_track", f"""WITH p AS (SELECT p_partkey, {TRACK} AS tr, {ACTION} AS a, p_size % 5 = 0 AS pseudo FROM part),
    n AS (SELECT *, CASE WHEN lower(tr) IN ('vocal') THEN 'lead vocals' WHEN tr = 'Drums' THEN 'drums' WHEN tr = 'ring' THEN 'ring'
      ELSE 'bass' END AS near FROM p)
    SELECT p_partkey, CASE WHEN pseudo AND a = 'apply_static_eq' THEN 'apply_master_eq' WHEN pseudo AND a = 'apply_static_compressor'
      THEN 'apply_master_compressor' ELSE a END AS repaired_action,
      CASE WHEN pseudo AND a <> 'apply_reverb' THEN NULL WHEN pseudo THEN 'bass' ELSE near END AS repaired_track FROM n""")
def repair_track(t):
    p = t.part.select("p_partkey", F.expr(TRACK).alias("track"), F.expr(ACTION).alias("action"),
                      F.array(*[F.lit(x) for x in ("bass", "lead vocals", "drums", "ring")]).alias("tracks"))
    return R.repair_track(p).select("p_partkey", "repaired_action", "repaired_track")


ACT = """CASE event_type WHEN 'click' THEN 'apply_static_eq' WHEN 'view' THEN 'apply_section_gain' WHEN 'error' THEN 'score_ear'
         WHEN 'signup' THEN 'apply_gain_automation' ELSE 'unheard_of' END"""
RES = "CASE event_id % 5 WHEN 0 THEN 'global' WHEN 1 THEN 'section' WHEN 2 THEN 'short_term' WHEN 3 THEN 'momentary' END"


@query("scope_match", f"""WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'static' WHEN 'view' THEN 'section'
      WHEN 'error' THEN 'perception' WHEN 'signup' THEN 'automation' END AS scope, {RES} AS res FROM events)
    SELECT event_id, scope, scope IS NOT NULL AND (res IS NULL OR scope = 'perception' OR (res = 'global' AND scope = 'static')
      OR (res = 'section' AND scope = 'section') OR (res = 'short_term' AND scope = 'automation')) AS allowed FROM e""")
def scope_match(t):
    scopes = t.spark.createDataFrame(list(TB.ACTION_SCOPES.items()), "action string, scope string")
    allowed = t.spark.createDataFrame([(r, s) for r, ss in TB.RESOLUTION_SCOPES.items() for s in ss], "resolution string, scope string")
    e = t.events.select("event_id", F.expr(ACT).alias("action"), F.expr(RES).alias("resolution"))
    return R.scope_match(e, scopes, allowed).select("event_id", "scope", "allowed")


PC = """pc AS (SELECT song, step, lag(reward) OVER w / 60 AS p_pq, reward / 60 AS c_pq, lag(sb) OVER w / 12 AS p_cu, sb / 12 AS c_cu,
        -reward / 20 AS lufs, sb / 50 - 0.6 AS corr, CASE WHEN sb > 3 THEN sb / 40 - 3 END AS peak FROM search_log
        WINDOW w AS (PARTITION BY song ORDER BY step))"""


def prev_cur(t):
    """Score maps of each step and of the step before it."""
    from scoreloom.operators.scan import prefix_scan, previous, step_block
    m = F.map_filter(F.create_map(
        F.lit("audiobox.PQ"), F.col("reward") / 60, F.lit("audiobox.CU"), F.col("sb") / 12, F.lit("lufs.integrated_lufs"),
        -F.col("reward") / 20, F.lit("stereo.stereo_correlation"), F.col("sb") / 50 - 0.6,
        F.lit("true_peak.true_peak_db"), F.when(F.col("sb") > 3, F.col("sb") / 40 - 3)), lambda k, v: v.isNotNull())
    log = t.search_log().select("song", "step", m.alias("cur"))
    out = prefix_scan(log, ["song"], [F.asc("step")], step_block("step"), {"p": previous("cur")})
    return out.select("song", "step", "cur", F.coalesce("p.v", F.create_map().cast("map<string,double>")).alias("prev"))


@query("classify_candidate", f"""WITH {PC}, d AS (SELECT *, (2 * c_pq + c_cu) / 3 - CASE WHEN p_pq IS NULL THEN 0 ELSE
      (2 * p_pq + p_cu) / 3 END AS d, CASE WHEN peak > -1 THEN 'true_peak' WHEN abs(lufs + 14) > 6 THEN 'loudness'
      WHEN corr < -0.3 THEN 'stereo' END AS gate, CASE WHEN c_pq - p_pq < -0.015 THEN 'audiobox.PQ' WHEN c_cu - p_cu < -0.015
      THEN 'audiobox.CU' END AS worst FROM pc)
    SELECT song, step, CASE WHEN gate IS NOT NULL THEN 'rollback' WHEN worst IS NOT NULL THEN 'investigate' WHEN d >= 0.02 THEN 'accept'
      WHEN d >= -0.005 THEN 'weak' ELSE 'rollback' END AS decision, CASE WHEN gate IS NOT NULL THEN 'gate:' || gate WHEN worst IS NOT NULL
      THEN 'regressed:' || worst WHEN d >= 0.02 THEN 'improved' WHEN d >= -0.005 THEN 'no_change' ELSE 'decreased' END AS reason,
      round(CASE WHEN gate IS NULL THEN d END, 8) AS delta_reward FROM d""", ["search_log"])
def classify_candidate(t):
    policy = R.Policy(weights={"audiobox.PQ": 2.0, "audiobox.CU": 1.0}, calib={})
    out = R.classify_candidate(prev_cur(t), "prev", "cur", policy)
    return r6(out.select("song", "step", "decision", "reason", "delta_reward"), "delta_reward", digits=8)


@query("safety_flags", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, concat_ws(',',
      CASE WHEN peak > 0 AND 20 * log10(peak + 1e-12) > -1 THEN 'true_peak' END,
      CASE WHEN lufs IS NOT NULL AND abs(lufs + 14) > 6 THEN 'loudness' END, CASE WHEN corr < -0.3 THEN 'stereo_correlation' END) AS flags
    FROM (SELECT *, l_discount * 10 AS peak, CASE WHEN l_linenumber < 7 THEN -l_quantity END AS lufs, l_tax * 10 - 0.5 AS corr FROM lineitem)""")
def safety_flags(t):
    lufs = F.when(F.col("l_linenumber") < 7, -F.col("l_quantity")).otherwise(F.lit(float("-inf")))
    flags = R.safety_flags(F.col("l_discount") * 10, lufs, F.col("l_tax") * 10 - 0.5)
    return t.lineitem.select(*LI, F.array_join(flags, ",").alias("flags"))


FIRED = f"""{PC}, fired AS (
      SELECT song, step, 0 AS seq, 'true_peak' AS rule, 1 AS priority FROM pc WHERE peak > -1
      UNION ALL SELECT song, step, 1, 'too_loud', 2 FROM pc WHERE lufs + 14 >= 3
      UNION ALL SELECT song, step, 2, 'too_quiet', 4 FROM pc WHERE lufs + 14 <= -3
      UNION ALL SELECT song, step, 3, 'stereo', 2 FROM pc WHERE corr < -0.1
      UNION ALL SELECT song, step, 4, 'axis_PQ', 5 FROM pc WHERE c_pq - p_pq < -0.05
      UNION ALL SELECT song, step, 7, 'axis_CU', 5 FROM pc WHERE c_cu - p_cu < -0.05)"""


def advice(t):
    df = prev_cur(t).withColumns({"stems": F.array(F.lit("drums")), "sections": F.create_map().cast("map<string,double>")})
    return R.advise(df, R.default_rules())


@query("advise", f"WITH {FIRED} SELECT * FROM fired", ["search_log"])
def advise(t):
    return advice(t).select("song", "step", "seq", "rule", "priority")


@query("top_suggestions", f"""WITH {FIRED} SELECT song, step, rule, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER
    (PARTITION BY song, step ORDER BY priority, seq) AS position FROM fired) WHERE position <= 2""", ["search_log"])
def top_suggestions(t):
    from scoreloom.operators.logs import top_suggestions as op
    return op(advice(t), 2, ["song", "step"]).select("song", "step", "rule", "position")


CHECK = """chk AS (SELECT listener, song, screen, max(score) FILTER (condition = 'NF') AS anchor, count(*) FILTER (condition <> 'NF') AS n,
      quantile_cont(score, 0.5) FILTER (condition <> 'NF') AS med, stddev_pop(score) FILTER (condition <> 'NF') AS sd
    FROM ratings GROUP BY 1, 2, 3)"""
FAILED = "coalesce((n >= 2 AND anchor > med) OR (n >= 2 AND sd <= 1e-9), false)"


@query("screen_check", f"WITH {CHECK} SELECT listener, song, screen, n AS n_others, med AS median_others, {FAILED} AS failed FROM chk",
       ["ratings"])
def screen_check(t):
    return R.screen_check(t.ratings(), "NF").select("listener", "song", "screen", "n_others", "median_others", "failed")


@query("app_eligibility", """WITH v AS (SELECT *, list_filter([CASE WHEN q_prod_years IS NULL OR pid % 17 = 0 THEN 'missing_data' END,
      CASE WHEN q_hearing <> 'normal' OR pid % 17 = 0 THEN 'fail_hearing' END, CASE WHEN q_device = 'MACHINERY' THEN 'fail_device' END,
      CASE WHEN q_prod_years IS NULL THEN 'fail_years' END, CASE WHEN (q_know1 = 'ratio')::INT + (q_know2 = 'send' AND pid % 4 > 0)::INT
      + (q_know3 = 'lufs')::INT < 2 THEN 'fail_knowledge' END, CASE WHEN q_know1 = 'harmonic_gate' THEN 'fail_bogus' END],
      lambda x: x IS NOT NULL) AS fails FROM screening)
    SELECT pid, array_to_string(fails, ',') AS fails, fails[1] AS reason, len(fails) = 0 AS eligible,
      CASE WHEN pid % 4 = 0 THEN '__unrecognised__' ELSE q_know2 END AS q_know2 FROM v""", ["screening"])
def app_eligibility(t):
    from dataclasses import replace
    know = lambda right, extra=(): [("skip", "I don't know"), (right, right.title()), *extra]
    options = {"q_hearing": [("normal", "Normal"), ("aided", "Corrected (hearing aid)")],
               "q_device": [(d, d.title()) for d in ("BUILDING", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE", "MACHINERY")],
               "q_know1": know("ratio", [("harmonic_gate", "Harmonic gate")]), "q_know2": know("send"), "q_know3": know("lufs")}
    s = t.screening().withColumns({
        "q_hearing": F.when(F.col("pid") % 17 == 0, " ").when(F.col("q_hearing") == "aided", "corrected (Hearing aid)").otherwise("NORMAL"),
        "q_know2": F.when(F.col("pid") % 4 == 0, "by carrier pigeon").otherwise(F.col("q_know2")),
        "q_prod_years": F.concat(F.lit("about "), F.col("q_prod_years").cast("string"))})
    out = S.app_eligibility(s, options, replace(PX6_CRITERIA))
    return out.select("pid", F.array_join("fails", ",").alias("fails"), "reason", "eligible", "q_know2")


@query("years_inconsistent", """SELECT c_custkey, NOT (y >= lo AND y < hi) AS inconsistent FROM (SELECT c_custkey,
      CAST(floor(c_acctbal / 500) AS INT) AS y, CASE c_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 10 END AS lo,
      CASE c_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 71 END AS hi FROM customer)""")
def years_inconsistent(t):
    band = F.element_at(F.array(*[F.lit(b) for b in ("lt1", "y3_5", "y5_10", "gt10")]), F.col("c_nationkey") % 4 + 1)
    return t.customer.select("c_custkey", S.years_inconsistent(band, F.floor(F.col("c_acctbal") / 500).cast("int")).alias("inconsistent"))
