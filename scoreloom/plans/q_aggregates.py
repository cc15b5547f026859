"""Aggregation queries."""

from pyspark.sql import functions as F

from scoreloom.functions import tables as TB
from scoreloom.functions.stats import wilson_ci
from scoreloom.operators import aggregates as A
from scoreloom.operators import screening as S
from scoreloom.operators.quantiles import upper_median
from scoreloom.operators.scan import prefix_scan, previous
from scoreloom.plans.registry import query


def r6(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("stat_block", """SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS min, max(l_quantity) AS max,
    sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY 1""")
def stat_block(t):
    return r6(A.stat_block(t.lineitem, ["l_returnflag"], "l_quantity"), "mean")


@query("system_summary", """SELECT condition, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
    round(1.96 * stddev_pop(score) / sqrt(count(*)), 6) AS ci95_half FROM ratings GROUP BY 1""", ["ratings"])
def system_summary(t):
    return r6(A.system_summary(t.ratings()), "mean", "std", "ci95_half")


@query("condition_means", """SELECT condition, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(*) AS n,
    round(quantile_cont(m, 0.5), 6) AS median FROM (SELECT listener, condition, avg(score) AS m FROM ratings GROUP BY 1, 2)
    GROUP BY 1""", ["ratings"])
def condition_means(t):
    return r6(A.condition_means(t.ratings()), "mean", "sd", "median")


PAIRS = """pairs AS (SELECT a, b, CASE WHEN pa > pb THEN a WHEN pb > pa THEN b END AS preferred FROM (
    SELECT lag(o_orderpriority) OVER w AS a, o_orderpriority AS b, lag(o_totalprice) OVER w AS pa, o_totalprice AS pb FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE a IS NOT NULL)"""


def pairs(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    o = prefix_scan(o, ["o_custkey"], [F.asc("o_orderkey")], F.floor(F.col("o_orderkey") / 1_000_000).cast("bigint"),
                    {"p": previous(F.struct("o_orderpriority", "o_totalprice"))})
    a, pa, pb = F.col("p.v.o_orderpriority"), F.col("p.v.o_totalprice"), F.col("o_totalprice")
    return o.where(a.isNotNull()).select(a.alias("a"), F.col("o_orderpriority").alias("b"),
                                         F.when(pa > pb, a).when(pb > pa, F.col("o_orderpriority")).alias("preferred"))


@query("win_rate_matrix", f"""WITH {PAIRS}, s AS (SELECT a AS system, b AS opponent, preferred FROM pairs UNION ALL
    SELECT b, a, preferred FROM pairs) SELECT system, opponent, count(*) FILTER (preferred = system) AS wins, count(*) AS shown,
    round(count(*) FILTER (preferred = system) / count(*), 6) AS win_rate FROM s WHERE system <> opponent GROUP BY 1, 2""")
def win_rate_matrix(t):
    return r6(A.win_rate_matrix(pairs(t)), "win_rate")


@query("win_rate_wide", f"""WITH {PAIRS}, s AS (SELECT a AS system, b AS opponent, preferred FROM pairs UNION ALL
    SELECT b, a, preferred FROM pairs), m AS (SELECT system, opponent, count(*) FILTER (preferred = system) / count(*) AS w
    FROM s WHERE system <> opponent GROUP BY 1, 2)
    SELECT system, round(any_value(w) FILTER (opponent = '1-URGENT'), 6) AS "1-URGENT",
           round(any_value(w) FILTER (opponent = '5-LOW'), 6) AS "5-LOW" FROM m GROUP BY 1""")
def win_rate_wide(t):
    return r6(A.win_rate_wide(A.win_rate_matrix(pairs(t)), ["1-URGENT", "5-LOW"]), "1-URGENT", "5-LOW")


@query("rough_alpha", """WITH u AS (SELECT song, screen, count(*) AS n, sum(score) AS s, sum(score * score) AS q FROM ratings
    GROUP BY 1, 2) SELECT round(1 - (SELECT sum(n * q - s * s) / sum(n * (n - 1) / 2) FROM u) /
    (2 * (SELECT var_pop(score) FROM ratings) + 1e-9), 6) AS alpha""", ["ratings"])
def rough_alpha(t):
    return r6(A.rough_alpha(t.ratings(), ["song", "screen"]), "alpha")


STATUS = """CASE WHEN CAST(sb AS BIGINT) % 10 = 0 THEN 'invalid' WHEN CAST(sb AS BIGINT) % 10 = 1 THEN 'gated'
            WHEN accepted THEN 'accepted' ELSE 'rejected' END"""


@query("proposal_funnel", f"""SELECT action, count(*) AS proposed, count(*) FILTER (s = 'accepted') AS accepted,
    count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'invalid') AS invalid, count(*) FILTER (s = 'gated') AS gated,
    round(count(*) FILTER (s = 'accepted') / count(*) FILTER (s IN ('accepted', 'rejected')), 6) AS acceptance_rate
    FROM (SELECT *, {STATUS} AS s FROM replayed) GROUP BY 1""", ["search_log", "replayed"])
def proposal_funnel(t):
    return r6(A.proposal_funnel(t.replayed().withColumn("status", F.expr(STATUS))), "acceptance_rate")


@query("accepted_by_kind", """WITH p AS (SELECT song, action, CAST(CAST(sb AS BIGINT) % 4 AS VARCHAR) AS track, min(step) AS f,
      count(*) AS n, sum(reward - best_before) AS d FROM replayed WHERE accepted GROUP BY 1, 2, 3)
    SELECT song, action, CAST(sum(n) AS BIGINT) AS n, round(sum(d), 6) AS gain, min(f) AS first_step,
           string_agg(track, ',' ORDER BY f) AS tracks, CAST(row_number() OVER (PARTITION BY song ORDER BY min(f)) AS INT)
           AS position FROM p GROUP BY 1, 2""", ["search_log", "replayed"])
def accepted_by_kind(t):
    log = t.replayed().withColumn("track", (F.col("sb").cast("bigint") % 4).cast("string"))
    return r6(A.accepted_by_kind(log), "gain").withColumn("tracks", F.array_join("tracks", ","))


CALL = "CASE action WHEN 'click' THEN 'ok' WHEN 'view' THEN 'ok' WHEN 'error' THEN 'invalid' WHEN 'signup' THEN 'gated' ELSE 'empty' END"


@query("call_summary", f"""SELECT run, song, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'invalid') AS invalid,
    count(*) FILTER (s = 'gated') AS gated, count(*) FILTER (s = 'empty') AS empty, count(*) AS calls,
    round(avg(latency), 6) AS mean_latency, count(*) FILTER (s <> 'ok') AS reasks FROM (SELECT user_id AS song, day(ts) AS run,
    {CALL.replace('action', 'event_type')} AS s, value / 100 AS latency FROM events) GROUP BY 1, 2""")
def call_summary(t):
    calls = t.events.select(F.col("user_id").alias("song"), F.dayofmonth("ts").cast("bigint").alias("run"),
                            F.expr(CALL.replace("action", "event_type")).alias("status"), (F.col("value") / 100).alias("latency"))
    return r6(A.call_summary(calls), "mean_latency")


@query("value_histogram", """SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram FROM
    (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def value_histogram(t):
    out = A.value_histogram(t.events, ["user_id"], "event_type")
    text = F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("user_id", text.alias("histogram"))


@query("answer_distribution", """SELECT 'q_device' AS q, coalesce(CASE WHEN pid % 7 > 0 THEN q_device END, '(missing)') AS answer,
      count(*) AS n FROM screening GROUP BY ALL
    UNION ALL SELECT 'multi', coalesce(a, '(missing)'), count(*) FROM (SELECT unnest(CASE WHEN pid % 7 > 0
      THEN [q_know1, q_hearing] ELSE [NULL] END) AS a FROM screening) GROUP BY ALL""", ["screening"])
def answer_distribution(t):
    s = t.screening().withColumns({"q_device": F.when(F.col("pid") % 7 > 0, F.col("q_device")),
                                   "multi": F.when(F.col("pid") % 7 > 0, F.array("q_know1", "q_hearing"))})
    one = S.answer_distribution(s, "q_device").select(F.lit("q_device").alias("q"), "answer", "n")
    return one.unionByName(S.answer_distribution(s, "multi", multi=True).select(F.lit("multi").alias("q"), "answer", "n"))


@query("missing_by_question", """SELECT 'q_prod_years' AS question, count(*) FILTER (q_prod_years IS NULL) AS n_missing FROM screening
    UNION ALL SELECT 'q_device', count(*) FILTER (pid % 11 = 0 OR pid % 13 = 0) FROM screening""", ["screening"])
def missing_by_question(t):
    dev = F.when(F.col("pid") % 11 == 0, F.lit(" ")).when(F.col("pid") % 13 > 0, F.col("q_device"))
    return S.missing_by_question(t.screening().withColumn("q_device", dev), ["q_prod_years", "q_device"])


PX6_CRITERIA = S.Criteria(required=("q_hearing", "q_device", "q_prod_years", "q_know1", "q_know2", "q_know3"),
                          device=("BUILDING", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE"), prod=None,
                          bogus={"q_know1": "harmonic_gate"})
VERDICTS = """v AS (SELECT *, list_filter([CASE WHEN q_prod_years IS NULL THEN 'missing_data' END,
    CASE WHEN q_hearing <> 'normal' THEN 'fail_hearing' END, CASE WHEN q_device = 'MACHINERY' THEN 'fail_device' END,
    CASE WHEN q_prod_years IS NULL THEN 'fail_years' END,
    CASE WHEN (q_know1 = 'ratio')::INT + (q_know2 = 'send')::INT + (q_know3 = 'lufs')::INT < 2 THEN 'fail_knowledge' END,
    CASE WHEN q_know1 = 'harmonic_gate' THEN 'fail_bogus' END], lambda x: x IS NOT NULL) AS fails FROM screening)"""


def verdicts(t):
    return S.classify_eligibility(t.screening(), PX6_CRITERIA)


@query("classify_eligibility", f"""WITH {VERDICTS} SELECT pid, array_to_string(fails, ',') AS fails, fails[1] AS reason,
    len(fails) = 0 AS eligible, (q_know1 = 'ratio')::INT + (q_know2 = 'send')::INT + (q_know3 = 'lufs')::INT AS n_know_correct
    FROM v""", ["screening"])
def classify_eligibility(t):
    return verdicts(t).select("pid", F.array_join("fails", ",").alias("fails"), "reason", "eligible", "n_know_correct")


@query("fail_waterfall", f"""WITH {VERDICTS} SELECT f AS criterion, count(*) FILTER (f = first) AS n_first, count(*) AS n_any
    FROM (SELECT fails[1] AS first, unnest(fails) AS f FROM v) GROUP BY 1""", ["screening"])
def fail_waterfall(t):
    return S.fail_waterfall(verdicts(t))


@query("eligibility_summary", f"""WITH {VERDICTS}, a AS (SELECT count(*) AS n, count(*) FILTER (len(fails) = 0) AS k,
      count(*) FILTER (pid % 20 = 0) AS blank, count(*) FILTER (pid % 20 = 0 AND len(fails) = 0) AS kb,
      count(*) FILTER (q_know1 = 'harmonic_gate') AS bogus, avg(q_prod_years) FILTER (len(fails) = 0) AS m,
      stddev_samp(q_prod_years) FILTER (len(fails) = 0) AS sd, min(q_prod_years) FILTER (len(fails) = 0) AS mn,
      max(q_prod_years) FILTER (len(fails) = 0) AS mx FROM v)
    SELECT n + (SELECT count(*) FROM screening WHERE pid % 20 = 7) AS n_rows, n AS n_unique, blank AS n_blank_id, k AS n_eligible,
      kb AS n_eligible_without_id, bogus AS n_bogus_any, CAST(0 AS BIGINT) AS n_inconsistent_years, k AS years_n,
      round(m, 6) AS years_mean, round(sd, 6) AS years_sd, mn AS years_min, mx AS years_max,
      (SELECT count(*) FROM screening WHERE pid % 20 = 7) AS n_duplicate_ids, round(k / n, 6) AS eligible_rate,
      round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS ci_lo,
      round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS ci_hi
    FROM a, (SELECT 1.959963985 AS z)""", ["screening"])
def eligibility_summary(t):
    from scoreloom.operators.logs import dedupe_first
    s = t.screening().withColumn("seq", F.lit(0))
    rows = s.unionByName(s.where(F.col("pid") % 20 == 7).withColumn("seq", F.lit(1)))
    rows = rows.withColumn("pid", F.when(F.col("pid") % 20 > 0, F.col("pid").cast("string")).otherwise(""))
    v = S.classify_eligibility(dedupe_first(rows, "pid", ["seq"]), PX6_CRITERIA)
    return r6(S.eligibility_summary(rows, v), "years_mean", "years_sd", "eligible_rate", "ci_lo", "ci_hi")


@query("wilson_ci", """SELECT toxic, sum(quality)::BIGINT AS k, count(*) AS n,
      round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS lo,
      round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS hi
    FROM (SELECT toxic, quality, avg(quality) OVER (PARTITION BY toxic) AS p, count(*) OVER (PARTITION BY toxic)::DOUBLE AS n,
          1.959963985 AS z FROM labels) GROUP BY toxic, p, n, z""".replace("count(*) AS n,", "n::BIGINT AS n,"))
def wilson(t):
    out = t.labels.groupBy("toxic").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    return out.withColumn("w", wilson_ci("k", "n")).select("toxic", "k", "n", F.round("w.lo", 6).alias("lo"), F.round("w.hi", 6).alias("hi"))


@query("upper_median", """SELECT o_orderpriority, o_totalprice AS upper_median FROM (SELECT *, row_number() OVER (PARTITION BY
    o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    WHERE r = n // 2 + 1""")
def upper_median_q(t):
    return upper_median(t.orders, ["o_orderpriority"], "o_totalprice")


@query("tally_flow", """SELECT 'n_started' AS item, count(DISTINCT user_id) AS n FROM events
    UNION ALL SELECT 'n_questionnaire', count(DISTINCT user_id) FILTER (event_type = 'signup') FROM events
    UNION ALL SELECT 'n_analysed', count(DISTINCT user_id) FROM events WHERE event_type = 'purchase' AND value > 100
    UNION ALL SELECT 'code:C' || CAST(json_extract(props, '$.k') AS BIGINT) % 5, count(*) FROM events WHERE event_type = 'purchase'
      GROUP BY 1""")
def tally_flow(t):
    e = t.events
    k = F.get_json_object("props", "$.k").cast("bigint") % 5
    rec = e.select(F.col("user_id").alias("pid"), F.when(F.col("event_type") == "signup", "screen_q").otherwise("x").alias("type"),
                   F.when(F.col("event_type") == "purchase", F.concat(F.lit("C"), k.cast("string"))).alias("code"))
    done = e.where((F.col("event_type") == "purchase") & (F.col("value") > 100)).select(F.col("user_id").alias("pid"))
    return A.tally_flow(rec, done)


@query("eligibility_audit", f"""WITH {VERDICTS}, r AS (SELECT pid, len(fails) = 0 AS ok FROM v WHERE pid % 9 > 0),
      c AS (SELECT pid, pid % 4 > 0 AS client, pid % 25 = 0 AS prov FROM screening WHERE pid % 6 > 0)
    SELECT count(r.ok) AS n_judged, count(*) FILTER (NOT ok) AS n_ineligible_on_recheck, count(*) FILTER (prov) AS n_provisional_pass,
      count(*) FILTER (NOT ok AND client) AS n_client_passed_but_ineligible,
      count(*) FILTER (ok IS NOT NULL AND client IS NULL) AS n_no_elig_record FROM r FULL JOIN c ON r.pid = c.pid""", ["screening"])
def eligibility_audit(t):
    r = verdicts(t).where(F.col("pid") % 9 > 0).select("pid", "eligible")
    c = t.screening().where(F.col("pid") % 6 > 0).select("pid", (F.col("pid") % 4 > 0).alias("client_eligible"),
                                                         (F.col("pid") % 25 == 0).alias("provisional"))
    return S.eligibility_audit(r, c)


@query("seed_mean", """SELECT run, song, count(DISTINCT seed_idx) AS n_seeds, round(avg(pq), 9) AS pq, round(avg(sb), 9) AS sb,
    count(DISTINCT seed_idx) = 2 AS complete FROM arms GROUP BY 1, 2""", ["arms"])
def seed_mean(t):
    return r6(A.seed_mean(t.arms(), 2, on_mismatch="flag"), "pq", "sb", digits=9)


@query("song_set_digest", """SELECT count(*) AS n, substr(sha256(string_agg(k, chr(10) ORDER BY k)), 1, 12) AS digest FROM
    (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer)""")
def song_set_digest(t):
    return A.song_set_digest(t.customer, "c_custkey")


LONG = """long AS (SELECT p_partkey, 'audiobox.PQ' AS key, p_size / 5.0::DOUBLE AS value FROM part UNION ALL
    SELECT p_partkey, 'audiobox.CU', p_retailprice / 150 FROM part WHERE p_size % 4 > 0 UNION ALL
    SELECT p_partkey, 'stereo.stereo_quality', p_size / 60.0::DOUBLE FROM part WHERE p_size % 3 > 0 UNION ALL
    SELECT p_partkey, 'nisqa', 1.0::DOUBLE FROM part)"""


def long_scores(t):
    p = F.col("p_size")
    nan = F.lit(float("nan"))
    entries = F.array(
        F.struct(F.lit("audiobox.PQ").alias("key"), (p / 5.0).alias("value")),
        F.struct(F.lit("audiobox.CU").alias("key"), F.when(p % 4 > 0, F.col("p_retailprice") / 150).otherwise(nan).alias("value")),
        F.struct(F.lit("stereo.stereo_quality").alias("key"), F.when(p % 3 > 0, p / 60.0).otherwise(nan).alias("value")),
        F.struct(F.lit("nisqa").alias("key"), F.lit(1.0).alias("value")))
    return t.part.select("p_partkey", F.inline(entries))


@query("weighted_reward", f"""WITH {LONG} SELECT p_partkey, round(sum(CASE key WHEN 'audiobox.PQ' THEN (value - 7.7538) / 0.5352
      WHEN 'audiobox.CU' THEN (value - 7.5989) / 0.354 WHEN 'stereo.stereo_quality' THEN 0.5 * (value - 0.8088) / 0.1917 END) /
      sum(CASE key WHEN 'audiobox.PQ' THEN 1.0 WHEN 'audiobox.CU' THEN 1.0 WHEN 'stereo.stereo_quality' THEN 0.5 END), 6) AS reward
    FROM long GROUP BY 1""")
def weighted_reward(t):
    return r6(A.weighted_reward(long_scores(t), ["p_partkey"]), "reward")


REL = """rel AS (SELECT l_suppkey, l_returnflag, 10 * log10(sum(e) / any_value(tot)) AS relative_db FROM (SELECT *, l_quantity *
    l_quantity AS e, sum(l_quantity * l_quantity) OVER (PARTITION BY l_suppkey) AS tot FROM lineitem) GROUP BY 1, 2)"""


def rel_levels(t):
    li = t.lineitem.withColumn("e", F.col("l_quantity") * F.col("l_quantity"))
    return A.relative_levels(li, ["l_suppkey"], "l_returnflag", "e")


@query("relative_levels", f"WITH {REL} SELECT l_suppkey, l_returnflag, round(relative_db, 6) AS relative_db FROM rel")
def relative_levels(t):
    return r6(rel_levels(t), "relative_db")


@query("match_profile", f"""WITH {REL}, target AS (SELECT l_returnflag, min(relative_db) + CASE l_returnflag WHEN 'R' THEN 15 ELSE 1
      END AS tdb FROM rel WHERE l_returnflag <> 'A' GROUP BY 1)
    SELECT l_suppkey, l_returnflag, round(relative_db, 6) AS relative_db,
           round(greatest(-12.0, least(12.0, tdb - relative_db)), 2) AS gain_db FROM rel JOIN target USING (l_returnflag)""")
def match_profile(t):
    rel = rel_levels(t)
    target = rel.where("l_returnflag <> 'A'").groupBy("l_returnflag").agg(F.min("relative_db").alias("m")).select(
        "l_returnflag", (F.col("m") + F.when(F.col("l_returnflag") == "R", 15).otherwise(1)).alias("relative_db"))
    return r6(A.match_profile(rel, target, "l_returnflag"), "relative_db")


@query("equal_level_gain", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(CASE WHEN lvl > -70
      THEN pow(10, (-23 - lvl) / 20) ELSE 1 END, 6) AS gain, round(l_extendedprice * CASE WHEN lvl > -70
      THEN pow(10, (-23 - lvl) / 20) ELSE 1 END, 3) AS l_extendedprice FROM (SELECT *, -l_quantity * 1.6::DOUBLE AS lvl FROM lineitem)""")
def equal_level_gain(t):
    li = t.lineitem.withColumn("lvl", -F.col("l_quantity") * 1.6)
    out = A.equal_level(li, "lvl", "l_extendedprice", -23.0)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round("gain", 6).alias("gain"),
                      F.round("l_extendedprice", 3).alias("l_extendedprice"))


ROLL = """f AS (SELECT song, CAST(floor(t_sec / 604800) AS BIGINT) AS section, CAST(floor(t_sec / 86400) AS BIGINT) AS win,
          event_id AS frame, rms_db FROM frames)"""


@query("resolution_rollup", f"""WITH {ROLL} SELECT song, CASE grouping(section, win, frame) WHEN 7 THEN 'global' WHEN 3 THEN 'section'
      WHEN 5 THEN 'short_term' ELSE 'momentary' END AS resolution, coalesce(CAST(section AS VARCHAR), CAST(win AS VARCHAR),
      CAST(frame AS VARCHAR), '') AS unit, round(avg(rms_db), 6) AS score, count(*) AS n FROM f
    GROUP BY GROUPING SETS ((song), (song, section), (song, win), (song, frame))""", ["frames"])
def resolution_rollup(t):
    f = t.frames().select("song", F.floor(F.col("t_sec") / 604800).cast("bigint").alias("section"),
                          F.floor(F.col("t_sec") / 86400).cast("bigint").alias("win"), F.col("event_id").alias("frame"), "rms_db")
    return r6(A.resolution_rollup(f, ["song"], "section", "win", "frame", "rms_db"), "score")


@query("trajectory_summary", """SELECT song, round(avg(rms_db), 6) AS mean, round(stddev_pop(rms_db), 6) AS std,
    round(max_by(rms_db, event_id) - min_by(rms_db, event_id), 6) AS drift,
    round(quantile_cont(rms_db, 0.95) - quantile_cont(rms_db, 0.1), 6) AS spread FROM frames GROUP BY 1""", ["frames"])
def trajectory_summary(t):
    return r6(A.trajectory_summary(t.frames(), ["song"], "event_id", "rms_db"), "mean", "std", "drift", "spread")


DYN = """dyn AS (SELECT song, avg(d) AS dr FROM (SELECT song, stem, quantile_cont(rms_db, 0.95) - quantile_cont(rms_db, 0.1) AS d
         FROM frames WHERE rms_db > 20 GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)"""


@query("dynamic_range", f"""WITH {DYN} SELECT s.song, round(coalesce(dr, 0), 6) AS dynamic_range_db
    FROM (SELECT DISTINCT song FROM frames) s LEFT JOIN dyn ON s.song = dyn.song""", ["frames"])
def dynamic_range(t):
    return r6(A.dynamic_range(t.frames(), ["song"], "stem", "rms_db", 20.0), "dynamic_range_db")


FEATS = f"""{DYN}, st AS (SELECT song, stem, max(t_sec) AS e, max(rms_db + event_id % 3) AS b, sum(pow(10, rms_db / 10)) AS en
      FROM frames GROUP BY 1, 2),
    feats AS (SELECT song, count(*) AS n_stems, max(e) AS duration_sec, bool_or(stem = 'signup') AS vocal_present,
      max(b) FILTER (stem = 'signup') - max(b) FILTER (stem <> 'signup') AS masking_overlap_db,
      count(*) FILTER (10 * log10(en + 1e-12) > 55) AS n_full_band_stems FROM st GROUP BY 1)"""


def features(t):
    f = t.frames().withColumns({"band": F.col("rms_db") + F.col("event_id") % 3,
                                "instrument": F.when(F.col("stem") == "signup", "male singer")})
    # The silence floors are shifted to the value range of the table.
    f = f.withColumn("lifted", F.col("rms_db") - 70)
    out = A.tier_features(f, ["song"], "stem", "t_sec", "rms_db", "band", "instrument", 55.0)
    dr = A.dynamic_range(f, ["song"], "stem", "lifted", -50.0)
    return out.drop("dynamic_range_db").join(dr, "song")


@query("tier_features", f"""WITH {FEATS} SELECT feats.song, n_stems, round(duration_sec, 3) AS duration_sec, vocal_present,
    round(masking_overlap_db, 6) AS masking_overlap_db, n_full_band_stems, round(coalesce(dr, 0), 6) AS dynamic_range_db
    FROM feats LEFT JOIN dyn ON feats.song = dyn.song""", ["frames"])
def tier_features(t):
    out = r6(features(t), "masking_overlap_db", "dynamic_range_db")
    return out.withColumn("duration_sec", F.round("duration_sec", 3))


@query("tier_song", f"""WITH {FEATS}, x AS (SELECT feats.*, coalesce(dr, 0) AS d FROM feats LEFT JOIN dyn ON feats.song = dyn.song),
    h AS (SELECT *, (n_stems >= 5)::INT + (d >= 18)::INT + (vocal_present AND masking_overlap_db <= -6)::INT AS hard FROM x)
    SELECT song, CASE WHEN n_stems <= 4 AND d < 17 THEN 'A' WHEN hard >= 2 THEN 'C' ELSE 'B' END AS tier,
      CASE WHEN n_stems <= 4 AND d < 17 THEN 'n_stems_low_AND_dyn_low' WHEN hard >= 2 THEN concat_ws('+',
      CASE WHEN n_stems >= 5 THEN 'n_stems_high' END, CASE WHEN d >= 18 THEN 'dyn_range_high' END,
      CASE WHEN vocal_present AND masking_overlap_db <= -6 THEN 'vocal_masked' END) ELSE 'default_medium' END AS rule_fired
    FROM h""", ["frames"])
def tier_song(t):
    from scoreloom.operators.rules import tier_song as op
    th = {"n_stems_easy_max": 4, "dyn_range_db_low": 17.0, "n_stems_hard_min": 5, "dyn_range_db_high": 18.0,
          "masking_overlap_db_high": -6.0}
    return op(features(t), th).select("song", "tier", "rule_fired")


CHAIN = "(sb - 50) / 12.0::DOUBLE + CASE WHEN song % 2 = 0 THEN 0.01 * (event_id % 7) WHEN song % 5 = 0 THEN -sb / 5 ELSE 0 END"


@query("axis_fit", f"""WITH c AS (SELECT song, sb, {CHAIN} AS r FROM search_log),
    f AS (SELECT song, count(*) AS n, CASE WHEN regr_sxx(r, sb) >= 1e-12 AND regr_slope(r, sb) > 0 AND count(*) >= 2
          THEN 1 / regr_slope(r, sb) END AS sigma, avg(sb) AS mx, avg(r) AS my FROM c GROUP BY 1)
    SELECT f.song, any_value(n) AS n, round(any_value(mx - my * sigma), 6) AS mu, round(any_value(sigma), 6) AS sigma,
           round(max(abs((sb - (mx - my * sigma)) / sigma - r)), 6) AS max_resid FROM f JOIN c ON c.song = f.song GROUP BY 1""",
       ["search_log"])
def axis_fit(t):
    log = t.search_log().withColumn("r", F.expr(CHAIN.replace("::DOUBLE", "D")))
    return r6(A.axis_fit(log, ["song"], "sb", "r"), "mu", "sigma", "max_resid")


ARM = """CASE o_orderpriority WHEN '1-URGENT' THEN 'pq_only' WHEN '2-HIGH' THEN 'sb_only' WHEN '3-MEDIUM' THEN 'min'
         WHEN '4-NOT SPECIFIED' THEN 'mean' ELSE 'penalized' END"""
ZDELTA = f"""o AS (SELECT {ARM} AS arm, o_custkey % 300 AS song, 0 AS seed_idx, o_orderkey AS step0, o_totalprice / 1e4 AS pq,
      ((o_orderkey * 7919) % 1000) / 100.0::DOUBLE AS sb FROM orders),
    z AS (SELECT *, (pq - 20 - song % 7) / (5.0::DOUBLE + song % 3) AS zp, (sb - 4) / (2.0::DOUBLE + song % 4) AS zs FROM o),
    c AS (SELECT arm, song, seed_idx, 3 * (row_number() OVER (PARTITION BY arm, song ORDER BY step0) - 1) AS step, pq, sb,
      CASE arm WHEN 'pq_only' THEN zp + CASE WHEN song % 11 = 0 THEN step0 % 5 ELSE 0 END WHEN 'sb_only' THEN zs
      WHEN 'min' THEN least(zp, zs) + CASE WHEN song % 13 = 0 THEN 1 ELSE 0 END WHEN 'mean' THEN (zp + zs) / 2 ELSE zp END AS reward
      FROM z),
    i AS (SELECT arm, song, seed_idx, -1 - (song % 5) / 10.0::DOUBLE AS init FROM c GROUP BY 1, 2, 3),
    full_ AS (SELECT song FROM i GROUP BY 1 HAVING count(DISTINCT arm) = 5),
    fp AS (SELECT song, 1 / regr_slope(reward, pq) AS sg, avg(pq) - avg(reward) / regr_slope(reward, pq) AS mu FROM c
      WHERE arm = 'pq_only' GROUP BY 1 HAVING count(*) >= 2 AND regr_slope(reward, pq) > 0),
    fs AS (SELECT song, 1 / regr_slope(reward, sb) AS sg, avg(sb) - avg(reward) / regr_slope(reward, sb) AS mu FROM c
      WHERE arm = 'sb_only' GROUP BY 1 HAVING count(*) >= 2 AND regr_slope(reward, sb) > 0),
    okp AS (SELECT c.song FROM c JOIN fp ON c.song = fp.song WHERE arm = 'pq_only' GROUP BY 1
      HAVING max(abs((pq - mu) / sg - reward)) <= 0.05),
    oks AS (SELECT c.song FROM c JOIN fs ON c.song = fs.song WHERE arm = 'sb_only' GROUP BY 1
      HAVING max(abs((sb - mu) / sg - reward)) <= 0.05),
    bad AS (SELECT DISTINCT c.song FROM (SELECT * FROM c WHERE arm = 'min' QUALIFY row_number() OVER (PARTITION BY song ORDER BY step) <= 10) c JOIN fp ON c.song = fp.song JOIN fs ON c.song = fs.song WHERE abs(least((pq - fp.mu) / fp.sg, (sb - fs.mu) / fs.sg) - reward) > 0.1),
    l AS (SELECT arm, song, max_by(pq, step) AS pq1, max_by(sb, step) AS sb1 FROM c GROUP BY 1, 2),
    rows_ AS (SELECT i.arm, i.song, i.seed_idx, (pq1 - (fp.mu + fp.sg * i.init)) / fp.sg AS dz_pq,
      (sb1 - (fs.mu + fs.sg * i.init)) / fs.sg AS dz_sb, pq1 - (fp.mu + fp.sg * i.init) AS d_pq_raw,
      sb1 - (fs.mu + fs.sg * i.init) AS d_sb_raw FROM i JOIN full_ ON i.song = full_.song JOIN fp ON i.song = fp.song
      JOIN fs ON i.song = fs.song JOIN okp ON i.song = okp.song JOIN oks ON i.song = oks.song
      JOIN l ON l.arm = i.arm AND l.song = i.song WHERE i.song NOT IN (SELECT song FROM bad))"""


def zdelta_rows(t):
    from scoreloom.operators.scan import ordinal
    o = t.orders.select(F.expr(ARM).alias("arm"), (F.col("o_custkey") % 300).alias("song"), F.lit(0).alias("seed_idx"),
                        F.col("o_orderkey").alias("step0"), (F.col("o_totalprice") / 1e4).alias("pq"),
                        (((F.col("o_orderkey") * 7919) % 1000) / 100).alias("sb"))
    zp = (F.col("pq") - 20 - F.col("song") % 7) / (5 + F.col("song") % 3)
    zs = (F.col("sb") - 4) / (2 + F.col("song") % 4)
    rew = (F.when(F.col("arm") == "pq_only", zp + F.when(F.col("song") % 11 == 0, F.col("step0") % 5).otherwise(0))
           .when(F.col("arm") == "sb_only", zs)
           .when(F.col("arm") == "min", F.least(zp, zs) + F.when(F.col("song") % 13 == 0, 1).otherwise(0))
           .when(F.col("arm") == "mean", (zp + zs) / 2).otherwise(zp))
    c = ordinal(o.withColumn("reward", rew), ["arm", "song", "seed_idx"], [F.asc("step0")],
                F.floor(F.col("step0") / 1_000_000).cast("bigint"))
    c = c.withColumn("step", 3 * (F.col("rn") - 1))
    i = c.groupBy("arm", "song", "seed_idx").agg((-1 - (F.first("song") % 5) / 10).alias("init_reward"))
    return A.z_delta(c, i, ["pq_only", "sb_only", "min", "mean", "penalized"])


@query("z_delta", f"""WITH {ZDELTA} SELECT arm, song, seed_idx, round(dz_pq, 8) AS dz_pq, round(dz_sb, 8) AS dz_sb,
    round(d_pq_raw, 8) AS d_pq_raw, round(d_sb_raw, 8) AS d_sb_raw FROM rows_""")
def z_delta(t):
    return r6(zdelta_rows(t), "dz_pq", "dz_sb", "d_pq_raw", "d_sb_raw", digits=8)


@query("z_delta_summary", f"""WITH {ZDELTA} SELECT arm, count(*) AS n, round(avg(dz_pq), 6) AS dz_pq, round(avg(dz_sb), 6) AS dz_sb,
    round(avg(d_pq_raw), 6) AS d_pq_raw, round(avg(d_sb_raw), 6) AS d_sb_raw,
    round(CASE arm WHEN 'pq_only' THEN avg((-dz_sb >= dz_pq)::INT) WHEN 'sb_only' THEN avg((-dz_pq >= dz_sb)::INT) END, 6)
      AS frac_loss_ge_gain,
    round(CASE arm WHEN 'pq_only' THEN -avg(dz_sb) / avg(dz_pq) WHEN 'sb_only' THEN -avg(dz_pq) / avg(dz_sb) END, 6)
      AS loss_over_gain FROM rows_ GROUP BY arm""")
def z_delta_summary(t):
    return r6(A.z_delta_summary(zdelta_rows(t)), "dz_pq", "dz_sb", "d_pq_raw", "d_sb_raw", "frac_loss_ge_gain", "loss_over_gain")


@query("determinism_spread", """SELECT song, count(DISTINCT run) AS n_runs, round(max(pq) - min(pq), 9) AS spread FROM song_arms
    GROUP BY 1 HAVING count(DISTINCT run) >= 2""", ["arms", "song_arms"])
def determinism_spread(t):
    return r6(A.determinism_spread(t.song_arms(), ["song"], "run", "pq"), "spread", digits=9)


@query("band_overlap", """SELECT p_brand, round(max(v) FILTER (voc) - max(v) FILTER (NOT voc), 6) AS masking_overlap_db FROM
    (SELECT p_brand, p_retailprice / 100 AS v, p_size % 4 = 0 AS voc FROM part) GROUP BY 1""")
def band_overlap(t):
    b = t.part.withColumn("v", F.col("p_retailprice") / 100)
    return r6(A.band_overlap(b, ["p_brand"], "v", F.col("p_size") % 4 == 0), "masking_overlap_db")


@query("pyramid_gain", f"""SELECT p_partkey, role, round(CASE WHEN level <= -50 THEN 0 ELSE greatest(-18, least(12, CASE role
    WHEN 'vocals' THEN -15 WHEN 'kick' THEN -16 WHEN 'drums' THEN -16 WHEN 'bass' THEN -17 ELSE -20 END - level)) END, 6) AS gain_db
    FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'vocals' WHEN 1 THEN 'bass' WHEN 2 THEN 'kick' WHEN 3 THEN 'keys' ELSE 'other'
    END AS role, -p_size * 1.2::DOUBLE AS level FROM part)""")
def pyramid_gain(t):
    role = F.element_at(F.array(*[F.lit(x) for x in ("vocals", "bass", "kick", "keys", "other")]), F.col("p_size") % 5 + 1)
    p = t.part.select("p_partkey", role.alias("role"), (-F.col("p_size") * 1.2).alias("level"))
    return r6(A.pyramid_gain(p), "gain_db").select("p_partkey", "role", "gain_db")
