"""Ordered-log queries on the event stream in the role of a search log."""

from pyspark.sql import functions as F

from scoreloom.operators import logs as L
from scoreloom.operators.scan import time_block
from scoreloom.plans.registry import query

LOG, REP = ["search_log"], ["search_log", "replayed"]
ACTIONS = ["click", "error", "purchase", "signup", "view"]
SIG = "action || '#' || CAST(CAST(sb AS BIGINT) % 7 AS VARCHAR)"


def sig(df):
    return df.withColumn("sig", F.concat("action", F.lit("#"), (F.col("sb").cast("bigint") % 7).cast("string")))


@query("best_so_far", "SELECT song, step, max(reward) OVER (PARTITION BY song ORDER BY step) AS best FROM search_log", LOG)
def best_so_far(t):
    return L.best_so_far(t.search_log()).select("song", "step", "best")


@query("replay_acceptance", "SELECT song, step, best_before, accepted FROM replayed", REP)
def replay_acceptance(t):
    return t.replayed().select("song", "step", "best_before", "accepted")


@query("step_delta", "SELECT song, step, round(reward - best_before, 6) AS delta FROM replayed", REP)
def step_delta(t):
    return L.step_delta(t.replayed()).select("song", "step", F.round("delta", 6).alias("delta"))


@query("state_values", """
    SELECT song, step, last_value(CASE WHEN accepted THEN pq END IGNORE NULLS) OVER w AS state_pq,
           last_value(CASE WHEN accepted THEN sb END IGNORE NULLS) OVER w AS state_sb FROM replayed
    WINDOW w AS (PARTITION BY song ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", REP)
def state_values(t):
    return L.state_values(t.replayed()).select("song", "step", "state_pq", "state_sb")


@query("budget_curve", """
    SELECT song, CAST(budget AS BIGINT) AS budget, greatest(10.0, max(CASE WHEN step < budget THEN reward END)) AS best,
           count(*) FILTER (step < budget AND accepted) AS n_accepted
    FROM replayed, (SELECT unnest([1, 5, 20, 50, 1000000]) AS budget) GROUP BY song, budget""", REP)
def budget_curve(t):
    return L.budget_curve(t.replayed(), [1, 5, 20, 50, 1000000], 10.0)


@query("stall_length", """
    SELECT song, step, step - coalesce(max(CASE WHEN accepted THEN step END) OVER (PARTITION BY song ORDER BY step
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS stall FROM replayed""", REP)
def stall_length(t):
    return L.stall_length(t.replayed()).select("song", "step", "stall")


STALL = """s AS (SELECT *, step - coalesce(max(CASE WHEN accepted THEN step END) OVER (PARTITION BY song ORDER BY step
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS stall FROM replayed)"""


@query("stalled_steps", f"""WITH {STALL} SELECT song, count(*) FILTER (stall >= 10) AS stall_steps, max(stall) AS max_stall
    FROM s GROUP BY song""", REP)
def stalled_steps(t):
    return L.stalled_steps(t.replayed(), 10)


@query("switch_point", f"""
    WITH {STALL}, f AS (SELECT song, min(step) AS switch_step FROM s WHERE step >= 40 OR stall >= 15 GROUP BY song)
    SELECT o.song, switch_step, CASE WHEN switch_step >= 40 THEN 'fixed_step_40' WHEN switch_step IS NOT NULL
           THEN 'stall_15' END AS "trigger" FROM (SELECT DISTINCT song FROM s) o LEFT JOIN f ON o.song = f.song""", REP)
def switch_point(t):
    return L.switch_point(t.replayed(), 40, 15)


EPOCH = f"""e AS (SELECT *, {SIG} AS sig, coalesce(sum(accepted::INT) OVER (PARTITION BY song ORDER BY step
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM replayed)"""


@query("repeat_in_state", f"""
    WITH {EPOCH} SELECT song, step, CAST(epoch AS BIGINT) AS epoch, row_number() OVER (PARTITION BY song, epoch, sig
    ORDER BY step) > 1 AS is_repeat FROM e""", REP)
def repeat_in_state(t):
    return L.repeat_in_state(sig(t.replayed())).select("song", "step", "epoch", "is_repeat")


@query("tool_coverage", """
    WITH f AS (SELECT song, action, min(step) AS f FROM search_log GROUP BY song, action),
         c AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS action)
    SELECT l.song, l.step, coalesce(string_agg(c.action, ',' ORDER BY c.action) FILTER (f.f < l.step), '') AS tried,
           coalesce(string_agg(c.action, ',' ORDER BY c.action) FILTER (f.f IS NULL OR f.f >= l.step), '') AS untried
    FROM search_log l CROSS JOIN c LEFT JOIN f ON f.song = l.song AND f.action = c.action GROUP BY l.song, l.step""", LOG)
def tool_coverage(t):
    out = L.tool_coverage(t.search_log(), [*ACTIONS, "refund"])
    return out.select("song", "step", F.array_join("tried", ",").alias("tried"), F.array_join("untried", ",").alias("untried"))


@query("recent", """
    SELECT song, step, accepted, action, CAST(rn AS INT) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY song, accepted
    ORDER BY step DESC) AS rn FROM replayed) WHERE rn <= 4""", REP)
def recent(t):
    return L.recent(t.replayed(), 4).select("song", "step", "accepted", "action", "recency")


@query("diverse_recent", """
    WITH a AS (SELECT * FROM replayed WHERE accepted),
         k AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY step DESC) AS n FROM (SELECT *, row_number()
               OVER (PARTITION BY song, action ORDER BY step DESC) AS per FROM a) WHERE per <= 1),
         s AS (SELECT * FROM k WHERE n <= 3)
    SELECT s.song, s.step, s.action, (SELECT count(*) FROM a WHERE a.song = s.song) -
           (SELECT count(*) FROM s x WHERE x.song = s.song) AS hidden FROM s""", REP)
def diverse_recent(t):
    return L.diverse_recent(t.replayed(), 1, 3).select("song", "step", "action", "hidden")


@query("distinct_rejected", f"""
    SELECT song, sig, first_step, n_proposed FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY first_step DESC)
      AS r FROM (SELECT song, {SIG} AS sig, min(step) AS first_step, count(*) AS n_proposed FROM replayed
                 WHERE NOT accepted GROUP BY 1, 2)) WHERE r <= 5""", REP)
def distinct_rejected(t):
    return L.distinct_rejected(sig(t.replayed()), 5)


@query("last_outcome", """
    SELECT song, step, CASE lag(accepted) OVER w WHEN true THEN 'accepted' WHEN false THEN 'rejected' END AS last_outcome,
           lag(action) OVER w AS last_action, lag(reward) OVER w AS last_reward
    FROM replayed WINDOW w AS (PARTITION BY song ORDER BY step)""", REP)
def last_outcome(t):
    return L.last_outcome(t.replayed()).select("song", "step", "last_outcome", "last_action", "last_reward")


@query("forbidden_now", f"""
    WITH {EPOCH} SELECT song, sig, first_step FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY first_step DESC)
      AS r FROM (SELECT song, sig, min(step) AS first_step FROM (SELECT *, max(CASE WHEN accepted THEN step ELSE -1 END)
      OVER (PARTITION BY song) AS la FROM e) WHERE step > la GROUP BY song, sig)) WHERE r <= 6""", REP)
def forbidden_now(t):
    return L.forbidden_now(sig(t.replayed()), 6)


@query("chain_prefix", """
    SELECT song, count(*) AS chain_length, max(step) AS last_step, max_by(pq, step) AS pq, max_by(sb, step) AS sb,
           max_by(reward, step) AS reward FROM replayed WHERE accepted AND step < 20 GROUP BY song""", REP)
def chain_prefix(t):
    return L.chain_prefix(t.replayed(), 20)


@query("progress_snapshots", """
    WITH s AS (SELECT song, step, best_before FROM replayed WHERE step % 25 = 0),
         m AS (SELECT s.song, s.step, r.action, count(*) AS n FROM s JOIN replayed r ON r.song = s.song AND r.step < s.step
               AND r.accepted GROUP BY ALL)
    SELECT s.song, s.step, coalesce(CAST(sum(n) AS BIGINT), 0) AS n_accepted, any_value(best_before) AS best,
           coalesce(string_agg(action || ':' || n, ',' ORDER BY action), '') AS mix
    FROM s LEFT JOIN m ON s.song = m.song AND s.step = m.step GROUP BY s.song, s.step""", REP)
def progress_snapshots(t):
    out = L.progress_snapshots(t.replayed(), 25, ACTIONS, 10.0)
    mix = F.array_join(F.transform("mix", lambda m: F.concat(m["action"], F.lit(":"), m["n"].cast("string"))), ",")
    return out.withColumn("mix", mix)


@query("best_iteration", """
    SELECT song, step AS best_step, reward AS best_reward FROM (SELECT *, row_number() OVER (PARTITION BY song
    ORDER BY reward DESC, step) AS r FROM search_log) WHERE r = 1""", LOG)
def best_iteration(t):
    return L.best_iteration(t.search_log())


DECISION = """CASE action WHEN 'click' THEN 'accept' WHEN 'view' THEN 'weak' WHEN 'error' THEN 'rollback'
              WHEN 'signup' THEN 'rollback' ELSE 'accept' END"""
SCOPE = "CASE CAST(sb AS BIGINT) % 4 WHEN 0 THEN 'static' WHEN 1 THEN 'master' WHEN 2 THEN 'section' END"


def decisions(t):
    return t.search_log().withColumns({"decision": F.expr(DECISION), "scope": F.expr(SCOPE)})


@query("stop_step", f"""
    WITH d AS (SELECT *, {DECISION} AS decision FROM search_log),
         r AS (SELECT *, step - coalesce(max(CASE WHEN decision NOT IN ('rollback', 'weak') THEN step END)
               OVER (PARTITION BY song ORDER BY step), -1) AS run FROM d)
    SELECT song, min(step) AS stop_step, CASE WHEN min(step) >= 30 THEN 'max_iterations' ELSE 'patience' END AS stop_reason
    FROM r WHERE run >= 5 OR step >= 30 GROUP BY song""", LOG)
def stop_step(t):
    return L.stop_step(decisions(t), 5, 30)


@query("recovery_rate", f"""
    WITH d AS (SELECT song, row_number() OVER (PARTITION BY song ORDER BY step) AS n, {DECISION} AS decision, coalesce({SCOPE}, '') AS scope
           FROM (SELECT * REPLACE (step + step // 7 AS step) FROM search_log)),
         r AS (SELECT song, n, EXISTS (SELECT 1 FROM d a WHERE a.song = d.song AND a.n BETWEEN d.n + 1 AND d.n + 3
               AND a.decision = 'accept' AND a.scope <> d.scope) AS ok FROM d WHERE decision = 'rollback')
    SELECT song, count(*) AS n_rollbacks, count(*) FILTER (ok) AS n_recovered, round(avg(ok::INT), 6) AS rec
    FROM r GROUP BY song""", LOG)
def recovery_rate(t):
    return L.recovery_rate(decisions(t).withColumn("step", F.col("step") + F.floor(F.col("step") / 7)), 3).withColumn("rec", F.round("rec", 6))


RESOLUTION = "CASE turn % 5 WHEN 0 THEN 'global' WHEN 1 THEN 'section' WHEN 2 THEN 'short_term' WHEN 3 THEN 'momentary' END"
CALLS = [("ti", "apply_static_eq"), ("on", "apply_section_gain"), ("ou", "apply_dynamic_eq"), ("que", "apply_master_limiter"),
         ("er", "score_ear")]


def turns(t):
    calls = F.filter(F.array(*[F.when(F.contains("text", F.lit(w)), F.lit(c)) for w, c in CALLS]), lambda x: x.isNotNull())
    return t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"),
                                  F.expr(RESOLUTION).alias("target_resolution"), F.col("text").alias("target_scope"),
                                  calls.alias("tool_calls"))


TURNS_SQL = f"""turns AS (SELECT conv_id || '-' || turn AS turn_id, {RESOLUTION} AS tr, text AS ts,
    list_filter([{', '.join(f"CASE WHEN contains(text, '{w}') THEN '{c}' END" for w, c in CALLS)}], lambda x: x IS NOT NULL)
    AS calls FROM conversations)"""


@query("scope_alignment", f"""
    WITH {TURNS_SQL}, u AS (SELECT turn_id, tr, unnest(calls) AS c FROM turns WHERE tr IS NOT NULL),
    k AS (SELECT turn_id, bool_or((tr = 'global' AND c IN ('apply_static_eq', 'apply_master_limiter')) OR
            (tr = 'section' AND c = 'apply_section_gain') OR (tr = 'short_term' AND c = 'apply_dynamic_eq') OR
            (tr = 'momentary' AND c = 'apply_master_limiter')) AS ok FROM u WHERE c <> 'score_ear' GROUP BY turn_id)
    SELECT count(*) FILTER (ok) AS aligned, count(*) AS counted, round(avg(ok::INT), 6) AS sra FROM k""")
def scope_alignment(t):
    from scoreloom.functions import tables as TB
    scopes = t.spark.createDataFrame(list(TB.ACTION_SCOPES.items()), "name string, scope string")
    aligned = t.spark.createDataFrame([(r, s) for r, ss in TB.ALIGNED_SCOPES.items() for s in ss],
                                      "resolution string, scope string")
    return L.scope_alignment(turns(t), scopes, aligned).withColumn("sra", F.round("sra", 6))


@query("section_diagnoses", f"""
    WITH {TURNS_SQL} SELECT count(*) FILTER (s) AS dps, count(*) AS n_turns, round(avg(s::INT), 6) AS dps_rate FROM
    (SELECT coalesce(tr = 'section', false) OR regexp_matches(lower(ts), 'verse|chorus|bridge|intro|outro|section') AS s
     FROM turns WHERE len(calls) > 0 OR tr IS NOT NULL)""")
def section_diagnoses(t):
    return L.section_diagnoses(turns(t)).withColumn("dps_rate", F.round("dps_rate", 6))


def costs(t):
    return t.orders.select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("source"), "o_orderkey",
                           F.round(F.col("o_totalprice") * 100).cast("bigint").alias("usd"))


@query("budget_breach", """
    SELECT *, CASE WHEN spent_run > 200000000 THEN 'per_run' WHEN spent_total > 200000000000 THEN 'total' END AS breach FROM
    (SELECT o_orderkey, o_custkey AS run, CAST(sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS spent_run,
            CAST(sum(c) OVER (ORDER BY o_orderkey) AS BIGINT) AS spent_total
     FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders))""")
def budget_breach(t):
    out = L.budget_breach(costs(t), 200000000, 200000000000, ["o_orderkey"], F.floor(F.col("o_orderkey") / 100000).cast("bigint"))
    return out.select("o_orderkey", "run", "spent_run", "spent_total", "breach")


@query("first_breach", """
    SELECT run, o_orderkey, breach, spent_run FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY o_orderkey) AS r FROM
    (SELECT *, CASE WHEN spent_run > 200000000 THEN 'per_run' WHEN spent_total > 200000000000 THEN 'total' END AS breach FROM
    (SELECT o_orderkey, o_custkey AS run, CAST(sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS spent_run,
            CAST(sum(c) OVER (ORDER BY o_orderkey) AS BIGINT) AS spent_total
     FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders))) WHERE breach IS NOT NULL) WHERE r = 1""")
def first_breach(t):
    out = L.budget_breach(costs(t), 200000000, 200000000000, ["o_orderkey"], F.floor(F.col("o_orderkey") / 100000).cast("bigint"))
    return L.first_breach(out, ["o_orderkey"]).select("run", "o_orderkey", "breach", "spent_run")


@query("spend_by_source", """
    SELECT o_orderpriority AS source, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spent
    FROM orders GROUP BY 1""")
def spend_by_source(t):
    return L.spend_by_source(costs(t))


def plan(t):
    return t.customer.select(F.col("c_custkey").alias("song"), F.col("c_mktsegment").alias("split"))


SPLITS = ["HOUSEHOLD", "BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE"]
PLAN_SQL = f"""p AS (SELECT c_custkey AS song, c_mktsegment AS split, row_number() OVER (ORDER BY list_position({SPLITS},
               c_mktsegment), c_custkey) - 1 AS song_index FROM customer)"""


def indexed(t):
    rank = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    return L.song_index(plan(t), rank, "song", F.floor(F.col("song") / 100000).cast("bigint"))


@query("song_index", f"WITH {PLAN_SQL} SELECT song, split, song_index FROM p")
def song_index(t):
    return indexed(t).select("song", "split", "song_index")


@query("plan_chunk", f"WITH {PLAN_SQL} SELECT song, song_index FROM p WHERE song_index >= 100 AND song_index < 220")
def plan_chunk(t):
    return L.plan_chunk(indexed(t), 100, 120).select("song", "song_index")


@query("select_songs", """
    SELECT DISTINCT o_custkey AS song, o_orderstatus AS split FROM orders WHERE o_orderstatus = 'F'
      AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
    ORDER BY 1 LIMIT 200""")
def select_songs(t):
    songs = t.orders.select(F.col("o_custkey").alias("song"), F.col("o_orderstatus").alias("split")).distinct()
    tiers = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("song"))
    return L.select_songs(songs, "F", tiers, 200)


RESEND = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("dedupe_last", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey,
    l_linenumber ORDER BY {', '.join(c + ' DESC' for c in RESEND)}) AS r FROM lineitem) WHERE r = 1""")
def dedupe_last(t):
    return L.dedupe_last(t.lineitem, ["l_orderkey", "l_linenumber"], RESEND).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("dedupe_counts", """
    SELECT count(*) AS n_records, count(DISTINCT (l_orderkey, l_linenumber)) AS n_unique,
           count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_dropped FROM lineitem""")
def dedupe_counts(t):
    return L.dedupe_counts(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("dedupe_first", f"""
    WITH x AS (SELECT *, CASE WHEN l_orderkey % 50 = 0 THEN ' ' ELSE CAST(l_orderkey AS VARCHAR) END AS pid FROM lineitem)
    SELECT pid, l_orderkey, l_linenumber, l_partkey, l_suppkey, blank_id FROM (
      SELECT *, false AS blank_id, row_number() OVER (PARTITION BY pid ORDER BY l_linenumber, {', '.join(RESEND)}) AS r
      FROM x WHERE trim(pid) <> '') WHERE r = 1
    UNION ALL SELECT pid, l_orderkey, l_linenumber, l_partkey, l_suppkey, true FROM x WHERE trim(pid) = ''""")
def dedupe_first(t):
    pid = F.when(F.col("l_orderkey") % 50 == 0, " ").otherwise(F.col("l_orderkey").cast("string"))
    out = L.dedupe_first(t.lineitem.withColumn("pid", pid), "pid", ["l_linenumber", *RESEND])
    return out.select("pid", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "blank_id")


@query("center_within", """
    SELECT listener, song, condition, screen, score, round(coalesce(x - avg(x) OVER (PARTITION BY listener), 0), 6) AS centered
    FROM (SELECT *, CASE WHEN screen > 0 THEN CAST(screen AS DOUBLE) END AS x FROM ratings)""", ["ratings"])
def center_within(t):
    r = t.ratings().withColumn("x", F.when(F.col("screen") > 0, F.col("screen").cast("double")))
    return L.center_within(r, "x", ["listener"]).select("listener", "song", "condition", "screen", "score",
                                                        F.round("centered", 6).alias("centered"))


@query("rank_no_ties", """
    SELECT doc_id, row_number() OVER (ORDER BY quality, doc_id) - 1 AS quality_rank,
           row_number() OVER (PARTITION BY toxic ORDER BY quality, doc_id) - 1 AS rank_in_toxic FROM labels""")
def rank_no_ties(t):
    out = L.rank_no_ties(t.labels, [], "quality", "doc_id", name="quality_rank")
    return L.rank_no_ties(out, ["toxic"], "quality", "doc_id", name="rank_in_toxic").select(
        "doc_id", "quality_rank", "rank_in_toxic")
