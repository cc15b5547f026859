"""User extension queries."""

from pyspark.sql import functions as F

from scoreloom.functions import plugins as P
from scoreloom.functions.tables import ROLE_KEYWORDS
from scoreloom.operators import calibration as C
from scoreloom.operators import rules as R
from scoreloom.plans.q_aggregates import r6
from scoreloom.plans.q_rules import FIRED, LI, prev_cur, proposals
from scoreloom.plans.q_scalars import sql_keywords
from scoreloom.plans.registry import query


@query("register_reward", "SELECT song, round(avg(2 * z_pq - z_sb * z_sb), 6) AS r FROM zpool GROUP BY 1", ["pool", "calib", "zpool"])
def register_reward(t):
    C.register_reward("curved", lambda p, s, gain=2.0: gain * p - s * s)
    return r6(t.zpool().groupBy("song").agg(F.avg(C.reward("curved")).alias("r")), "r")


@query("register_metric", """SELECT event_id, CASE WHEN k <> 13 THEN round(value / (k - 13.0::DOUBLE), 9) END AS score, k = 13 AS warned FROM (SELECT event_id, value,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def register_metric(t):
    def ratio(v, k):
        if (k == 13).any():
            raise ZeroDivisionError("k is 13")
        return v / (k - 13)
    P.register_metric("ratio", ratio, ["value", "k"])
    e = t.events.select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    out = e.select("event_id", P.metric("ratio").alias("m"))
    return out.select("event_id", F.round("m.score", 9).alias("score"), F.col("m.warning").isNotNull().alias("warned"))


@query("register_rule", f"WITH {FIRED} SELECT song, step, rule, priority FROM fired WHERE rule <> 'stereo' UNION ALL SELECT song, step, 'steady', 9 FROM pc WHERE abs(c_pq - p_pq) < 0.01",
       ["search_log"])
def register_rule(t):
    quiet = lambda c, p: F.abs(c("audiobox.PQ") - p("audiobox.PQ")) < 0.01
    R.register_rule(R.Rule("steady", quiet, "rollback", 9, target="best"))
    rules = [r for r in R.default_rules() if r.name != "stereo"]
    R._EXTRA.clear()
    df = prev_cur(t).withColumns({"stems": F.array(F.lit("drums")), "sections": F.create_map().cast("map<string,double>")})
    return R.advise(df, rules).select("song", "step", "rule", "priority")


@query("register_role_table", f"SELECT p_partkey, {sql_keywords('p_name', [*ROLE_KEYWORDS[:3], ('spin', ['gear', 'widget'])])} AS role FROM part")
def register_role_table(t):
    roles = P.register_role_table(t.spark, "my_roles", [*ROLE_KEYWORDS[:3], ("spin", ["gear", "widget"])])
    return P.classify_by_table(t.part, "p_name", roles, ["p_partkey"])


@query("register_limits", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(CASE l_linenumber WHEN 2 THEN greatest(-1, least(1, l_quantity - 25)) ELSE l_quantity - 25 END, 6)
    AS gain_db FROM lineitem""")
def register_limits(t):
    limits = P.register_limits(t.spark, "my_limits", [("static_gain", "gain_db", -1.0, 1.0)])
    return R.clamp_to_limits(proposals(t), limits).select(*LI, F.round(F.element_at("args", "gain_db"), 6).alias("gain_db"))


@query("window_rows", """WITH i AS (SELECT c_custkey AS song, (c_custkey % 9) * 1.3::DOUBLE AS d FROM customer)
    SELECT song, w AS win_idx, w * 1.0::DOUBLE AS start_sec, w + 3.0::DOUBLE AS end_sec FROM (SELECT song, d, unnest(range(0, CAST(floor(d + 1e-6 - 3) AS BIGINT) + 1)) AS w FROM i
      WHERE d + 1e-6 >= 3) UNION ALL SELECT song, 0, 0.0, d FROM i WHERE d + 1e-6 < 3 AND d > 0.5""")
def window_rows(t):
    P.register_window_rows(t.spark)
    t.customer.select(F.col("c_custkey").alias("song"), (F.col("c_custkey") % 9 * 1.3).cast("double").alias("d")).createOrReplaceTempView("scoreloom_items")
    return t.spark.sql("SELECT song, w.* FROM scoreloom_items, LATERAL window_rows(d, 3.0D, 1.0D) w")


@query("sql_functions", """SELECT toxic, round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS lo,
      round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS hi, round((k / n - 0.5) / 0.25, 6) AS z,
      round(least(k / n, 0.4), 6) AS m, round(0.25 * k / n + 0.75 * 0.4, 6) AS w, round(k / n - 0.5 * abs(k / n - 0.4), 6) AS p
    FROM (SELECT toxic, sum(quality)::DOUBLE AS k, count(*)::DOUBLE AS n, 1.959963985 AS z FROM labels GROUP BY 1)""")
def sql_functions(t):
    P.register_sql(t.spark)
    t.labels.createOrReplaceTempView("scoreloom_labels")
    return t.spark.sql("""SELECT toxic, round(wilson_lo(k, n), 6) AS lo, round(wilson_hi(k, n), 6) AS hi, round(z_score(k / n, 0.5D, 0.25D), 6) AS z,
        round(reward_min(k / n, 0.4D), 6) AS m, round(reward_weighted(k / n, 0.4D, 0.25D), 6) AS w, round(reward_penalized(k / n, 0.4D, 0.5D), 6) AS p
        FROM (SELECT toxic, CAST(sum(quality) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM scoreloom_labels GROUP BY toxic)""")
