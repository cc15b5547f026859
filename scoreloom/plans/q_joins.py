"""Join queries."""

from pyspark.sql import functions as F

from scoreloom.operators import joins as J
from scoreloom.operators.raters import rater_pairs as rater_pairs_of
from scoreloom.plans.q_aggregates import r6
from scoreloom.plans.registry import query


@query("deblind", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_suppkey % 22 AS song, 'c' || l_suppkey % 8 AS condition
    FROM lineitem WHERE l_suppkey % 5 <> 0""")
def deblind(t):
    k = F.col("s_suppkey")
    m = t.supplier.where(k % 5 != 0).select(
        F.when(k % 2 == 0, F.concat(F.lit("audio/b"), k.cast("string"), F.lit(".opus"))).otherwise(F.concat(F.lit("b"), k.cast("string")))
        .alias("key"), (k % 22).alias("song"), F.concat(F.lit("c"), (k % 8).cast("string")).alias("condition"))
    r = t.lineitem.withColumn("blind_key", F.concat(F.lit("audio/b"), F.col("l_suppkey").cast("string"), F.lit(".opus")))
    return J.deblind(r, m).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "song", "condition")


@query("resolve_song", """SELECT o_orderkey, CASE WHEN c_nationkey < 12 THEN c_name ELSE 't' || o_custkey END AS song
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def resolve_song(t):
    trial = lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    m = t.customer.where("c_nationkey < 12").select(trial("c_custkey").alias("trial_id"), F.col("c_name").alias("song"))
    return J.resolve_song(t.orders.select("o_orderkey", trial("o_custkey").alias("song")), m)


@query("pair_arms", """SELECT a.song, round(a.pq, 9) AS pq_a, round(b.pq, 9) AS pq_b FROM song_arms a JOIN song_arms b ON a.song = b.song
    WHERE a.run = '1-URGENT' AND b.run = '5-LOW'""", ["arms", "song_arms"])
def pair_arms(t):
    s = t.song_arms()
    out = J.pair_arms(s.where("run = '1-URGENT'"), s.where("run = '5-LOW'"), ["song"], ["pq"])
    return r6(out, "pq_a", "pq_b", digits=9)


@query("pair_all_arms", """SELECT run, song FROM song_arms WHERE song IN (SELECT song FROM song_arms GROUP BY 1 HAVING count(DISTINCT run) = 5)""",
       ["arms", "song_arms"])
def pair_all_arms(t):
    runs = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return J.pair_all_arms(t.song_arms(), runs, ["song"]).select("run", "song")


@query("arm_gap", """WITH a AS (SELECT DISTINCT song FROM arms WHERE run = '1-URGENT'), b AS (SELECT DISTINCT song FROM arms WHERE run = '5-LOW'),
    x AS (SELECT 'only_a' AS side, song FROM a WHERE song NOT IN (SELECT song FROM b) UNION ALL
          SELECT 'only_b', song FROM b WHERE song NOT IN (SELECT song FROM a)),
    r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY song) AS i FROM x)
    SELECT side, count(*) AS n, string_agg(song, ',' ORDER BY song) FILTER (i <= 3) AS sample FROM r GROUP BY 1""", ["arms"])
def arm_gap(t):
    a = t.arms()
    out = J.arm_gap(a.where("run = '1-URGENT'"), a.where("run = '5-LOW'"), ["song"])
    return out.withColumn("sample", F.array_join(F.transform("sample", lambda s: s["song"].cast("string")), ","))


@query("pending", """SELECT c_custkey AS song FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders
    WHERE o_orderkey % 7 IN (0, 1))""")
def pending(t):
    rec = t.orders.select(F.col("o_custkey").alias("song"), F.when(F.col("o_orderkey") % 7 == 0, "done")
                          .when(F.col("o_orderkey") % 7 == 1, "excluded").otherwise("error").alias("status"))
    return J.pending(t.customer.select(F.col("c_custkey").alias("song")), rec)


def run_seeds(t, run):
    """Corruption rows per (song, seed) of a run; planted breaks by song number in the second and third run."""
    s, i = F.col("o_custkey"), F.col("seed_idx")
    base = t.orders.select("o_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("seed_idx")).distinct()
    shift = F.lit(0.0)
    if run > 0:
        base = base.where((s % 23 != run) | (i == 0)).where(s % 29 != run)
        shift = F.when(s % 19 == run, 1e-6).otherwise(0.0)
    gains = F.create_map(F.lit("bass"), (s % 10) / 10 + shift, F.lit("drums"), (s % 7) / 7.0)
    return base.select(s.alias("song"), "seed_idx", (s * 100 + i).alias("seed"),
                       F.when((s % 31 != 5) | F.lit(run == 0), (s % 5) / 5).alias("common_gain"), gains.alias("gains"),
                       (s % 13 + i * F.lit(0.5)).alias("dry_pq"), F.lit(-14.0).alias("norm"))


CRN = """crn AS (SELECT DISTINCT o_custkey AS song, r.run, CASE WHEN o_custkey % 29 = r.run THEN 0 WHEN o_custkey % 23 = r.run THEN 1 ELSE 2 END
    AS n_paired, o_custkey % 29 <> r.run AND o_custkey % 23 <> r.run AND o_custkey % 19 <> r.run AND o_custkey % 31 <> 5 AS identical
    FROM orders, (SELECT unnest([1, 2]) AS run) r)"""


@query("crn_parity", f"WITH {CRN} SELECT song, CAST(n_paired AS BIGINT) AS n_paired, identical FROM crn WHERE run = 1")
def crn_parity(t):
    return J.crn_parity(run_seeds(t, 0), run_seeds(t, 1))


POOL = f"""{CRN}, c1 AS (SELECT * FROM crn WHERE run = 1), c2 AS (SELECT * FROM crn WHERE run = 2),
    pl AS (SELECT c1.song, CASE WHEN c1.n_paired = 0 THEN 'missing_in_b' WHEN NOT c1.identical THEN 'crn_break_b'
      WHEN c2.n_paired = 0 THEN 'missing_in_c' WHEN NOT c2.identical THEN 'crn_break_c' WHEN c1.song % 10 = 3 THEN 'missing_wav' END
      AS dropped_for FROM c1 JOIN c2 ON c1.song = c2.song)"""


def pool(t):
    base = run_seeds(t, 0)
    others = [("b", J.crn_parity(base, run_seeds(t, 1))), ("c", J.crn_parity(base, run_seeds(t, 2)))]
    files = t.customer.select(F.col("c_custkey").alias("song"), F.explode(F.array(F.lit("dry"), F.lit("min"))).alias("condition"))
    files = files.where((F.col("song") % 10 != 3) | (F.col("condition") == "dry"))
    return J.build_pool(base.withColumn("split", F.lit("test")), others, files, ["dry", "min"])


@query("build_pool", f"WITH {POOL} SELECT song, 'test' AS split, dropped_for FROM pl")
def build_pool(t):
    return pool(t)


@query("pool_reasons", f"WITH {POOL} SELECT coalesce(dropped_for, 'usable') AS reason, count(*) AS n FROM pl GROUP BY 1")
def pool_reasons(t):
    return J.pool_reasons(pool(t))


@query("keep_listeners", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN
    (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def keep_listeners(t):
    kept = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return J.keep_listeners(t.lineitem, kept, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("excerpt_start", """SELECT o_orderkey AS song, CASE WHEN k % 4 = 0 AND k % 3 > 0 AND k % 5 > 0 THEN k % 50 / 1.0
      WHEN k % 6 < 3 THEN k % 40 / 2.0 ELSE greatest(0, (d - 30) / 2) END AS start_sec,
      CASE WHEN k % 4 = 0 AND k % 3 > 0 AND k % 5 > 0 THEN 'index' WHEN k % 6 < 3 THEN CASE WHEN k % 9 = 0
        THEN 'analyse_song(excluded:quiet)' ELSE 'analyse_song' END ELSE 'centered_fallback' END AS origin
    FROM (SELECT o_orderkey, o_orderkey AS k, day(o_orderdate) * 4.0::DOUBLE AS d FROM orders)""")
def excerpt_start(t):
    k = F.col("o_orderkey")
    songs = t.orders.select(k.alias("song"), (F.dayofmonth("o_orderdate") * 4.0).alias("duration_sec"))
    index = t.orders.where(k % 4 == 0).select(k.alias("song"), (k % 50).cast("double").alias("start_sec"),
                                              F.when(k % 5 == 0, 20.0).otherwise(30.0).alias("length_sec"), (k % 3 == 0).alias("excluded"))
    an = t.orders.where(k % 6 < 3).select(k.alias("song"), (k % 40 / 2.0).alias("start_sec"), (k % 9 == 0).alias("excluded"),
                                          F.when(k % 9 == 0, "quiet").alias("exclude_reason"))
    return J.excerpt_start(songs, index, an, 30.0).select("song", "start_sec", "origin")


SECTIONS = """sec AS (SELECT song, e AS start_sec, coalesce(lead(e) OVER (PARTITION BY song ORDER BY e), 1e7) AS end_sec,
      'label_' || event_id % 6 AS label FROM (SELECT song, t_sec AS e, event_id FROM frames WHERE stem = 'signup'))"""


def sections(t):
    from scoreloom.operators.series import section_windows
    b = t.frames().where("stem = 'signup'").select("song", F.col("t_sec").alias("start_sec"),
                                                   F.concat(F.lit("label_"), (F.col("event_id") % 6).cast("string")).alias("label"))
    ends = t.frames().groupBy("song").agg(F.lit(1e7).alias("end_sec"))
    return section_windows(b, ends, ["song"])


@query("assign_sections", f"""WITH {SECTIONS} SELECT f.event_id, sec.label FROM frames f LEFT JOIN sec ON f.song = sec.song
    AND f.t_sec >= sec.start_sec AND f.t_sec < sec.end_sec""", ["frames"])
def assign_sections(t):
    out = J.assign_sections(t.frames(), sections(t), width=86400.0)
    return out.select("event_id", "label")


@query("nearest_event", """WITH s AS (SELECT song, event_id, t_sec FROM frames WHERE stem <> 'click'),
    e AS (SELECT song, t_sec AS e FROM frames WHERE stem = 'click'),
    r AS (SELECT s.event_id, s.t_sec, e.e, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(e.e - s.t_sec), e.e) AS i
          FROM s LEFT JOIN e ON s.song = e.song)
    SELECT event_id, round(CASE WHEN abs(e - t_sec) <= 7200 THEN e ELSE t_sec END, 6) AS snapped_sec,
           coalesce(abs(e - t_sec) <= 7200, false) AS snapped FROM r WHERE i = 1""", ["frames"])
def nearest_event(t):
    f = t.frames()
    out = J.nearest_event(f.where("stem <> 'click'").select("song", "event_id", "t_sec"),
                          f.where("stem = 'click'").select("song", "t_sec"), ["song"], "t_sec", "t_sec", 7200.0, width=86400.0)
    return out.select("event_id", F.round("snapped_sec", 6).alias("snapped_sec"), "snapped")


AFC = """afc AS (SELECT user_id AS listener, event_id AS pair_index, CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS song,
      CASE WHEN event_type IN ('click', 'view') THEN 'proposed' WHEN event_type <> 'error' THEN 'professional' END AS choice,
      event_id % 5 = 0 AS is_repeat, CASE WHEN event_id % 10 = 0 THEN event_id - 37 END AS repeat_of, value AS dur FROM events),
    orig AS (SELECT * FROM afc WHERE choice IS NOT NULL AND NOT is_repeat),
    rep AS (SELECT r.listener, r.pair_index, r.choice, coalesce(o.choice, (SELECT min_by(x.choice, x.pair_index) FROM orig x
      WHERE x.listener = r.listener AND x.song = r.song)) AS original_choice FROM afc r LEFT JOIN orig o ON o.listener = r.listener
      AND o.pair_index = r.repeat_of WHERE r.choice IS NOT NULL AND r.is_repeat)"""


def afc(t):
    e, k = t.events, F.get_json_object("props", "$.k").cast("bigint")
    choice = F.when(F.col("event_type").isin("click", "view"), "proposed").when(F.col("event_type") != "error", "professional")
    return e.select(F.col("user_id").alias("listener"), F.col("event_id").alias("pair_index"), (k % 12).alias("song"),
                    choice.alias("choice"), (F.col("event_id") % 5 == 0).alias("is_repeat"),
                    F.when(F.col("event_id") % 10 == 0, F.col("event_id") - 37).alias("repeat_of"), F.col("value").alias("dur"))


@query("match_repeats", f"WITH {AFC} SELECT listener, pair_index, choice, original_choice FROM rep")
def match_repeats(t):
    return J.match_repeats(afc(t)).select("listener", "pair_index", "choice", "original_choice")


GENRE = "CASE p_type WHEN 'STANDARD' THEN 'rock' WHEN 'PROMO' THEN 'jazz' WHEN 'SMALL' THEN 'pop' ELSE lower(p_type) END"
ROLE = "CASE p_size % 4 WHEN 0 THEN 'vocal' WHEN 1 THEN 'brass' WHEN 2 THEN 'bass' ELSE 'theremin' END"


@query("policy_lookup", f"""SELECT p_partkey, CAST(CASE g WHEN 'rock' THEN CASE r WHEN 'vocal' THEN 2 WHEN 'bass' THEN 1 ELSE -1 END
      WHEN 'jazz' THEN CASE r WHEN 'vocal' THEN 1 WHEN 'bass' THEN 1 WHEN 'brass' THEN 1 ELSE 0 END
      WHEN 'pop' THEN CASE r WHEN 'vocal' THEN 3 WHEN 'bass' THEN 1 ELSE -1 END
      ELSE CASE r WHEN 'vocal' THEN 2 WHEN 'bass' THEN 1 ELSE -0.5 END END AS DOUBLE) AS value
    FROM (SELECT p_partkey, {GENRE} AS g, {ROLE} AS r FROM part)""")
def policy_lookup(t):
    from scoreloom.functions.tables import GENRE_POLICY
    policy = t.spark.createDataFrame([(g, r, v) for g, m in GENRE_POLICY.items() for r, v in m.items()],
                                     "genre string, role string, value double")
    p = t.part.select("p_partkey", F.expr(GENRE).alias("genre"), F.expr(ROLE).alias("role"))
    return J.policy_lookup(p, policy).select("p_partkey", "value")


CELLS = """cells AS (SELECT listener, song || '/' || condition AS item, max_by(score, (screen, score)) AS score FROM ratings GROUP BY 1, 2)"""


def cells(t):
    item = F.concat_ws("/", F.col("song").cast("string"), "condition")
    return J.rater_cells(t.ratings().withColumn("item", item), "listener", "item", "score", ["screen", "score"])


@query("rater_pairs", f"""WITH {CELLS} SELECT a.listener AS rater_a, b.listener AS rater_b, count(*) AS n_shared,
    round(avg(abs(a.score - b.score)), 6) AS mean_abs_diff FROM cells a JOIN cells b ON a.item = b.item AND a.listener < b.listener
    GROUP BY 1, 2""", ["ratings"])
def rater_pairs(t):
    return r6(rater_pairs_of(cells(t), "listener", "item", "score", rho=False), "mean_abs_diff")


# One subset (5) is missing from the grid; its parts count for subset 13, which has a fourth element.
GRID = "grid AS (SELECT CASE p_size % 8 WHEN 5 THEN 13 ELSE p_size % 8 END AS mask, avg(p_retailprice) AS value FROM part GROUP BY 1)"


def grid(t):
    mask = F.col("p_size") % 8
    return t.part.groupBy(F.when(mask == 5, 13).otherwise(mask).alias("mask")).agg(F.avg("p_retailprice").alias("value"))


@query("subset_pairs", f"""WITH {GRID} SELECT a.mask, a.mask + (1 << e) AS mask_with, e AS element, round(a.value, 6) AS value_without,
    round(b.value, 6) AS value_with FROM grid a, (SELECT unnest([0, 1, 2]) AS e) x, grid b
    WHERE (a.mask & (1 << e)) = 0 AND b.mask = a.mask + (1 << e)""")
def subset_pairs(t):
    return r6(J.subset_pairs(grid(t), 3), "value_without", "value_with").select(
        "mask", "mask_with", "element", "value_without", "value_with")


@query("score_delta", """WITH l AS (SELECT song, step, sb, CASE WHEN event_id % 6 > 0 THEN reward END AS reward FROM search_log)
    SELECT a.song, a.step, 'sb' AS key, b.sb - a.sb AS delta FROM l a JOIN l b ON a.song = b.song AND b.step = a.step + 1
    UNION ALL SELECT a.song, a.step, 'reward', round(b.reward - a.reward, 6) FROM l a JOIN l b ON a.song = b.song AND b.step = a.step + 1
    WHERE a.reward IS NOT NULL AND b.reward IS NOT NULL""", ["search_log"])
def score_delta(t):
    nan = F.lit(float("nan"))
    long = t.search_log().select("song", "step", F.inline(F.array(
        F.struct(F.lit("sb").alias("key"), F.col("sb").alias("value")),
        F.struct(F.lit("reward").alias("key"), F.when(F.col("event_id") % 6 > 0, F.col("reward")).otherwise(nan).alias("value")))))
    cur = long.withColumn("step", F.col("step") - 1)
    return r6(J.score_delta(long, cur, ["song", "step", "key"]), "delta")


@query("profile_distance", """WITH p AS (SELECT p_brand, p_type, avg(p_size) FILTER (p_partkey % 2 = 0) AS sa, avg(p_size)
      FILTER (p_partkey % 2 = 1) AS sb, avg(p_retailprice) FILTER (p_partkey % 2 = 0) AS ra, avg(p_retailprice) FILTER (p_partkey % 2 = 1)
      AS rb FROM part GROUP BY 1, 2)
    SELECT p_brand, round((avg(abs(sa - sb)) + avg(abs(ra - rb))) / 2, 6) AS distance FROM p GROUP BY 1""")
def profile_distance(t):
    def side(rest):
        g = t.part.where(F.col("p_partkey") % 2 == rest).groupBy("p_brand", F.col("p_type").alias("key")).agg(
            F.avg("p_size").alias("s"), F.avg("p_retailprice").alias("r"))
        return g.select("p_brand", "key", F.inline(F.array(F.struct(F.lit("size").alias("grp"), F.col("s").alias("value")),
                                                           F.struct(F.lit("price").alias("grp"), F.col("r").alias("value")))))
    return r6(J.profile_distance(side(0), side(1), ["p_brand"]), "distance")


@query("fingerprint_diff", """SELECT c_custkey, key, cv AS client_value, sv AS server_value FROM (
      SELECT c_custkey, 'proto' AS key, CAST(c_nationkey AS VARCHAR) AS cv, CASE WHEN c_custkey % 10 = 0 THEN '?' ELSE
        CAST(c_nationkey AS VARCHAR) END AS sv FROM customer
      UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 6 > 0 THEN c_mktsegment END,
        CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END FROM customer) WHERE cv IS DISTINCT FROM sv""")
def fingerprint_diff(t):
    def side(proto, segment, extra):
        e = F.array(F.struct(F.lit("proto").alias("key"), proto.alias("value")), F.struct(F.lit("segment").alias("key"), segment.alias("value")),
                    F.struct(F.lit("torch").alias("key"), F.lit(extra).alias("value")))
        return t.customer.select("c_custkey", F.inline(e))
    nk, k = F.col("c_nationkey").cast("string"), F.col("c_custkey")
    client = side(nk, F.when(k % 6 > 0, F.col("c_mktsegment")), "2.0")
    server = side(F.when(k % 10 == 0, "?").otherwise(nk), F.when(k % 4 > 0, F.col("c_mktsegment")), "2.1")
    return J.fingerprint_diff(client, server, ["c_custkey"], strict="proto", relax=["torch", "proto"])
