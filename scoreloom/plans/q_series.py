"""Time-series queries."""

from pyspark.sql import functions as F

from scoreloom.operators import series as X
from scoreloom.operators.scan import ordinal, time_block
from scoreloom.plans.q_aggregates import r6
from scoreloom.plans.q_joins import SECTIONS, sections
from scoreloom.plans.registry import query
from scoreloom.session import materialize

FR, LOG = ["frames"], ["search_log"]


@query("frame_rms", """WITH s AS (SELECT song, step, reward AS x FROM search_log), n AS (SELECT song, count(*) AS n FROM s GROUP BY 1),
    f AS (SELECT song, unnest(range(0, CAST((n - 8) // 3 + 1 AS BIGINT))) AS frame_idx FROM n WHERE n >= 8)
    SELECT f.song, f.frame_idx, round(10 * log10(greatest(avg(x * x), 1e-14)), 6) AS rms_db FROM f JOIN s ON s.song = f.song
    AND s.step >= f.frame_idx * 3 AND s.step < f.frame_idx * 3 + 8 GROUP BY 1, 2""", LOG)
def frame_rms(t):
    return r6(X.frame_rms(t.search_log(), ["song"], "step", "reward", 8, 3), "rms_db")


@query("sliding_windows", """WITH i AS (SELECT o_orderkey AS song, (o_orderkey % 9) * 1.3::DOUBLE AS d FROM orders)
    SELECT song, w AS win_idx, w * 1.0::DOUBLE AS start_sec, w + 3.0::DOUBLE AS end_sec FROM (SELECT song, d, unnest(range(0,
      CAST(floor(d + 1e-6 - 3) AS BIGINT) + 1)) AS w FROM i WHERE d + 1e-6 >= 3)
    UNION ALL SELECT song, 0, 0.0, d FROM i WHERE d + 1e-6 < 3 AND d > 0.5""")
def sliding_windows(t):
    i = t.orders.select(F.col("o_orderkey").alias("song"), (F.col("o_orderkey") % 9 * 1.3).alias("duration_sec"))
    return X.sliding_windows(i, 3.0, 1.0).select("song", "win_idx", "start_sec", "end_sec")


SHORT = """sh AS (SELECT song, w AS win_idx, count(*) AS n, 10 * log10(avg(level) + 1e-12) AS level_db FROM (SELECT song, t_sec, level,
      max(t_sec) OVER (PARTITION BY song) AS e, unnest(range(greatest(0, CAST(floor(t_sec / 21600) AS BIGINT) - 7),
      CAST(floor(t_sec / 21600) AS BIGINT) + 1)) AS w FROM frames) WHERE w * 21600 + 172800 <= e + 1e-9 GROUP BY 1, 2)"""


def short(t):
    return X.short_term_levels(t.frames(), ["song"], "t_sec", "level", 172800.0, 21600.0)


@query("short_term_levels", f"WITH {SHORT} SELECT song, win_idx, n, round(level_db, 6) AS level_db FROM sh", FR)
def short_term_levels(t):
    return r6(short(t), "level_db")


@query("level_trajectory", f"""WITH {SHORT} SELECT song, count(*) AS n_windows, round(avg(level_db), 6) AS mean,
    round(stddev_pop(level_db), 6) AS std, round(min(level_db), 6) AS min, round(max(level_db), 6) AS max FROM sh GROUP BY 1""", FR)
def level_trajectory(t):
    return r6(X.level_trajectory(short(t), ["song"]), "mean", "std", "min", "max")


@query("section_windows", f"""WITH {SECTIONS} SELECT song, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, label
    FROM sec WHERE end_sec > start_sec""", FR)
def section_windows(t):
    return r6(sections(t), "start_sec", "end_sec")


@query("moving_mean_std", """SELECT song, step, round(m, 6) AS mean, round(s, 5) AS std FROM (SELECT song, step, avg(sb) OVER w AS m,
    stddev_pop(sb) OVER w AS s, count(*) OVER w AS c FROM search_log WINDOW w AS (PARTITION BY song ORDER BY step ROWS BETWEEN
    CURRENT ROW AND 9 FOLLOWING)) WHERE c = 10""", LOG)
def moving_mean_std(t):
    out = X.moving_mean_std(t.search_log(), ["song"], "step", "sb", 10)
    return out.select("song", "step", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


@query("stem_presence", """SELECT event_id, round(least(rms_db - p, 0), 6) AS presence_db FROM frames JOIN (SELECT song, stem,
    quantile_cont(rms_db, 0.95) AS p FROM frames GROUP BY 1, 2) q ON frames.song = q.song AND frames.stem = q.stem""", FR)
def stem_presence(t):
    return r6(X.stem_presence(t.frames(), ["song", "stem"]).select("event_id", "presence_db"), "presence_db")


def stem_frames(t):
    """Ten items whose stems are the event types; ``purchase`` plays the mix."""
    e = t.events.select((F.col("user_id") % 10).alias("song"), F.when(F.col("event_type") == "purchase", "mixture")
                        .otherwise(F.col("event_type")).alias("stem"), "ts", "event_id", (20 * F.log10("value")).alias("rms_db"))
    f = ordinal(e, ["song", "stem"], [F.asc("ts"), F.asc("event_id")], time_block("ts", 86400))
    return materialize(f.select("song", "stem", (F.col("rn") - 1).alias("frame_idx"), "rms_db"), "stem-frames")


@query("best_excerpt", """WITH f AS (SELECT user_id % 10 AS song, CASE event_type WHEN 'purchase' THEN 'mixture' ELSE event_type END AS stem,
      CASE WHEN value > 0 THEN 20 * log10(value) END AS db, row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY ts, event_id) - 1 AS i FROM events),
    c AS (SELECT song, min(n) AS n, max(n) FILTER (stem = 'mixture') AS mn, count(*) AS k FROM (SELECT song, stem, count(*) AS n FROM f
      GROUP BY 1, 2) GROUP BY 1),
    l AS (SELECT *, CAST(round_even(0.15 * n, 0) AS BIGINT) AS lo0, least(CAST(round_even(0.88 * n, 0) AS BIGINT) - 40, 120) AS hi0 FROM c),
    r AS (SELECT song, n, mn, k, CASE WHEN hi0 <= lo0 THEN 0 ELSE lo0 END AS lo, CASE WHEN hi0 <= lo0 THEN least(n - 40, 120) ELSE hi0
      END AS hi FROM l),
    p AS (SELECT song, stem, quantile_cont(db, 0.95) AS p FROM f GROUP BY 1, 2),
    w AS (SELECT f.song, f.stem, i, avg(CASE f.stem WHEN 'mixture' THEN db ELSE least(db - p, 0) END) OVER v AS m,
      stddev_pop(db) OVER v AS s, count(*) OVER v AS c FROM f JOIN p ON f.song = p.song AND f.stem = p.stem JOIN r ON r.song = f.song
      WHERE i < n WINDOW v AS (PARTITION BY f.song, f.stem ORDER BY i ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING)),
    cand AS (SELECT w.song, i, min(m) FILTER (stem <> 'mixture') AS lowest, max(s) FILTER (stem = 'mixture') AS sd,
      count(*) FILTER (stem <> 'mixture' AND m >= -18) AS act FROM w JOIN r ON r.song = w.song WHERE c = 40 AND i >= lo AND i < hi
      GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY lowest - 0.25 * sd DESC, i) AS rk FROM cand)
    SELECT r.song, mn * 0.25::DOUBLE AS duration_sec, i * 0.25::DOUBLE AS start_sec, round(lowest - 0.25 * sd, 5) AS score_db, round(lowest, 5) AS min_stem_db,
      CAST(act AS INT) AS n_active_stems,
      CASE WHEN n <= 42 THEN 'too_short' WHEN act < 3 THEN 'only_' || act || '_active_stems' WHEN lowest < -30 THEN 'weakest_stem_too_quiet'
      END AS exclude_reason FROM r LEFT JOIN b ON r.song = b.song AND rk = 1""")
def best_excerpt(t):
    out = X.best_excerpt(stem_frames(t), ["click", "error", "signup", "view"], 10.0, max_end=40.0)
    return out.select("song", "duration_sec", "start_sec", F.round("score_db", 5).alias("score_db"),
                      F.round("min_stem_db", 5).alias("min_stem_db"), "n_active_stems", "exclude_reason")


@query("excerpt_bounds", """WITH s AS (SELECT o_orderkey AS song, o_custkey * 2.25::DOUBLE AS st, o_orderkey * 37 % 900000 AS total FROM orders)
    SELECT song, CASE WHEN 220500 >= total THEN 0 ELSE least(greatest(0, CAST(round_even(st * 22050, 0) AS BIGINT)), total - 220500) END AS start_n,
      CASE WHEN 220500 >= total THEN total ELSE 220500 END AS n_samples FROM s""")
def excerpt_bounds(t):
    s = t.orders.select(F.col("o_orderkey").alias("song"), (F.col("o_custkey") * 2.25).alias("start_sec"),
                        (F.col("o_orderkey") * 37 % 900000).alias("total_samples"))
    return X.excerpt_bounds(s, 10.0, 22050).select("song", "start_n", "n_samples")


@query("center_crop", """SELECT song, step FROM (SELECT song, step, count(*) OVER (PARTITION BY song) AS n FROM search_log)
    WHERE n <= 31 OR (step >= (n - 31) // 2 AND step < (n - 31) // 2 + 31)""", LOG)
def center_crop(t):
    return X.center_crop(t.search_log(), ["song"], "step", 31).select("song", "step")


@query("energy_boundaries", """WITH RECURSIVE d AS (SELECT song, step AS i, step * 1.0::DOUBLE AS t, abs(reward - lag(reward) OVER
      (PARTITION BY song ORDER BY step)) AS d, count(*) OVER (PARTITION BY song) AS n FROM search_log),
    pick(song, k, ts) AS (SELECT DISTINCT song, 0, CAST([] AS DOUBLE[]) FROM d WHERE n >= 8 UNION ALL
      SELECT p.song, p.k + 1, list_append(p.ts, (SELECT max_by(t, (d.d, d.i)) FROM d WHERE d.song = p.song AND d.d IS NOT NULL AND
        len(list_filter(p.ts, lambda x: abs(x - d.t) < 8)) = 0)) FROM pick p WHERE p.k < 3),
    f AS (SELECT song, list_sort(list_filter(ts, lambda x: x IS NOT NULL)) AS ts FROM pick WHERE k = 3)
    SELECT song, start_sec, ['verse_1', 'chorus_1', 'verse_2'][i] AS label FROM (SELECT song, unnest(ts) AS start_sec,
      generate_subscripts(ts, 1) AS i FROM f)
    UNION ALL SELECT DISTINCT song, 0.0, CASE WHEN n >= 8 THEN 'intro' ELSE 'whole' END FROM d""", LOG)
def energy_boundaries(t):
    from scoreloom.functions.tables import SECTION_LABELS
    f = t.search_log().withColumn("t", F.col("step").cast("double"))
    return X.energy_boundaries(f, ["song"], "step", "t", "reward", 4, 8.0, SECTION_LABELS)


@query("merge_boundaries", """WITH RECURSIVE b AS (SELECT song, t_sec AS t, max(t_sec) OVER (PARTITION BY song) + 30000 AS d FROM frames),
    k(song, t, d, i) AS (SELECT DISTINCT song, 0.0::DOUBLE, d, 0 FROM b UNION ALL
      SELECT k.song, (SELECT min(b.t) FROM b WHERE b.song = k.song AND b.t - k.t >= 43200), k.d, k.i + 1 FROM k
      WHERE EXISTS (SELECT 1 FROM b WHERE b.song = k.song AND b.t - k.t >= 43200)),
    l AS (SELECT *, max(i) OVER (PARTITION BY song) AS last FROM k)
    SELECT song, round(t, 6) AS start_sec, 'seg_' || i AS label FROM l WHERE NOT (i = last AND i > 0 AND d - t < 43200)""", FR)
def merge_boundaries(t):
    f = t.frames()
    ends = f.groupBy("song").agg((F.max("t_sec") + 30000).alias("duration_sec"))
    b = f.select("song", F.col("t_sec").alias("start_sec")).join(ends, "song")
    return r6(X.merge_boundaries(b, ["song"], 43200.0), "start_sec")


@query("stereo_stats", """SELECT l_suppkey, round(CASE WHEN stddev_pop(l) < 1e-7 OR stddev_pop(r) < 1e-7 THEN 1 ELSE corr(l, r) END, 6) AS correlation,
    round(20 * log10((sqrt(avg((l - r) * (l - r) / 4) + 1e-12) + 1e-12) / (sqrt(avg((l + r) * (l + r) / 4) + 1e-12) + 1e-12)), 6) AS ms_ratio_db
    FROM (SELECT l_suppkey, l_quantity - 25 AS l, l_discount * 200 + (l_quantity - 25) / 2 AS r FROM lineitem) GROUP BY 1""")
def stereo_stats(t):
    s = t.lineitem.select("l_suppkey", (F.col("l_quantity") - 25).alias("l"), (F.col("l_discount") * 200 + (F.col("l_quantity") - 25) / 2).alias("r"))
    return r6(X.stereo_stats(s, ["l_suppkey"], "l", "r"), "correlation", "ms_ratio_db")


@query("window_pool", """WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label)
      AS n, vec_id, embedding FROM embeddings),
    e AS (SELECT label, i // 8 AS w, unnest(range(1, 65)) AS d, unnest(embedding)::DOUBLE AS x FROM v WHERE i // 8 * 8 + 4 <= n OR i < 8),
    m AS (SELECT label, w, d, avg(x) AS x FROM e GROUP BY 1, 2, 3), p AS (SELECT label, d, avg(x) AS x, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT label, any_value(n) AS n_windows, round(sum(x * d), 6) AS checksum, round(sum(x * x), 9) AS norm2 FROM p GROUP BY 1""")
def window_pool(t):
    from scoreloom.functions.scalars import norm2
    v = ordinal(t.embeddings, ["label"], [F.asc("vec_id")], F.floor(F.col("vec_id") / 100000).cast("bigint"))
    p = X.window_pool(v.withColumn("i", F.col("rn") - 1), ["label"], "i", "embedding", 8, 4, 64)
    check = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return p.select("label", "n_windows", F.round(check, 6).alias("checksum"), F.round(norm2("embedding") * norm2("embedding"), 9).alias("norm2"))
