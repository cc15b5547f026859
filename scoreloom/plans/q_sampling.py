"""Sampling and distribution-table queries."""

from pyspark.sql import functions as F

from scoreloom.functions.scalars import hash_uniform
from scoreloom.functions.tables import ACTION_KIND_PROBS
from scoreloom.operators import sampling as M
from scoreloom.plans.q_aggregates import r6
from scoreloom.plans.registry import query


def sql_u(*parts: str) -> str:
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / pow(2, 52))"


@query("hash_uniform", f"SELECT event_id, {sql_u(7, 'event_id')} AS u FROM events")
def hash_u(t):
    return t.events.select("event_id", hash_uniform(F.lit(7), "event_id").alias("u"))


@query("sample_gains", f"""WITH s AS (SELECT c_custkey AS song_index, s.i AS seed_idx, 1000 + c_custkey * 100 + s.i AS seed, t.track FROM customer,
      (SELECT unnest([0, 1]) AS i) s, (SELECT unnest(['bass', 'drums', 'other', 'vocals']) AS track) t)
    SELECT song_index, seed_idx, seed, track, round(0.1 + 1.9 * {sql_u('seed', 'track')}, 9) AS linear,
      round(pow(10, (-43 + 25 * {sql_u('seed', 'track')}) / 20), 9) AS db FROM s""")
def sample_gains(t):
    songs = t.customer.select(F.col("c_custkey").alias("song_index"))
    tracks = ["vocals", "bass", "drums", "other"]
    lin = M.sample_gains(songs, 2, tracks, 0.1, 2.0, base=1000).withColumnRenamed("gain", "linear")
    return r6(lin.withColumn("db", M.gain(-43.0, -18.0, "db")), "linear", "db", digits=9)


@query("stratified_nested_sample", f"""WITH p AS (SELECT o_orderkey AS song, o_orderstatus AS split, {sql_u(42, 'o_orderkey')} AS u FROM orders),
    z AS (SELECT split, count(*) AS c, 500.0::DOUBLE * count(*) / (SELECT count(*) FROM p) AS raw FROM p GROUP BY 1),
    q AS (SELECT split, floor(raw) + (row_number() OVER (ORDER BY raw - floor(raw) DESC, split) <= 500 - (SELECT sum(floor(raw)) FROM z))::INT AS quota FROM z),
    r AS (SELECT p.*, row_number() OVER (PARTITION BY split ORDER BY u, song) AS draw FROM p)
    SELECT r.song, r.split, r.draw FROM r JOIN q ON q.split = r.split WHERE draw <= quota""")
def stratified(t):
    plan = t.orders.select(F.col("o_orderkey").alias("song"), F.col("o_orderstatus").alias("split"))
    return M.stratified_nested_sample(plan, 500, 42).select("song", "split", "draw")


@query("build_splits", """WITH s AS (SELECT c_custkey AS song, CASE c_nationkey % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'B' ELSE 'A' END AS tier,
      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'test' ELSE 'train' END AS source FROM customer)
    SELECT song, tier, CASE WHEN source = 'train' THEN 'train' WHEN tier <> 'C' AND half = 1 THEN 'dev' ELSE 'test' END AS split FROM
      (SELECT *, ntile(2) OVER (PARTITION BY source, tier ORDER BY song) AS half FROM s)""")
def build_splits(t):
    nk = F.col("c_nationkey") % 5
    s = t.customer.select(F.col("c_custkey").alias("song"), F.when(nk == 0, "C").when(nk == 1, "B").otherwise("A").alias("tier"),
                          F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "test").otherwise("train").alias("source"))
    return M.build_splits(s, "song", "tier", "source", F.floor(F.col("song") / 100000).cast("bigint")).select("song", "tier", "split")


CELLS = [("R0_S0", ["global"], ["static", "master"]), ("R4_S4", ["global", "section", "momentary"], ["static", "section", "dynamic"])]


@query("experiment_grid", """WITH c AS (SELECT unnest(['R0_S0', 'R4_S4']) AS cell, unnest(['global', 'global+section+momentary']) AS resolutions,
      unnest(['static+master', 'static+section+dynamic']) AS scopes)
    SELECT c_custkey AS song, cell, resolutions, scopes, seed, CASE cell WHEN 'R0_S0' THEN 1 ELSE 3 END + CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 0 END
      AS mask FROM customer, c, (SELECT unnest([42, 43, 44]) AS seed)""")
def experiment_grid(t):
    out = M.experiment_grid(t.customer.select(F.col("c_custkey").alias("song")), CELLS, [42, 43, 44])
    mask = M.element_mask([F.array_contains("resolutions", "global"), F.array_contains("resolutions", "section"), F.col("song") % 2 == 0])
    return out.select("song", "cell", F.array_join("resolutions", "+").alias("resolutions"), F.array_join("scopes", "+").alias("scopes"), "seed",
                      mask.alias("mask"))


MIXED = M.mix_in(ACTION_KIND_PROBS, "automation", 0.12)


def sql_draw(u: str) -> str:
    cum, arms = 0.0, []
    for kind, p in MIXED[:-1]:
        cum += p
        arms.append(f"WHEN {u} < {cum!r}::DOUBLE THEN '{kind}'")
    return f"CASE {' '.join(arms)} ELSE '{MIXED[-1][0]}' END"


@query("categorical_draw", f"SELECT event_id, {sql_draw('u')} AS kind FROM (SELECT event_id, {sql_u(3, 'event_id')} AS u FROM events)")
def categorical_draw(t):
    return t.events.select("event_id", M.categorical_draw(hash_uniform(F.lit(3), "event_id"), MIXED).alias("kind"))


RANGES = {("click", "k"): (0.0, 100.0), ("view", "k"): (0.0, 80.0), ("error", "k"): (10.0, 100.0), ("view", "v"): (0.0, 100.0), ("signup", "k"): (0.0, 50.0),
          ("purchase", "k"): (0.0, 100.0)}
PRIOR = """lg AS (SELECT event_type AS action, 'k' AS arg, CAST(json_extract(props, '$.k') AS DOUBLE) AS x, value - 20 AS gain FROM events
      UNION ALL SELECT event_type, 'v', value, value - 20 FROM events),
    rg AS (SELECT unnest(['click', 'view', 'error', 'view', 'signup', 'purchase']) AS action, unnest(['k', 'k', 'k', 'v', 'k', 'k']) AS arg, unnest([0.0, 0, 10, 0, 0, 0])::DOUBLE AS lo,
      unnest([100.0, 80, 100, 100, 50, 100])::DOUBLE AS hi),
    bn AS (SELECT rg.action, rg.arg, least(greatest(floor((x - lo) / (hi - lo) * 5), 0), 4) AS b, sum(gain) AS w FROM lg JOIN rg ON rg.action = lg.action
      AND rg.arg = lg.arg WHERE gain > 0 GROUP BY 1, 2, 3),
    prior AS (SELECT rg.action, rg.arg, CAST(i AS INT) AS bin_idx, lo + i * (hi - lo) / 5 AS bin_lo, lo + (i + 1) * (hi - lo) / 5 AS bin_hi,
      coalesce(w, 0) / (SELECT sum(w) FROM bn x WHERE x.action = rg.action AND x.arg = rg.arg) AS prob, lo AS legal_lo, hi AS legal_hi
      FROM rg CROSS JOIN range(0, 5) r(i) LEFT JOIN bn ON bn.action = rg.action AND bn.arg = rg.arg AND bn.b = i)"""


def prior(t):
    k = F.get_json_object("props", "$.k").cast("double")
    rows = F.array(F.struct(F.lit("k").alias("arg"), k.alias("value")), F.struct(F.lit("v").alias("arg"), F.col("value").alias("value")))
    log = t.events.select(F.col("event_type").alias("action"), F.inline(rows), (F.col("value") - 20).alias("gain"))
    return M.build_prior(log, RANGES, 5)


@query("build_prior", f"""WITH {PRIOR} SELECT action, arg, bin_idx, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, round(prob, 6) AS prob,
    legal_lo, legal_hi FROM prior""")
def build_prior(t):
    return r6(prior(t), "bin_lo", "bin_hi", "prob")


@query("histogram_draw", f"""WITH {PRIOR}, c AS (SELECT action, arg, bin_idx, bin_lo, bin_hi, legal_lo, legal_hi, sum(prob) OVER (PARTITION BY action, arg
      ORDER BY bin_idx) AS cum, row_number() OVER (PARTITION BY action, arg ORDER BY bin_idx DESC) AS last FROM prior),
    d AS (SELECT event_id, event_type AS action, CASE WHEN event_id % 10 > 0 THEN 'k' ELSE 'none' END AS arg, {sql_u(1, 'event_id')} AS u, {sql_u(2, 'event_id')} AS v FROM events)
    SELECT event_id, round(least(greatest(bin_lo + v * (bin_hi - bin_lo), legal_lo), legal_hi), 4) AS value FROM (SELECT d.event_id, v, c.* EXCLUDE (action, arg), row_number() OVER
      (PARTITION BY event_id ORDER BY bin_idx) AS r FROM d LEFT JOIN c ON c.action = d.action AND c.arg = d.arg WHERE u < cum OR last = 1 OR c.arg IS NULL) WHERE r = 1""")
def histogram_draw(t):
    e = t.events.select("event_id", F.col("event_type").alias("action"), F.when(F.col("event_id") % 10 > 0, "k").otherwise("none").alias("arg"))
    out = M.histogram_draw(e, prior(t), hash_uniform(F.lit(1), "event_id"), hash_uniform(F.lit(2), "event_id"))
    return out.select("event_id", F.round("value", 4).alias("value"))


@query("renormalise_support", """WITH pr AS (SELECT * FROM (SELECT unnest(['ECONOMY', 'SMALL', 'LARGE']) AS track, unnest([0.5, 0.3, 0.2])::DOUBLE AS prob)),
    a AS (SELECT DISTINCT p_brand || '/' || p_size % 10 AS song, p_type AS track FROM part),
    j AS (SELECT a.song, a.track, prob, sum(prob) OVER w AS tot, count(*) FILTER (a.track = 'PROMO') OVER w AS np, count(*) OVER w AS n FROM a
      LEFT JOIN pr ON pr.track = a.track WINDOW w AS (PARTITION BY a.song))
    SELECT song, track, round(p, 9) AS p FROM (SELECT song, track, CASE WHEN tot > 0 THEN coalesce(prob / tot, 0) WHEN np > 0 THEN (track = 'PROMO')::INT / np
      ELSE 1 / n END AS p FROM j) WHERE p > 0""")
def renormalise_support(t):
    pr = t.spark.createDataFrame([("ECONOMY", 0.5), ("SMALL", 0.3), ("LARGE", 0.2)], "track string, prob double")
    a = t.part.select(F.concat("p_brand", F.lit("/"), (F.col("p_size") % 10).cast("string")).alias("song"), F.col("p_type").alias("track")).distinct()
    return r6(M.renormalise_support(pr, a, "song", t.spark.createDataFrame([("PROMO",)], "track string")), "p", digits=9)


TABLE = """lg AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 4 * 100 AS freq, CASE WHEN event_id % 2 = 0 THEN 'neg' ELSE 'pos' END AS sign,
      CAST(floor(value / 50) AS BIGINT) AS bin, value - 20 AS gain FROM events),
    w AS (SELECT freq, sign, bin, sum(gain) AS weight FROM lg WHERE gain > 0 GROUP BY ALL)"""


def cells_log(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select((k % 4 * 100).alias("freq"), F.when(F.col("event_id") % 2 == 0, "neg").otherwise("pos").alias("sign"),
                           F.floor(F.col("value") / 50).cast("bigint").alias("bin"), (F.col("value") - 20).alias("gain"))


@query("weight_table", f"WITH {TABLE} SELECT freq, sign, bin, round(weight, 4) AS weight FROM w")
def weight_table(t):
    return r6(M.weight_table(cells_log(t), ["freq", "sign", "bin"]), "weight", digits=4)


@query("smooth_table", f"""WITH {TABLE}, g AS (SELECT f AS freq, s AS sign, b AS bin FROM (SELECT unnest([0, 100, 200, 300, 400]) AS f), (SELECT unnest(['neg', 'pos']) AS s),
      (SELECT unnest([0, 1, 2]) AS b)), i AS (SELECT w.* FROM w JOIN g ON g.freq = w.freq AND g.sign = w.sign AND g.bin = w.bin)
    SELECT CAST(g.freq AS BIGINT) AS freq, g.sign, CAST(g.bin AS BIGINT) AS bin, round((coalesce(weight, 0) + 0.5) / ((SELECT sum(weight) FROM i) + 0.5 * 30), 9) AS prob
    FROM g LEFT JOIN i ON g.freq = i.freq AND g.sign = i.sign AND g.bin = i.bin""")
def smooth_table(t):
    w = M.weight_table(cells_log(t), ["freq", "sign", "bin"])
    out = M.smooth_table(w, {"freq": [0, 100, 200, 300, 400], "sign": ["neg", "pos"], "bin": [0, 1, 2]}, 0.5)
    return r6(out.withColumns({"freq": F.col("freq").cast("bigint"), "bin": F.col("bin").cast("bigint")}), "prob", digits=9)


@query("validate_prior", f"""WITH {PRIOR}, h AS (SELECT action, arg, sum(CASE action WHEN 'click' THEN prob * 1.01 ELSE prob END) AS mass, count(*) AS n,
      count(DISTINCT bin_idx) AS d, max(bin_idx) AS top, min(bin_lo) AS b0, max(bin_hi) AS b1, sum(bin_hi - bin_lo) AS width, min(legal_lo) AS l0, max(legal_hi) AS l1
      FROM prior GROUP BY action, arg),
    want(action, arg, lo, hi) AS (VALUES ('click', 'k', 0, 100), ('view', 'k', 0, 80), ('error', 'k', 0, 100), ('idle', 'k', 0, 1)),
    j AS (SELECT coalesce(h.action, want.action) AS action, coalesce(h.arg, want.arg) AS arg, h.n, want.lo, want.hi, mass, d, top, b0, b1, width, l0, l1
      FROM h FULL JOIN want ON h.action = want.action AND h.arg = want.arg)
    SELECT action, arg, 'missing_histogram' AS violation FROM j WHERE n IS NULL UNION ALL SELECT action, arg, 'unexpected_histogram' FROM j WHERE lo IS NULL
    UNION ALL SELECT action, arg, 'mass_not_one' FROM j WHERE abs(mass - 1) > 1e-6 UNION ALL SELECT action, arg, 'legal_range' FROM j WHERE l0 <> lo OR l1 <> hi
    UNION ALL SELECT action, arg, 'bin_index' FROM j WHERE n <> d OR top <> n - 1 UNION ALL SELECT action, arg, 'edges' FROM j WHERE abs(width - (b1 - b0)) > 1e-6""")
def validate_prior(t):
    p = prior(t).withColumn("prob", F.when(F.col("action") == "click", F.col("prob") * 1.01).otherwise(F.col("prob")))
    want = {("click", "k"): (0.0, 100.0), ("view", "k"): (0.0, 80.0), ("error", "k"): (0.0, 100.0), ("idle", "k"): (0.0, 1.0)}
    return M.validate_prior(p, want)


@query("bootstrap_counts", f"""WITH i AS (SELECT song, row_number() OVER (ORDER BY song) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT vec_id % 50 AS song FROM embeddings)),
    d AS (SELECT r AS rep, CAST(floor({sql_u(9, 'r', 'pos')} * n) AS BIGINT) + 1 AS pos FROM i, range(1, 101) x(r))
    SELECT CAST(d.rep AS INT) AS rep, i.song, count(*) AS count FROM d JOIN i ON i.pos = d.pos GROUP BY 1, 2""")
def bootstrap_counts(t):
    return M.bootstrap_counts(t.vectors(), 100, 9)
