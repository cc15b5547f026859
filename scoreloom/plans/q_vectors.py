"""Embedding-set queries: label 0 plays the reference, the other labels the arms."""

from pyspark.sql import functions as F

from scoreloom.functions import scalars as S
from scoreloom.operators import joins as J
from scoreloom.operators import sampling as M
from scoreloom.operators import vectors as V
from scoreloom.operators.cases import similar_cases as similar_cases_of
from scoreloom.plans.q_aggregates import r6
from scoreloom.plans.q_sampling import sql_u
from scoreloom.plans.registry import query
from scoreloom.session import materialize

EMB = """e AS (SELECT vec_id, label AS run, vec_id % 50 AS song, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    ref AS (SELECT * FROM e WHERE run = 0)"""
D2 = "greatest(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v), 0)"
SIG = f"sg AS (SELECT quantile_cont(sqrt({D2}), 0.5) + 1e-9 AS sigma FROM ref a JOIN ref b ON a.vec_id < b.vec_id)"
KER = f"""{EMB}, {SIG}, x AS (SELECT * FROM e WHERE run > 0),
    kxx AS (SELECT a.run, a.song AS song_a, b.song AS song_b, sum(exp(-{D2} / (2 * sigma * sigma))) AS k FROM x a JOIN x b ON a.run = b.run, sg GROUP BY 1, 2, 3),
    kxy AS (SELECT a.run, a.song, sum(exp(-{D2} / (2 * sigma * sigma))) AS k, count(DISTINCT a.vec_id) AS n, (SELECT count(*) FROM ref) AS m FROM x a, ref b, sg
      GROUP BY 1, 2),
    syy AS (SELECT (sum(exp(-{D2} / (2 * sigma * sigma))) - (SELECT count(*) FROM ref)) / ((SELECT count(*) FROM ref) * ((SELECT count(*) FROM ref) - 1)) AS syy
      FROM ref a, ref b, sg)"""


def arms(t):
    v = t.vectors()
    return v.where("run > 0"), v.where("run = 0")


def bandwidth(ref):
    return materialize(V.median_bandwidth(ref, "vec_id", strip=1024), "sigma")


def kernel(x, ref):
    sigma = bandwidth(ref)
    return V.song_kernel(x, ref, sigma, strip=1024), V.reference_term(ref, sigma, strip=1024)


@query("cosine", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
    SELECT a.vec_id, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) + 1e-9), 6) AS cosine,
      round(1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) + 1e-9), 6) AS distance
    FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def cosine(t):
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = t.embeddings.join(nxt, "vec_id")
    return j.select("vec_id", F.round(S.cosine("embedding", "other"), 6).alias("cosine"), F.round(S.embedding_distance("embedding", "other"), 6).alias("distance"))


@query("pairwise_sq_dist", f"""WITH {EMB} SELECT a.run, a.song, round(sum({D2}), 6) AS sum_sq, round(min({D2}), 6) AS min_sq, round(max({D2}), 6) AS max_sq,
    count(*) AS n_pairs FROM e a, ref b WHERE a.run > 0 GROUP BY 1, 2""")
def pairwise_sq_dist(t):
    x, ref = arms(t)
    return r6(V.pairwise_sq_dist(x, ref, strip=1024), "sum_sq", "min_sq", "max_sq")


@query("median_bandwidth", f"WITH {EMB}, {SIG} SELECT round(sigma, 9) AS sigma FROM sg")
def median_bandwidth(t):
    return r6(V.median_bandwidth(arms(t)[1], "vec_id", strip=64), "sigma", digits=9)


@query("song_kernel", f"WITH {KER} SELECT run, song_a, song_b, round(k, 6) AS k FROM kxx")
def song_kernel(t):
    x, ref = arms(t)
    return r6(V.within_kernel(x, bandwidth(ref), strip=1024), "k")


@query("song_kernel_cross", f"WITH {KER} SELECT run, song, round(k, 6) AS k, n AS n_vectors, m AS n_ref FROM kxy")
def song_kernel_cross(t):
    x, ref = arms(t)
    return r6(V.cross_kernel(x, ref, bandwidth(ref), strip=1024), "k")


@query("mmd2_unbiased", f"""WITH {KER}, s AS (SELECT run, sum(k) AS k, sum(n) AS n, any_value(m) AS m FROM kxy GROUP BY 1), t AS (SELECT run, sum(k) AS kk FROM kxx GROUP BY 1)
    SELECT s.run, CAST(n AS BIGINT) AS n_vectors, round((kk - n) / (n * (n - 1)) + syy - 2 * k / (n * m), 7) AS mmd2 FROM s JOIN t ON s.run = t.run, syy""")
def mmd2(t):
    k, syy = kernel(*arms(t))
    return r6(V.mmd2_unbiased(k, syy), "mmd2", digits=7)


REPS = 500
BOOT = f"""o AS (SELECT run, song, row_number() OVER (PARTITION BY run ORDER BY song) AS pos, count(*) OVER (PARTITION BY run) AS ns FROM (SELECT DISTINCT run, song FROM x)),
    dr AS (SELECT run, r AS rep, CAST(floor({sql_u(5, 'r', 'pos')} * ns) AS BIGINT) + 1 AS pos FROM o, range(1, 501) z(r)),
    ct AS (SELECT dr.run, dr.rep, o.song, count(*) AS c FROM dr JOIN o ON o.run = dr.run AND o.pos = dr.pos GROUP BY 1, 2, 3),
    bx AS (SELECT kxx.run, a.rep, sum(a.c * b.c * k) AS kk FROM kxx JOIN ct a ON a.run = kxx.run AND a.song = song_a JOIN ct b ON b.run = kxx.run AND b.song = song_b
      AND a.rep = b.rep GROUP BY 1, 2),
    by_ AS (SELECT kxy.run, ct.rep, sum(c * k) AS k, CAST(sum(c * n) AS DOUBLE) AS n, any_value(m) AS m FROM kxy JOIN ct ON ct.run = kxy.run AND ct.song = kxy.song GROUP BY 1, 2),
    bt AS (SELECT bx.run, bx.rep, (kk - n) / (n * (n - 1)) + syy - 2 * k / (n * m) AS mmd2 FROM bx JOIN by_ ON by_.run = bx.run AND by_.rep = bx.rep, syy)"""


def replicates(x, ref):
    k, syy = kernel(x, ref)
    return V.bootstrap_mmd(k, syy, M.bootstrap_counts(x, REPS, 5, by=["run"]), REPS)


@query("bootstrap_mmd", f"WITH {KER}, {BOOT} SELECT run, CAST(rep AS INT) AS rep, round(mmd2, 7) AS mmd2 FROM bt")
def bootstrap_mmd(t):
    return r6(replicates(*arms(t)), "mmd2", digits=7)


@query("bootstrap_ci", f"""WITH {KER}, {BOOT} SELECT run, round(avg(mmd2), 7) AS mean, count(*) AS n_rep, round(quantile_cont(mmd2, 0.025), 7) AS ci_lo,
    round(quantile_cont(mmd2, 0.975), 7) AS ci_hi FROM bt GROUP BY 1""")
def bootstrap_ci(t):
    return r6(V.bootstrap_ci(replicates(*arms(t))), "mean", "ci_lo", "ci_hi", digits=7)


COMMON = KER.replace("x AS (SELECT * FROM e WHERE run > 0)", """x AS (SELECT * FROM e WHERE run IN (1, 2) AND song IN (SELECT song FROM e WHERE run IN (1, 2)
      GROUP BY 1 HAVING count(DISTINCT run) = 2))""")


@query("bootstrap_diff", f"""WITH {COMMON}, {BOOT}, d AS (SELECT a.mmd2 - b.mmd2 AS d FROM bt a JOIN bt b ON a.rep = b.rep WHERE a.run = 1 AND b.run = 2)
    SELECT '1 - 2' AS pair, round(avg(d), 7) AS mean, count(*) AS n_rep, round(quantile_cont(d, 0.025), 7) AS ci_lo, round(quantile_cont(d, 0.975), 7) AS ci_hi,
      quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM d""")
def bootstrap_diff(t):
    x, ref = arms(t)
    x = J.pair_all_arms(x, [1, 2], ["song"])
    return r6(V.bootstrap_diff(replicates(x, ref), x, 1, 2), "mean", "ci_lo", "ci_hi", digits=7)


@query("restrict_songs", f"WITH {EMB}, s AS (SELECT song FROM e GROUP BY 1 HAVING count(DISTINCT run) >= 7) SELECT vec_id, 'all' AS run, song FROM e JOIN s USING (song)")
def restrict_songs(t):
    v = t.vectors()
    want = v.groupBy("song").agg(F.count_distinct("run").alias("n")).where("n >= 7")
    return V.restrict_songs(v.withColumn("run", F.lit("all")), want).select("vec_id", "run", "song")


@query("frechet_distance")
def frechet_distance(t):
    x, ref = arms(t)
    return r6(V.frechet_distance(x, ref), "frechet")


CASE = """c AS (SELECT p_partkey AS case_id, CASE p_type WHEN 'STANDARD' THEN 'rock' WHEN 'PROMO' THEN 'jazz' ELSE 'pop' END AS genre,
      [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS roles, CASE p_size % 3 WHEN 0 THEN 'chorus' WHEN 1 THEN 'verse' END AS section,
      CASE WHEN p_size % 4 > 0 THEN p_size - 25.0::DOUBLE END AS da, CASE WHEN p_size % 4 > 0 AND p_size % 5 > 0 THEN p_retailprice - 950 END AS db, p_retailprice / 1000 - 0.9
      AS gain, p_size AS obs FROM part WHERE p_retailprice / 1000 - 0.9 >= 0.01)"""


ASK = """q AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN 'rock' WHEN 1 THEN 'jazz' WHEN 2 THEN 'pop' END AS g,
      CASE s_suppkey % 5 WHEN 0 THEN ['red', 'gear'] WHEN 1 THEN ['blue'] WHEN 2 THEN []::VARCHAR[] ELSE ['gear', 'small', 'bolt'] END AS r,
      CASE s_suppkey % 3 WHEN 0 THEN 'chorus' WHEN 1 THEN 'verse' END AS sec, CASE WHEN s_suppkey % 6 > 0 THEN s_acctbal / 1000 END AS qa,
      CASE WHEN s_suppkey % 6 > 0 AND s_suppkey % 4 > 0 THEN -2.0::DOUBLE END AS qb FROM supplier)"""


@query("similar_cases", f"""WITH {CASE}, {ASK}, j AS (SELECT *, len(list_intersect(list_distinct(roles), r)) AS i, len(list_distinct(list_concat(roles, r))) AS u FROM q, c),
    s AS (SELECT *, 0.45 * CASE WHEN g IS NULL THEN 0.5 WHEN g = genre THEN 1 ELSE 0.3 END + 0.45 * i / u
      + 0.1 * CASE WHEN sec IS NULL OR section IS NULL OR section = sec THEN 1 ELSE 0.5 END AS base,
      coalesce(qa * da, 0) + coalesce(qb * db, 0) AS dot, sqrt(CASE WHEN da IS NULL THEN 0 ELSE coalesce(qa * qa, 0) END + CASE WHEN db IS NULL THEN 0 ELSE coalesce(qb * qb, 0) END) AS na,
      sqrt(CASE WHEN qa IS NULL THEN 0 ELSE coalesce(da * da, 0) END + CASE WHEN qb IS NULL THEN 0 ELSE coalesce(db * db, 0) END) AS nb,
      qa * da IS NOT NULL OR qb * db IS NOT NULL AS known FROM j),
    f AS (SELECT *, CASE WHEN known THEN 0.5 * base + 0.25 * (CASE WHEN na < 1e-9 OR nb < 1e-9 THEN 0 ELSE dot / (na * nb) END + 1) ELSE base END AS sim FROM s),
    o AS (SELECT *, round(sim + tanh(gain) * 0.1 + ln(1 + obs) * 0.02, 9) AS score FROM f)
    SELECT query_id, row_number() OVER w::INTEGER AS place, case_id, round(sim, 3) AS similarity, round(score, 6) AS score FROM o
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, case_id) QUALIFY row_number() OVER w <= 25""")
def similar_cases(t):
    def points(a, b):
        return F.map_filter(F.create_map(F.lit("a"), a, F.lit("b"), b), lambda k, v: v.isNotNull())
    size, k = F.col("p_size"), F.col("s_suppkey")
    c = t.part.select(
        F.col("p_partkey").alias("case_id"), F.when(F.col("p_type") == "STANDARD", "rock").when(F.col("p_type") == "PROMO", "jazz").otherwise("pop").alias("genre"),
        F.split("p_name", " ").alias("stem_roles"), F.when(size % 3 == 0, "chorus").when(size % 3 == 1, "verse").alias("section_type"),
        F.when(size % 4 > 0, points(size - F.lit(25.0), F.when(size % 5 > 0, F.col("p_retailprice") - 950))).alias("diagnosis"),
        (F.col("p_retailprice") / 1000 - 0.9).alias("reward_delta"), size.alias("n_observations"))
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    q = t.supplier.select(
        k.alias("query_id"), F.when(k % 4 == 0, "rock").when(k % 4 == 1, "jazz").when(k % 4 == 2, "pop").alias("genre"),
        F.when(k % 5 == 0, words("red", "gear")).when(k % 5 == 1, words("blue")).when(k % 5 == 2, words()).otherwise(words("gear", "small", "bolt")).alias("roles"),
        F.when(k % 3 == 0, "chorus").when(k % 3 == 1, "verse").alias("section"),
        F.when(k % 6 > 0, points(F.col("s_acctbal") / 1000, F.when(k % 4 > 0, -2.0))).alias("diagnosis"))
    return r6(similar_cases_of(q, c, 25, 0.01), "score")


@query("embedding_distance", f"""WITH {EMB} SELECT e.vec_id, round(1 - list_inner_product(e.v, c.v) / (sqrt(list_inner_product(e.v, e.v)) *
    sqrt(list_inner_product(c.v, c.v)) + 1e-9), 6) AS distance FROM e JOIN e c ON c.vec_id = e.run""")
def embedding_distance(t):
    e = t.embeddings
    head = e.select(F.col("vec_id").cast("int").alias("label"), F.col("embedding").alias("other"))
    return e.join(head, "label").select("vec_id", F.round(S.embedding_distance("embedding", "other"), 6).alias("distance"))
