"""Source and sink queries: the driver tables are written in the native layouts and read back."""

from pyspark.sql import functions as F

from scoreloom.plans.q_aggregates import r6
from scoreloom.plans.q_scalars import wrapped_props
from scoreloom.plans.registry import query
from scoreloom.session import scratch_path
from scoreloom.sources import records as R
from scoreloom.sources import runs as N
from scoreloom.sources import sinks as K
from scoreloom.sources import tables as B


def record_lines(t, envelope):
    """Ratings as listening-test records, every seventh one sent twice with an older score first."""
    e = t.events
    rate = lambda v: F.create_map(F.lit("a"), v, F.lit("b"), v / 2)
    def rec(value):
        body = [F.col("event_id").alias("screen_index"), F.concat(F.lit("Song "), (F.col("event_id") % 22).cast("string")).alias("song"),
                rate(value).alias("ratings"), F.lit(12.5).alias("duration_sec")]
        head = [F.lit("mushra").alias("type"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("pid")]
        return F.to_json(F.struct(*head, F.struct(*body).alias("payload")) if envelope else F.struct(*head, *body))
    old = F.when(F.col("event_id") % 7 == 0, rec(F.col("value") + 1))
    rows = F.array_compact(F.array(old, rec(F.col("value")), F.when(F.col("event_id") % 50 == 0, "not json")))
    return e.repartition(2, "user_id").select(F.explode(rows).alias("value"))


def ratings_of(t, envelope):
    path = scratch_path(t.spark, "records")
    record_lines(t, envelope).write.text(path)
    # The text sink names its files *.txt.
    cur = R.current_records(R.read_records(t.spark, path, lines="*.txt"), R.ENVELOPE if envelope else R.FLAT)
    return R.typed_tables(cur, conditions=["a", "b"], fields=R.ENVELOPE if envelope else R.FLAT)["mushra"]


RATING_SQL = """SELECT 'p' || user_id AS listener, 'song' || event_id % 22 AS song, c AS condition, round(CASE c WHEN 'a' THEN value ELSE value / 2 END, 6) AS score,
    CAST(event_id AS VARCHAR) AS screen, 12.5::DOUBLE AS dur FROM events, (SELECT unnest(['a', 'b']) AS c)"""


@query("read_records", RATING_SQL)
def read_records(t):
    return r6(ratings_of(t, False), "score")


@query("read_records_envelope", RATING_SQL)
def read_records_envelope(t):
    return r6(ratings_of(t, True), "score")


def run_records(t):
    """Orders as nested run records, one line per customer: two seeds, each with its orders as search steps."""
    # A long log is spread over several records, so no record grows without bound.
    o = t.orders.withColumns(
        {"seed_idx": (F.col("o_orderkey") % 2).cast("int"), "part": F.floor(F.col("o_orderkey") / 1000000)})
    step = F.struct(F.col("o_orderkey").alias("step"), F.lit("gain").alias("action"), (F.col("o_totalprice") / 1e4).alias("pq"),
                    F.lit(1.5).alias("sb"), F.when(F.col("o_orderkey") % 5 == 0, "no_proposal").alias("note"))
    seeds = o.groupBy("o_orderpriority", "o_custkey", "part", "seed_idx").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.max(F.col("o_totalprice") / 1e4).alias("best"))
    score = lambda pq: F.struct(pq.alias("pq"), F.lit(1.0).alias("sb"), F.lit(0.5).alias("reward"))
    seed = F.struct("seed_idx", (F.col("o_custkey") * 100 + F.col("seed_idx")).alias("seed"), F.lit(0.8).alias("common_gain"),
                    F.create_map(F.lit("bass"), F.lit(0.5)).alias("stem_gains"), score(F.lit(2.0)).alias("random_dry"),
                    F.struct(F.col("best").alias("pq"), F.lit(1.0).alias("sb"), F.lit(0.5).alias("reward"), F.when(F.col("o_custkey") % 2 == 0, -1.0).alias("init_reward"),
                             F.array(F.struct(F.lit(0.25).alias("reward"), F.lit(1.5).alias("delta"))).alias("best_chain"),
                             F.col("steps").alias("search_log")).alias("proposed_rand"),
                    F.create_map(F.lit("fx"), score(F.col("best") / 2)).alias("baselines_rand"))
    song = seeds.groupBy("o_orderpriority", "o_custkey", "part").agg(F.collect_list(seed).alias("seeds"))
    return song.select("o_orderpriority", F.when(F.col("o_custkey") % 9 == 0, "error").otherwise("done").alias("status"),
                       F.concat(F.lit("song"), F.col("o_custkey").cast("string")).alias("song_id"), F.lit("test").alias("split"), "seeds")


RUNS = {"1-URGENT": "fast", "5-LOW": "slow run", "2-HIGH": "2-HIGH", "3-MEDIUM": "3-MEDIUM", "4-NOT SPECIFIED": "4-NOT SPECIFIED"}


def runs(t):
    root = scratch_path(t.spark, "runs")
    rec = run_records(t)
    for run, name in RUNS.items():
        rec.where(F.col("o_orderpriority") == run).drop("o_orderpriority").write.json(f"{root}/{name}/songs")
    return N.read_run_records(t.spark, root, multi_line=False)


RUN = """r AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '5-LOW' THEN 'slow run' ELSE o_orderpriority END AS run, 'song' || o_custkey AS song, CAST(o_orderkey % 2 AS INT) AS seed_idx, o_orderkey,
    o_custkey, o_totalprice / 1e4 AS pq FROM orders WHERE o_custkey % 9 > 0)"""


@query("read_run_records", f"WITH {RUN} SELECT run, song AS song_id, 'done' AS status, CAST(count(DISTINCT seed_idx) AS INT) AS n_seeds FROM r GROUP BY run, song, o_orderkey // 1000000")
def read_run_records(t):
    return runs(t).select("run", "song_id", "status", F.size("seeds").alias("n_seeds"))


@query("explode_seeds", f"""WITH {RUN}, s AS (SELECT run, song, seed_idx, any_value(o_custkey) * 100 + seed_idx AS seed, max(pq) AS best FROM r GROUP BY 1, 2, 3, o_orderkey // 1000000)
    SELECT run, song, seed_idx, CAST(seed AS BIGINT) AS seed, method, round(CASE method WHEN 'random_dry' THEN 2 WHEN 'fx' THEN best / 2 ELSE best END, 9) AS pq
    FROM s, (SELECT unnest(['random_dry', 'proposed_rand', 'fx']) AS method)""")
def explode_seeds(t):
    return r6(N.explode_seeds(runs(t)), "pq", digits=9).select("run", "song", "seed_idx", "seed", "method", "pq")


@query("explode_search_log", f"""WITH {RUN} SELECT run, song, seed_idx, o_orderkey AS step, round(pq, 6) AS pq, CASE WHEN o_orderkey % 5 = 0 THEN 'no_proposal' END AS note,
    CASE WHEN o_custkey % 2 = 0 THEN -1.0 ELSE -1.25 END::DOUBLE AS init_reward FROM r""")
def explode_search_log(t):
    return r6(N.explode_search_log(runs(t)), "pq").select("run", "song", "seed_idx", "step", "pq", "note", "init_reward")


@query("read_manifest", """SELECT 'b' || s_suppkey AS key, 's' || s_nationkey AS song, 'c' || s_suppkey % 3 AS condition FROM supplier
    UNION ALL SELECT 'audio/b' || s_suppkey || '.opus', 's' || s_nationkey, 'c' || s_suppkey % 3 FROM supplier WHERE s_suppkey % 2 = 0""")
def read_manifest(t):
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    path = scratch_path(t.spark, "manifest")
    song, cond, blind = F.concat(F.lit("s"), n), F.concat(F.lit("c"), (F.col("s_suppkey") % 3).cast("string")), F.concat(F.lit("b"), k)
    clip = F.to_json(F.struct(blind.alias("blind_id"), F.concat(F.lit("audio/b"), k, F.lit(".opus")).alias("file")))
    trial = F.concat(F.lit('{"trial_id":"t'), k, F.lit('","song_id":"'), song, F.lit('","clips":{"'), cond, F.lit('":'), clip, F.lit("}}"))
    one = lambda df, c, sep: df.agg(F.array_join(F.array_sort(F.collect_list(c)), sep).alias("l"))
    # A manifest is one document; it lists the clips of a study.
    trials = one(t.supplier.where("s_suppkey % 2 = 0"), trial, ",").select(F.concat(F.lit('{"trials":['), "l", F.lit("]}")))
    pair = F.concat(F.lit('"'), blind, F.lit('":["'), song, F.lit('","'), cond, F.lit('"]'))
    flat = one(t.supplier.where("s_suppkey % 2 = 1"), pair, ",\n").select(F.concat(F.lit("{"), "l", F.lit("}")))
    trials.coalesce(1).write.text(f"{path}/a")
    flat.coalesce(1).write.text(f"{path}/b")
    a, b = B.read_manifest(t.spark, f"{path}/a/*.txt"), B.read_manifest(t.spark, f"{path}/b/*.txt")
    return a[0].unionByName(b[0])


@query("read_survey_csv", """SELECT CAST(c_custkey AS VARCHAR) AS pid, abs(c_acctbal) AS duration_sec, c_mktsegment AS q_device, CAST(c_nationkey AS VARCHAR) AS q_prod,
    CAST(c_nationkey * 2 AS VARCHAR) AS q_prod_years FROM customer""")
def read_survey_csv(t):
    path = scratch_path(t.spark, "survey")
    t.customer.select(
        F.col("c_custkey").cast("string").alias("Participant id"), F.concat(F.abs("c_acctbal").cast("string"), F.lit(" s")).alias("Time taken"),
        F.col("c_mktsegment").alias("Which device, please?"), F.col("c_nationkey").alias("answer q_prod"), (F.col("c_nationkey") * 2).alias("Q_Prod_Years")
    ).write.option("header", "true").csv(path)
    return B.read_survey_csv(t.spark, path, [("q_prod_years", "Whole years?"), ("q_device", "Which device please"), ("q_prod", "Years band?")])


@query("read_embeddings", r"""SELECT vec_id, 'arm_' || chr(CAST(97 + label AS INT)) AS method, 'song ' || vec_id % 50 AS song, CAST(vec_id % 2 AS INT) AS seed FROM embeddings WHERE label <> 3""")
def read_embeddings(t):
    path = scratch_path(t.spark, "vectors")
    arm = F.concat(F.lit("arm_"), F.char(F.lit(97) + F.col("label")))
    name = F.concat(arm, F.lit("__song "), (F.col("vec_id") % 50).cast("string"), F.lit("__seed"), (F.col("vec_id") % 2).cast("string"), F.lit(".wav"))
    t.embeddings.withColumn("file", name).write.parquet(path)
    return B.read_embeddings(t.spark, path, exclude=["arm_d__"]).select("vec_id", "method", "song", "seed")


@query("read_section_labels", """SELECT 'part' AS song, o_orderkey / 4.0::DOUBLE AS start_sec, 'sec' || o_custkey % 6 AS label FROM orders WHERE o_orderkey % 10 > 0""")
def read_section_labels(t):
    path = scratch_path(t.spark, "labels")
    k = F.col("o_orderkey")
    line = F.when(k % 10 == 0, "x broken line").otherwise(F.concat((k / 4).cast("string"), F.lit("\t"), (k / 4 + 1).cast("string"), F.lit("  sec"),
                                                                   (F.col("o_custkey") % 6).cast("string")))
    t.orders.select(line.alias("value")).write.text(path)
    out = _lab_files(t, path)
    return out.select(F.lit("part").alias("song"), "start_sec", "label")


def _lab_files(t, path):
    return B.read_section_labels(t.spark, f"{path}/*.txt")


@query("read_durations", "SELECT CAST(o_orderkey AS VARCHAR) AS song, day(o_orderdate) * 20.5::DOUBLE AS duration FROM orders")
def read_durations(t):
    path = scratch_path(t.spark, "durations")
    t.orders.select(F.col("o_orderkey").alias("song"), (F.dayofmonth("o_orderdate") * 20.5).alias("duration")).write.option("header", "true").csv(path)
    return B.read_durations(t.spark, path)


@query("flatten_scores", """SELECT event_id, event_type || '.k' AS key, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events UNION ALL
    SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 0""")
def flatten_scores(t):
    e = t.events.select("event_id", F.col("event_type").alias("name"), F.create_map(F.lit("k"), R.mapped_field(wrapped_props(), "a.k").cast("double")).alias("score"),
                        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("plain"))
    return R.flatten_scores(e, ["event_id"], scalar="plain")


@query("write_results", """SELECT o_orderpriority AS run, o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 2 ELSE 1 END AS version FROM orders WHERE o_orderpriority <> '5-LOW' OR o_orderkey % 2 = 0""")
def write_results(t):
    path = scratch_path(t.spark, "results")
    o = t.orders.select(F.col("o_orderpriority").alias("run"), "o_orderkey")
    K.write_results(o.withColumn("version", F.lit(1)), path)
    K.write_results(o.where("run = '5-LOW' AND o_orderkey % 2 = 0").withColumn("version", F.lit(2)), path)
    return t.spark.read.schema("run string, o_orderkey bigint, version int").parquet(path)


@query("append_events", "SELECT event_type AS kind, event_id FROM events")
def append_events(t):
    path = scratch_path(t.spark, "events")
    for part in (0, 1):
        K.append_events(t.events.where(F.col("event_id") % 2 == part).select(F.col("event_type").alias("kind"), "event_id"), path)
    return t.spark.read.schema("kind string, event_id bigint").json(path)


@query("write_id_list", "SELECT CAST(c_custkey AS VARCHAR) AS pid FROM customer WHERE c_custkey % 10 > 0")
def write_id_list(t):
    path = scratch_path(t.spark, "ids")
    K.write_id_list(t.customer.select(F.when(F.col("c_custkey") % 10 > 0, F.col("c_custkey").cast("string")).otherwise(" ").alias("pid")), path)
    return t.spark.read.text(path).withColumnRenamed("value", "pid")
