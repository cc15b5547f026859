"""The driver tables in the roles of the engine's inputs: Spark views and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.scalars import epoch_us
from scoreloom.operators.scan import ordinal, time_block
from scoreloom.session import materialize

CTES = {
    "ratings": """
        SELECT l_suppkey AS listener, l_partkey % 22 AS song, l_returnflag || l_linestatus AS condition,
               2 * l_quantity AS score, l_orderkey % 9 AS screen FROM lineitem""",
    "search_log": """
        SELECT user_id AS song, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
               event_type AS action, value AS pq, CAST(json_extract(props, '$.k') AS DOUBLE) AS sb,
               value AS reward, ts, event_id FROM events""",
    "replayed": """
        SELECT *, reward > greatest(10.0, coalesce(max(reward) OVER (PARTITION BY song ORDER BY step
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 10.0)) AS accepted,
               greatest(10.0, coalesce(max(reward) OVER (PARTITION BY song ORDER BY step
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 10.0)) AS best_before
        FROM search_log""",
    "pool": "SELECT l_suppkey AS song, l_quantity / 10 AS pq, 10 * l_discount AS sb FROM lineitem",
    "calib": """
        SELECT song, avg(pq) AS pq_mean, stddev_pop(pq) AS pq_std_measured, greatest(stddev_pop(pq), 0.05) AS pq_std,
               stddev_pop(pq) < 0.05 AS pq_floored, avg(sb) AS sb_mean, stddev_pop(sb) AS sb_std_measured,
               greatest(stddev_pop(sb), 0.05) AS sb_std, stddev_pop(sb) < 0.05 AS sb_floored,
               count(*) AS n_samples FROM pool GROUP BY song""",
    "zpool": """
        SELECT p.song, p.pq, p.sb, (p.pq - pq_mean) / greatest(pq_std, 1e-6) AS z_pq,
               (p.sb - sb_mean) / greatest(sb_std, 1e-6) AS z_sb FROM pool p JOIN calib c ON p.song = c.song""",
    "arms": """
        SELECT o_orderpriority AS run, o_custkey AS song, o_orderkey % 2 AS seed_idx, o_totalprice / 1e4 AS pq,
               ((o_orderkey * 7919) % 1000) / 100.0::DOUBLE AS sb, day(o_orderdate) * 20.0::DOUBLE AS duration,
               o_orderstatus AS split, o_orderkey FROM orders""",
    "song_arms": """
        SELECT run, song, avg(pq) AS pq, avg(sb) AS sb FROM arms GROUP BY run, song""",
    "vectors": "SELECT label AS run, vec_id % 50 AS song, vec_id, embedding FROM embeddings",
    "screening": """
        SELECT c_custkey AS pid, c_mktsegment AS q_device,
               CASE WHEN c_nationkey % 5 > 0 THEN 'normal' ELSE 'aided' END AS q_hearing,
               CASE WHEN floor(c_acctbal / 150) BETWEEN 0 AND 70 THEN CAST(floor(c_acctbal / 150) AS INT) END
                   AS q_prod_years,
               CASE WHEN c_custkey % 2 > 0 THEN 'ratio' WHEN c_custkey % 14 = 0 THEN 'harmonic_gate' ELSE 'skip' END
                   AS q_know1,
               CASE WHEN c_custkey % 3 > 0 THEN 'send' ELSE 'skip' END AS q_know2,
               CASE WHEN c_custkey % 5 > 0 THEN 'lufs' ELSE 'skip' END AS q_know3 FROM customer""",
    "frames": """
        SELECT user_id AS song, event_type AS stem, ts, event_id,
               epoch_us(ts) / 1e6::DOUBLE - min(epoch_us(ts) / 1e6::DOUBLE) OVER (PARTITION BY user_id) AS t_sec,
               value AS level, CASE WHEN value > 0 THEN 20 * log10(value) END AS rms_db FROM events""",
}


class Tables:
    """Lazy readers of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    # --- proxies ---------------------------------------------------------------------------------

    def ratings(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("listener"), (F.col("l_partkey") % 22).alias("song"),
            F.concat("l_returnflag", "l_linestatus").alias("condition"),
            (2 * F.col("l_quantity")).alias("score"), (F.col("l_orderkey") % 9).alias("screen"))

    def search_log(self) -> DataFrame:
        ev = self.read("events").select(
            F.col("user_id").alias("song"), F.col("event_type").alias("action"), F.col("value").alias("pq"),
            F.get_json_object("props", "$.k").cast("double").alias("sb"), F.col("value").alias("reward"),
            "ts", "event_id")
        steps = ordinal(ev, ["song"], [F.asc("ts"), F.asc("event_id")], time_block("ts", 86400))
        # A log with step numbers is a table of its own; every operator on it reads it more than once.
        return materialize(steps.withColumn("step", F.col("rn") - 1).drop("rn"), "search-log")

    def replayed(self) -> DataFrame:
        from scoreloom.operators.logs import replay_acceptance
        return materialize(replay_acceptance(self.search_log(), init=10.0), "replayed")

    def pool(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("song"), (F.col("l_quantity") / 10).alias("pq"),
            (10 * F.col("l_discount")).alias("sb"))

    def calib(self) -> DataFrame:
        from scoreloom.operators.calibration import fit_calibration
        return fit_calibration(self.pool(), by=["song"])

    def zpool(self) -> DataFrame:
        from scoreloom.operators.calibration import zscore
        return zscore(self.pool(), self.calib(), on=["song"])

    def arms(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderpriority").alias("run"), F.col("o_custkey").alias("song"),
            (F.col("o_orderkey") % 2).alias("seed_idx"), (F.col("o_totalprice") / 1e4).alias("pq"),
            (((F.col("o_orderkey") * 7919) % 1000) / 100).alias("sb"),
            (F.dayofmonth("o_orderdate") * 20.0).alias("duration"), F.col("o_orderstatus").alias("split"),
            "o_orderkey")

    def song_arms(self) -> DataFrame:
        return self.arms().groupBy("run", "song").agg(F.avg("pq").alias("pq"), F.avg("sb").alias("sb"))

    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("label").alias("run"), (F.col("vec_id") % 50).alias("song"), "vec_id", "embedding")

    def screening(self) -> DataFrame:
        key = F.col("c_custkey")
        years = F.floor(F.col("c_acctbal") / 150).cast("int")
        return self.read("customer").select(
            key.alias("pid"), F.col("c_mktsegment").alias("q_device"),
            F.when(F.col("c_nationkey") % 5 > 0, "normal").otherwise("aided").alias("q_hearing"),
            F.when(years.between(0, 70), years).alias("q_prod_years"),
            F.when(key % 2 > 0, "ratio").when(key % 14 == 0, "harmonic_gate").otherwise("skip").alias("q_know1"),
            F.when(key % 3 > 0, "send").otherwise("skip").alias("q_know2"),
            F.when(key % 5 > 0, "lufs").otherwise("skip").alias("q_know3"))

    def frames(self) -> DataFrame:
        ev = self.read("events")
        sec = epoch_us("ts") / F.lit(1e6)
        start = ev.groupBy("user_id").agg(F.min(sec).alias("t0"))
        return materialize(ev.join(start, "user_id").select(
            F.col("user_id").alias("song"), F.col("event_type").alias("stem"), "ts", "event_id",
            (sec - F.col("t0")).alias("t_sec"), F.col("value").alias("level"),
            (20 * F.log10("value")).alias("rms_db")), "frames")
