"""Nested run records: one JSON document per song below ``<run>/songs/``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.schemas import RUN_RECORD


def read_run_records(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """Finished records with the run name taken from the path. ``multi_line=False`` reads one record per line, so
    large compacted files can be split."""
    df = spark.read.schema(RUN_RECORD).option("multiLine", str(multi_line).lower()).option(
        "recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    run = F.regexp_extract("_metadata.file_path", r"([^/]+)/songs/[^/]+$", 1)
    return df.withColumn("run", F.url_decode(run)).where(F.col("status") == "done")


def explode_seeds(runs: DataFrame) -> DataFrame:
    """One row per (run, song, seed, method) with its scores, the gains and the calibration of the seed."""
    s = runs.select("run", F.col("song_id").alias("song"), "split", F.posexplode_outer("seeds").alias("pos", "s"))
    s = s.withColumn("seed_idx", F.coalesce("s.seed_idx", "pos"))
    score = lambda c: F.struct(F.col(f"{c}.pq").alias("pq"), F.col(f"{c}.sb").alias("sb"), F.col(f"{c}.reward").alias("reward"))
    fixed = F.array(*[F.struct(F.lit(m).alias("method"), score(f"s.{m}").alias("v")) for m in ("random_dry", "proposed_rand")])
    fixed = F.filter(fixed, lambda x: x["v"]["pq"].isNotNull() | x["v"]["sb"].isNotNull())
    extra = F.transform(F.map_entries("s.baselines_rand"), lambda e: F.struct(e["key"].alias("method"), e["value"].alias("v")))
    methods = F.concat(fixed, F.coalesce(extra, F.array().cast("array<struct<method:string,v:struct<pq:double,sb:double,reward:double>>>")))
    out = s.select("run", "song", "split", "seed_idx", F.col("s.seed").alias("seed"), F.col("s.common_gain").alias("common_gain"),
                   F.col("s.stem_gains").alias("stem_gains"), F.col("s.calibration").alias("calibration"), F.explode_outer(methods).alias("m"))
    return out.select(*out.columns[:-1], "m.method", "m.v.pq", "m.v.sb", "m.v.reward")


def explode_search_log(runs: DataFrame, part: str = "search_log") -> DataFrame:
    """Step rows of the search log (or of ``best_chain``); steps without a proposal keep their note.

    A start reward that was not stored is what the first accepted entry started from: its reward less its gain.
    """
    s = runs.select("run", F.col("song_id").alias("song"), F.posexplode_outer("seeds").alias("pos", "s"))
    first = F.get("s.proposed_rand.best_chain", F.lit(0))
    init = F.coalesce("s.proposed_rand.init_reward", first["reward"] - first["delta"])
    steps = s.select("run", "song", F.coalesce("s.seed_idx", "pos").alias("seed_idx"), init.alias("init_reward"),
                     F.posexplode_outer(f"s.proposed_rand.{part}").alias("i", "x"))
    cols = ["action", "args", "track", "pq", "sb", "reward", "delta", "accepted", "note"]
    return steps.where(F.col("i").isNotNull()).select("run", "song", "seed_idx", "init_reward", F.coalesce("x.step", F.col("i").cast("bigint")).alias("step"),
                                                      *[F.col(f"x.{c}").alias(c) for c in cols])
