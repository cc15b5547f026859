"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "scoreloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator assumes (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``; a machine-local one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), "scoreloom", f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by writing a table to the shared folder and reading it back.

    Used where an operator reads an intermediate result several times (a scan and its carry, a statistic and the rows
    it is compared with): without the cut, Spark would compute everything below once per use, and stacked operators
    would multiply that. The table survives lost executors and is deleted when the driver's session ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_exchange(df: DataFrame) -> DataFrame:
    """Let several subplans on ``df`` (the last aggregate or shuffle of a branch) find the very same exchange.

    Spark computes an exchange once if plans need it unchanged, but column pruning would cut it differently for each use.
    The filter keeps every row and reads every column, so all uses keep all columns. Nothing is written.
    """
    return df.where(F.hash(*df.columns) >= F.lit(-2**31))


#: Rows that a task of a spread table holds on average.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Deal the about ``rows`` rows of ``df`` by the columns ``by`` into tasks of :data:`TASK_ROWS`, before an aggregation by them.

    For aggregations with about as many groups as rows: a partial aggregation would keep a whole input split in memory without
    making it smaller, and a fixed number of tasks would hold more with every row. Spark adds no other exchange.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *by)
