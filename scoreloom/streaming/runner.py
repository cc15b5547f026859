"""Run a streaming plan over everything that has arrived and read back what it wrote.

``path`` is the folder of the run (results and checkpoint). A run on the folder of an earlier one goes on where that ended;
without it each run gets a fresh folder below the shared one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scoreloom.session import scratch_path

#: Keyed state needs the RocksDB store.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Batches without data move event time on. State with a time to live asks for one after the other, so a run that is to end
#: goes without them.
DATA_ONLY = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for the queries started inside; a query keeps those it was started with."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _run(stream: DataFrame, path: str, mode: str, sink: Callable[[DataFrame, int], None] | None, idle: bool = True) -> None:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{path}/out")
    with _settings(stream.sparkSession, ROCKSDB if idle else ROCKSDB | DATA_ONLY):
        writer.start().awaitTermination()


def run_append(stream: DataFrame, name: str, path: str | None = None, idle: bool = True) -> DataFrame:
    """Append-mode run into parquet files; ``idle``: batches without data move event time on."""
    path = path or scratch_path(stream.sparkSession, name)
    _run(stream, path, "append", None, idle)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def run_complete(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Complete-mode run; the latest result table replaces the one before."""
    path = path or scratch_path(stream.sparkSession, name)
    _run(stream, path, "complete", lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def run_updates(stream: DataFrame, name: str, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """Update-mode run: each batch adds the rows it changed (a repeated batch replaces its own); the newest row of each key is
    read back."""
    path = path or scratch_path(stream.sparkSession, name)
    _run(stream, path, "update", lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/out/batch={i}"), False)
    rest = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", f"{path}/out").parquet(f"{path}/out")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r"))
    return newest.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
