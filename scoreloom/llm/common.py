"""Helpers shared by the training-data operators: cut tables, word hashes, running ranks, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space of all word operators: blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; set here only where the session has none (tests, local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows survives lost executors and is computed once."""
    path = os.path.join(shared_dir(df.sparkSession), "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete cut tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now, not when its periodic collection comes round."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch of whole texts. Spark's 64 MB are held several times by a task: as vectors, as a message, as the batch before.
BATCH_BYTES = 4 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``; its session's Arrow batches hold ``BATCH_BYTES`` from now on, unless the user has set their size."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))
    return docs


def lower_ascii(text: Column) -> Column:
    return F.translate(text, *LOWER)


class _Rolling:
    """Prefix sums of a polynomial hash over 2^64: the hash of any stretch of bytes is one subtraction and one product."""

    BASE, INVERSE = 0xF1357AEA2E62A9C5, pow(0xF1357AEA2E62A9C5, -1, 1 << 64)

    def __init__(self):
        self.letter = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums before each byte and after the last."""
        return self.prefix_of(self.letter[data])

    def prefix_of(self, data: np.ndarray) -> np.ndarray:
        """The same for 64-bit letter values."""
        if len(self.up) <= len(data):
            size = max(1 << 16, 2 * len(data))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64)
                                  for b in (self.BASE, self.INVERSE))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * self.up[:len(data)], out=out[1:])
        return out

    def stretches(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word of the text, A-Z in lower case."""
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text.encode().lower(), np.uint8)
    edge = np.diff(_SPACE[data].view(np.int8), prepend=1, append=1)  # -1 where a word starts, 1 behind its end
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return ROLLING.stretches(ROLLING.prefix(data), start, end)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ROLLING = _Rolling()
_ODD = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)  # a factor for each place in a run


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; a shorter text is one run; no words, no runs."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out += words[j:n - width + 1 + j] * _ODD[j]
    return mix(out)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``, the 0-based rank within ``by`` along ``order``, without a task per key.

    Rows are range partitioned by (by, order), so that a hot key spreads over many tasks; each range is numbered on its
    own and the counts of earlier ranges (a row for each range and key) are added. ``df`` should be narrow. Ties get
    distinct ranks. The ranges are written before they are counted, so a retry sees the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(k) for k in by]
    placed = cut(df.repartitionByRange(parts, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(*[F.col(k).alias(f"__k_{k}") for k in by], F.col("__range").alias("__r"),
                          F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    on = F.col("__range") == F.col("__r")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    local = F.row_number().over(W.partitionBy(*by, "__range").orderBy(*order)) - 1
    return placed.withColumn("__i", local).join(starts, on).select(
        *df.columns, (F.col("__i") + F.col("__start")).cast("bigint").alias(name))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the connected components of ``links`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps; every step is two aggregations and two joins over the links, so no
    component is ever held in one task or on the driver. It ends when every node points at a root that points nowhere.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    last = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = cut(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        if last is not None:
            discard(last)
        if pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        last = pairs
    # now each u has one v: a second one would have been linked to the smaller by the small star
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def texts(batches: Iterator, *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few hundred in Python at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(c).to_pylist() for c in columns))
