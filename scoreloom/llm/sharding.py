"""Shards by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split on another bit.

The key's 60-bit hash (from its MD5) is cut into prefixes. Starting from one bucket, the bytes of every prefix ``STEP``
bits deeper are counted for buckets above the limit alone, and a bucket stays whole as soon as it fits. So the counts
held at any time are a few times the number of shards, and a round reads only rows of oversized buckets. The directory
has one entry for each bucket, by depth and prefix; a document probes it once for each depth that occurs (at most 61) and
finds its shard by one equi-join.

A document above the limit gets a shard of its own outside the directory; rows that repeat its key are numbered. A key whose repeated rows exceed the limit
together has no bit that could part them: its rows are numbered and hashed with their number. Null keys count as the
text "" and so are numbered in the same way when they are many. Null text has 0 bytes. An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import cut, ranked

BITS = 60
STEP = 4
LIMIT = 1 << 20


def key_hash(key: Column) -> Column:
    """The first 15 hex digits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, bytes, docs) of the buckets of rows (h, bytes); every row is within the limit."""
    done, depth, open_rows = None, 0, rows
    while depth < BITS:
        deep = min(BITS, depth + STEP)
        fine = cut(open_rows.groupBy(prefix(F.col("h"), deep).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")), "prefixes")
        levels = F.explode(F.sequence(F.lit(depth), F.lit(deep)))
        sums = fine.select(levels.alias("depth"), "p", "bytes", "docs")
        sums = sums.groupBy("depth", F.expr(f"shiftright(p, {deep} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        over = sums.where(F.col("bytes") > limit).select(F.col("depth").alias("d"), F.col("prefix").alias("above"))
        # a bucket is final if it fits and the one it was split from did not
        fits = sums.where(F.col("bytes") <= limit)
        root = fits.where(F.col("depth") == 0)
        split = fits.where(F.col("depth") > depth).join(
            over, (F.col("depth") - 1 == F.col("d")) & (F.shiftright("prefix", 1) == F.col("above")), "left_semi")
        found = split.unionByName(root) if depth == 0 else split
        done = found if done is None else done.unionByName(found)
        left = cut(over.where(F.col("d") == deep).select("above"), "oversized")
        if deep == BITS or left.isEmpty():
            return cut(done, "directory")
        open_rows = open_rows.join(left, prefix(F.col("h"), deep) == F.col("above"), "left_semi")
        depth = deep
    return done


def assign_shards(docs: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(key, bytes, shard, depth, shard_bytes, shard_docs) for every row of ``docs``.

    ``shard`` is the bucket's prefix as bits, or a name of its own for a document above the limit (``own-`` and the key).
    """
    rows = docs.select(F.col(key), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"))
    rows = cut(rows.withColumn("h", key_hash(F.col(key))), "hashed")
    small = rows.where(F.col("bytes") <= limit)
    heavy = cut(small.groupBy("h").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("c")).where(
        (F.col("b") > limit) & (F.col("c") > 1)).select("h"), "heavy")
    if not heavy.isEmpty():
        many = ranked(small.join(heavy, "h", "left_semi").select(key, "bytes", "h"), ["h"], [F.asc("bytes")], "n")
        many = many.withColumn("h", key_hash(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col("n"))))
        small = cut(small.join(heavy, "h", "left_anti").unionByName(many.select(*small.columns)), "salted")
    buckets = directory(small.select("h", "bytes"), limit)
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())
    entries = buckets.select(F.col("depth").alias("d"), F.col("prefix").alias("p"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    probes = F.inline(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("h"), d).alias("prefix")) for d in depths]))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    none = small.limit(0).select("*", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("prefix"))
    placed = (small.select("*", probes) if depths else none).join(entries, F.expr("depth = d and prefix = p")).select(
        key, "bytes", bits.alias("shard"), "depth", "shard_bytes", "shard_docs")
    return placed.unionByName(_own_shards(rows.where(F.col("bytes") > limit), key))


def _own_shards(rows: DataFrame, key: str) -> DataFrame:
    """A shard for each row above the limit: ``own-<key>``, and ``more-<n>-<key>`` for the rows that repeat its key."""
    rows = rows.select(key, "bytes", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("h"))
    several = cut(rows.groupBy("h").count().where("count > 1").select("h"), "repeated")
    numbered = rows.withColumn("n", F.lit(0).cast("bigint"))
    if not several.isEmpty():
        again = ranked(rows.join(several, "h", "left_semi").select(*rows.columns), ["h"], [F.asc("bytes")], "n")
        numbered = numbered.join(several, "h", "left_anti").select(*again.columns).unionByName(again)
    name = F.when(F.col("n") == 0, F.concat(F.lit("own-"), "h")).otherwise(F.concat(F.lit("more-"), F.col("n").cast("string"), F.lit("-"), "h"))
    return numbered.select(key, "bytes", name.alias("shard"), F.lit(0).alias("depth"), F.col("bytes").alias("shard_bytes"), F.lit(1).cast("bigint").alias("shard_docs"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the documents as one folder for each shard, ``shard=...`` (with underscores behind it where a column has that name).

    Rows that repeat a key and a size may lie in several shards: both sides number them, and each row goes to the one shard of
    its number. The numbered rows are written before they are joined, so that a retry sees the same numbers.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    to = assigned.select(F.col(key).alias("__key"), F.col("bytes").alias("__bytes"), F.col("shard").alias("__shard"))
    spread = cut(to.groupBy("__key", "__bytes").agg(F.count_distinct("__shard").alias("__shards"), F.min("__shard").alias("__shard")), "spread")
    same = F.col(key).eqNullSafe(F.col("__key")) & (size == F.col("__bytes"))
    one = docs.join(spread.where("__shards = 1"), same).select(*docs.columns, F.col("__shard").alias("__to"))
    many = spread.where("__shards > 1").select("__key", "__bytes")
    if not many.isEmpty():
        rows = docs.join(many, same).select(*docs.columns, "__key", "__bytes")
        rows = ranked(rows, ["__key", "__bytes"], [F.xxhash64("text")], "__n")
        there = to.join(many.withColumnsRenamed({"__key": "__k", "__bytes": "__b"}), F.expr("__key <=> __k and __bytes = __b")).drop("__k", "__b")
        there = ranked(there, ["__key", "__bytes"], [F.asc("__shard")], "__n").withColumnsRenamed({"__key": "__k", "__bytes": "__b", "__n": "__m"})
        placed = rows.join(there, F.expr("__key <=> __k and __bytes = __b and __n = __m"))
        one = one.unionByName(placed.select(*docs.columns, F.col("__shard").alias("__to")))
    name = "shard"
    while name in docs.columns:
        name += "_"
    one.withColumnRenamed("__to", name).repartition(name).write.partitionBy(name).parquet(path)
