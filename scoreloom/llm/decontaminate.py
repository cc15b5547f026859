"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

An item counts as leaked into a document that holds at least ``num/den`` of the item's distinct shingles of ``width``
words (lower case; an item or document with fewer words is one shingle). A document is far longer than an item, so the
two sets are never near in Jaccard similarity and banded signatures would miss them. The sketch is one-sided instead: of
an item with ``m`` shingles at most ``m - ceil(m * num / den)`` may be missing, so its ``k`` smallest shingle hashes,
``k`` one more than that, always hit a document that contains it. Items are partitioned by size, each size with its own
``k`` and with the least size a document must have. Candidates are verified exactly on the shingles' words.

The item side is broadcast in blocks of at most ``BLOCK_GRAMS`` shingles, whatever the number of items. Null and empty
texts have no shingles: such an item is found nowhere, such a document holds nothing. Rows that repeat an ``item_id`` are
pooled; of rows that repeat a ``doc_id`` the highest share counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.llm.common import cut

#: Item shingles in one broadcast (about 100 bytes each).
BLOCK_GRAMS = 200_000
#: Distinct flagged texts that may be broadcast (8 bytes each).
BROADCAST_ROWS = 1_000_000


def text_key(text: str = "text") -> Column:
    return F.xxhash64(text)


def _grams(df: DataFrame, ids: Sequence[str], width: int) -> DataFrame:
    """(ids, words, at, key, total): a row for each run of ``width`` words; the key is a 64-bit hash of the run."""
    words = F.array_remove(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), "")
    rows = df.select(*ids, words.alias("words")).where(F.size("words") > 0)
    rows = rows.select(*ids, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    last = F.greatest(F.size("words") - width, F.lit(0))
    rows = rows.select(*ids, "words", "hashes", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    # past the end of a short text get() is null, which xxhash64 skips
    key = F.xxhash64(*[F.get("hashes", F.col("at") + j) for j in range(width)])
    return rows.select(*ids, "words", "at", key.alias("key"), F.size("words").alias("total"))


def _run(width: int) -> Column:
    return F.array_join(F.slice("words", F.col("at") + 1, F.lit(width)), " ")


def item_sketches(items: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(item_id, key, gram, m, rank, k): the item's distinct shingles in hash order; rows with rank < k are its sketch."""
    grams = _grams(items.select("item_id", "text"), ["item_id"], width)
    grams = grams.select("item_id", "key", _run(width).alias("gram")).distinct()
    by = W.partitionBy("item_id")
    out = grams.withColumn("m", F.count(F.lit(1)).over(by)).withColumn("rank", F.row_number().over(by.orderBy("key", "gram")) - 1)
    return out.withColumn("k", F.expr(f"m - (m * {num} + {den} - 1) div {den} + 1"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, key_of_text, item_id, shared, item_shingles) of every item that a document contains."""
    sketches = cut(item_sketches(items, width, num, den), "sketches")
    blocks = max(1, -(-sketches.count() // BLOCK_GRAMS))
    docs = docs.select("doc_id", "text", text_key().alias("key_of_text"))
    found = []
    for b in range(blocks):
        block = sketches.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        probe = block.where("rank < k").select("key", "item_id", "m").distinct()
        runs = _grams(docs, ["doc_id", "key_of_text"], width)
        least = (F.col("m") * num + den - 1) / den  # shingles that a document needs at least
        hits = runs.join(F.broadcast(probe), "key").where(F.greatest(F.col("total") - width + 1, F.lit(1)) >= F.floor(least))
        hits = cut(hits.select("doc_id", "key_of_text", "item_id").distinct(), "candidates")
        texts = docs.join(_checked(hits.select("key_of_text").distinct()), "key_of_text", "left_semi")
        # exact check: the candidates' shingles against all shingles of the items, by hash and then by words
        exact = _grams(texts, ["doc_id", "key_of_text"], width).join(F.broadcast(block.select("key", "gram", "item_id", "m")), "key")
        exact = exact.where(F.col("gram") == _run(width)).select("doc_id", "key_of_text", "item_id", "m", "gram").distinct()
        shared = exact.groupBy("doc_id", "key_of_text", "item_id").agg(F.count(F.lit(1)).alias("shared"), F.first("m").alias("item_shingles"))
        shared = shared.where(F.col("shared") * den >= F.col("item_shingles") * num).alias("s")
        same = F.expr("s.doc_id <=> c.doc_id and s.key_of_text = c.key_of_text and s.item_id <=> c.item_id")
        found.append(shared.join(hits.alias("c"), same, "left_semi"))
    return reduce(DataFrame.unionByName, found)


def leaks(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment): one row for each document and item found in it."""
    found = contained_items(docs, items, width, num, den)
    return found.groupBy("doc_id", "item_id").agg(F.max("item_shingles").alias("item_shingles"), F.max("shared").alias("shared")).withColumn(
        "containment", F.col("shared") / F.col("item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` whose text contains no item; rows without text stay."""
    bad = cut(contained_items(docs, items, width, num, den).select(F.col("key_of_text").alias("__bad")).distinct(), "bad")
    return docs.join(_checked(bad), text_key() == F.col("__bad"), "left_anti")


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
