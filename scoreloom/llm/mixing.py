"""Mixing sources to target weights by systematic sampling.

Sources (null is one of them, the last) in code-point order weigh ``weights``, repeating. They share ``total_share`` of
all words by weight; no target exceeds ``most`` times its source's words, and what a source cannot take goes to the
others by weight until no target is above. Within a source every document expects ``target / source words`` copies.
Systematic sampling walks the documents in descending size, sums up the expected copies, adds one random offset of the
source, and emits a document once for each integer boundary that its step crosses: so copies differ by less than one
from what is expected, and the words taken differ from the target by less than one document's words. The offset is a
hash of seed and source, ties are ordered by a hash of the id, and so reruns agree.

The running sum of equal steps is rank times step; the rank comes from range partitions (a hot source spreads over many
tasks). Null text has size 0; such documents are drawn like others and take no words. Repeated rows are drawn one by
one. An empty table gives an empty result. A source without any words has target 0 and takes none of its documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.llm.common import WORD, cut, ranked

#: Documents whose copies may be broadcast (about 100 bytes each); above it the join shuffles the texts once.
BROADCAST_ROWS = 250_000
WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MOST = 2


def size_in_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def offset(source: Column, seed: int) -> Column:
    """Number in [0, 1) of a source: the first 8 hex digits of a hash, over 2^32. Null has a digest of its own."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("-"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total_percent: int = TOTAL_PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size).

    Water filling: the sources are sorted by cap over weight; those before some place are full, the rest share what is
    left by weight. The place is the first where the next source's share is within its cap.
    """
    sums = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    placed = ranked(sums, [], [F.asc_nulls_last("source")], "at")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")).cast("bigint")
    placed = cut(placed.select("source", "source_size", weight.alias("weight")), "weighed")
    # sources with one cap-to-weight ratio count as a whole; there are far fewer rows than documents
    ratios = placed.groupBy((F.col("source_size") / F.col("weight")).alias("ratio")).agg(
        F.sum("source_size").alias("size"), F.sum("weight").alias("w"))
    before = W.orderBy("ratio").rowsBetween(W.unboundedPreceding, -1)
    ratios = ratios.select("ratio", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("full"),
                           F.coalesce(F.sum("w").over(before), F.lit(0)).alias("full_w"))
    whole = placed.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_w"))
    level = (F.col("all_size") * total_percent / 100 - F.col("full") * most) / (F.col("all_w") - F.col("full_w"))
    fits = ratios.crossJoin(F.broadcast(whole)).select("ratio", level.alias("level")).where(F.col("level") <= F.col("ratio") * most)
    chosen = fits.agg(F.min_by("level", "ratio").alias("level"))
    share = F.col("weight") * F.col("level")
    cap = (F.col("source_size") * most).cast("double")
    return placed.crossJoin(F.broadcast(chosen)).select(
        "source", "source_size", "weight", F.when(F.col("level").isNull() | (share > cap), cap).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, total_percent: int = TOTAL_PERCENT, most: int = MOST, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``.

    ``copies`` is how often the mix takes the document, ``taken`` the words that makes.
    """
    sized = cut(docs.select("doc_id", "source", size_in_words().alias("size")), "sizes")
    targets = cut(source_targets(sized, weights, total_percent, most), "targets")
    tie = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    order = [F.desc("size"), F.asc("tie"), F.asc("doc_id")]
    placed = ranked(sized.withColumn("tie", tie), ["source"], order, "at")
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    rows = placed.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("source"), seed)
    copies = F.floor(u + (F.col("at") + 1) * step) - F.floor(u + F.col("at") * step)
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"),
                       (copies * F.col("size")).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, total_percent: int = TOTAL_PERCENT, most: int = MOST, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (not at all, once, or up to ``most`` times)."""
    drawn = mix_sources(docs, weights, total_percent, most, seed)
    # rows that repeat doc_id, source and size are told apart by their number; they share the copies evenly
    total = drawn.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    total = cut(total.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "__copies", "__rows"), "copies")
    on = F.expr("doc_id <=> __id and source <=> __source") & (size_in_words() == F.col("__size"))
    some = total.where("__copies > 0")
    rows = docs.join(F.broadcast(some) if some.count() <= BROADCAST_ROWS else some, on)
    if not total.where("__rows > 1").isEmpty():
        several = rows.where("__rows > 1").withColumn("__n", F.row_number().over(
            W.partitionBy("__id", "__source", "__size").orderBy("text")))
        several = several.withColumn("__copies", F.floor(F.col("__copies") * F.col("__n") / F.col("__rows")) - F.floor(
            F.col("__copies") * (F.col("__n") - 1) / F.col("__rows")))
        rows = rows.where("__rows = 1").unionByName(several.drop("__n"))
    again = F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))
    return rows.where("__copies > 0").select(*docs.columns, again.alias("__copy")).select(*docs.columns)
