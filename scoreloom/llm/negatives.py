"""Hard negatives by exact integer scores: matrix products in a residue number system, then selection in a score window.

Components are integers (``floor(256 * x)``), so a score is an integer inner product. Products run as float32 matrix
products modulo several primes: residues are centred, columns are taken in stretches short enough that every partial sum is
below 2^24 and thus exact, and Garner's form of the Chinese remainder theorem rebuilds the signed score. The number of primes
follows from the data: their product exceeds four times the largest score that the length and the largest component allow.

Anchors come in blocks of ``BLOCK`` rows, which bounds what is sent to the tasks; each block meets all rows twice. First
every task keeps, per anchor, its best rows of the same label, and Spark ranks what the tasks kept. Then every task keeps, per
anchor and positive, its best rows of another label with ``LOW * positive <= 100 * negative <= HIGH * positive``, and Spark
ranks again. A row is never its own partner, nor is a row with the same id. Higher scores come first, ties by smaller id.

Rows with a null label or vector or a null or non-finite component take no part, nor do rows with a component of
``2^30 / sqrt(length)`` or more, whose scores would not fit a long. Shorter vectors count as filled up with zeros. Rows with a
null id are no anchors; as partners they come last. Repeated anchors are each answered, repeated partners count each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.llm.best import NO_ID, Best, spans
from scoreloom.llm.common import cut

BLOCK = 4096
#: Rows that meet a block of anchors at a time: about this many scores are held.
SCORES = 2_000_000
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95


def primes_below(limit: int) -> Iterator[int]:
    """Odd primes, largest first."""
    for n in range(limit - 1, 2, -1):
        if n % 2 and all(n % d for d in range(3, math.isqrt(n) + 1, 2)):
            yield n


@dataclass(frozen=True)
class Residues:
    """Primes whose product exceeds four times ``bound``, and the stretch of columns that float32 sums exactly."""

    primes: tuple[int, ...]
    stretch: int

    @classmethod
    def for_bound(cls, bound: int, most: int = 1022) -> Residues:
        primes, product = [], 1
        for p in primes_below(most):
            primes.append(p)
            product *= p
            if product > 4 * bound + 4:
                half = primes[0] // 2 + 1
                return cls(tuple(primes), (2**24 - 1) // (half * half))
        raise ValueError("scores beyond the range of the residues")

    def of(self, x: np.ndarray) -> list[np.ndarray]:
        """Centred residues of an integer matrix for each prime, as float32."""
        return [((x + p // 2) % p - p // 2).astype(np.float32) for p in self.primes]

    def product(self, x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        """Exact ``x @ y.T`` of the matrices behind two lists of residues, as 64-bit integers."""
        digits: list[np.ndarray] = []
        for i, p in enumerate(self.primes):
            r = _modular_product(x[i], y[i], p, self.stretch)
            weight = 1
            for d, q in zip(digits, self.primes):  # subtract what the digits so far stand for
                r = _centred(r - d * np.float32(_near(weight, p)), p)
                weight = weight * q % p
            digits.append(_centred(r * np.float32(_near(pow(weight, -1, p), p)), p) if i else r)
        out, weight = np.zeros(digits[0].shape, np.int64), 1
        for d, p in zip(digits, self.primes):
            out += d.astype(np.int64) * weight
            weight *= p
        return out


def _near(x: int, p: int) -> int:
    return (x + p // 2) % p - p // 2


def _centred(r: np.ndarray, p: int) -> np.ndarray:
    """``r`` less the nearest multiple of ``p``; exact for integers below 2^24."""
    return r - np.rint(r * np.float32(1 / p)) * np.float32(p)


def _modular_product(x: np.ndarray, y: np.ndarray, p: int, stretch: int) -> np.ndarray:
    total = np.zeros((len(x), len(y)), np.float32)
    for k in range(0, x.shape[1], stretch):
        total = _centred(total + _centred(x[:, k:k + stretch] @ y[:, k:k + stretch].T, p), p)
    return total


def _matrix(vectors: pa.Array, length: int) -> np.ndarray:
    """Integer components of a list column, one row each, filled with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy(zero_copy_only=False))
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == length).all():
        return values.reshape(len(sizes), length)
    out = np.zeros((len(sizes), length), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


@dataclass
class Anchors:
    """A block of anchors: places, ids, labels, components, and per positive its score (none in the first pass)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    residues: Residues
    owner: np.ndarray | None = None  # the anchor of each (anchor, positive) pair
    least: np.ndarray | None = None  # and the window of its scores
    most: np.ndarray | None = None


def _rows(batches: Iterator[pa.RecordBatch], length: int, size: int):
    for batch in batches:
        ids = batch.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        labels, vectors = batch.column("label").to_numpy(zero_copy_only=False), _matrix(batch.column("v"), length)
        for a, b in spans(len(ids), size):
            yield ids[a:b], labels[a:b], vectors[a:b]


def _positives(batches, block: Anchors, k: int) -> Iterator[pa.RecordBatch]:
    """Best rows of the same label for each anchor, of this task's rows."""
    best = Best(len(block.ids), k)
    res, mine = block.residues, block.residues.of(block.vectors)
    for ids, labels, vectors in _rows(batches, block.vectors.shape[1], max(64, SCORES // len(block.ids))):
        for label in np.unique(labels):
            rows, own = np.flatnonzero(labels == label), np.flatnonzero(block.labels == label)
            if not len(own):
                continue
            score = res.product(res.of(vectors[rows]), [m[own] for m in mine])
            i, j = np.nonzero((score >= best.floor[own]) & (ids[rows][:, None] != block.ids[own]))
            best.offer(own[j], score[i, j], ids[rows][i])
    yield _kept(best)


def _negatives(batches, block: Anchors, k: int) -> Iterator[pa.RecordBatch]:
    """Best rows of another label within the window of each (anchor, positive) pair, of this task's rows."""
    best = Best(len(block.owner), k)
    res, mine = block.residues, block.residues.of(block.vectors)
    place = np.arange(len(block.owner)) - np.searchsorted(block.owner, block.owner)  # pairs are sorted by anchor
    turns = [np.flatnonzero(place == t) for t in range(place.max(initial=-1) + 1)]
    for ids, labels, vectors in _rows(batches, block.vectors.shape[1], max(64, SCORES // len(block.ids))):
        score = res.product(res.of(vectors), mine)
        score[(labels[:, None] == block.labels) | (ids[:, None] == block.ids)] = np.iinfo(np.int64).min
        for pairs in turns:
            own = score[:, block.owner[pairs]]
            i, j = np.nonzero((own >= np.maximum(best.floor, block.least)[pairs]) & (own <= block.most[pairs]))
            best.offer(pairs[j], own[i, j], ids[i])
    yield _kept(best)


def _kept(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(best.owner), pa.array(best.score), pa.array(best.id)], ["owner", "score", "id"])


def _first(rows: DataFrame, step, block: Anchors, k: int) -> DataFrame:
    """(owner, score, id, place) of the first ``k`` rows of each owner over all tasks; ``place`` counts from 1."""
    sent = rows.sparkSession.sparkContext.broadcast(block)
    found = rows.mapInArrow(lambda batches: step(batches, sent.value, k), "owner bigint, score bigint, id bigint")
    order = W.partitionBy("owner").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; where the id is divisible by 7, the label moves on by one of ten."""
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    most = (F.lit(2.0**30) / F.sqrt(F.greatest(F.size("embedding"), F.lit(1)))).cast("double")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < most))
    return table.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), scaled.alias("v"))


def hard_negatives(table: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, block_rows: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    Anchors are the rows whose id is divisible by ``every``. Starts jobs: each block's positives are ranked before its
    negatives can be looked for. Results of the blocks are written to the shared folder, so no block is computed twice.
    """
    spark = table.sparkSession
    rows = integer_vectors(table)
    anchors = cut(rows.where(F.col("vec_id") % every == 0).withColumn("n", F.monotonically_increasing_id()), "anchors")
    size, (length, largest) = anchors.count(), rows.agg(
        F.max(F.size("v")), F.max(F.greatest(F.coalesce(F.array_max("v"), F.lit(0)), -F.coalesce(F.array_min("v"), F.lit(0))))).first()
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    if not size:
        return empty
    length = max(length, 1)
    residues = Residues.for_bound(length * largest * largest)
    blocks, parts = -(-size // block_rows), []
    for number in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == number).select("vec_id", "label", "v").toArrow()
        if not own.num_rows:
            continue
        own = own.combine_chunks()
        block = Anchors(own.column("vec_id").to_numpy(), own.column("label").to_numpy(),
                        _matrix(own.column("v").chunk(0), length), residues)
        found = _first(rows, _positives, block, positives).orderBy("owner", "place").toArrow()
        block.owner, score, ids = (found.column(c).to_numpy() for c in ("owner", "score", "id"))
        block.least, block.most = -(-low * score // 100), high * score // 100
        pairs = pa.table({"owner": np.arange(len(ids)), "anchor_id": block.ids[block.owner], "positive_id": ids, "positive_score": score})
        named = spark.createDataFrame(pairs)
        best = _first(rows, _negatives, block, negatives)
        none = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias
        parts.append(cut(best.join(named, "owner").select(
            "anchor_id", none("positive_id")("positive_id"), F.col("place").cast("int").alias("rank"),
            none("id")("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    return reduce(DataFrame.unionByName, parts, empty) if len(parts) > 1 else parts[0] if parts else empty
