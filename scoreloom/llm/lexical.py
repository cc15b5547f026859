"""Ranked lexical search: documents stream past an Aho-Corasick automaton of the items' terms; no document is indexed.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case. The automaton's patterns are the
items' terms with a blank at either end; a text has its separators turned into blanks, so a match is a whole term and
term frequencies come straight from the text. A pattern's output is a term number, which leads to the items that hold it.

Texts are read twice. The first pass counts documents per term and all documents and terms (map-side sums). With these the
term weights are fixed; the second pass scores each document against all items that share a term with it, and every task
keeps the first ``k`` documents per item, which Spark ranks. Scores are 64-bit integers:

    weight = floor(1000 * ln((2 * N + 2) / (2 * df + 1))),  m = 100 - 25 + (25 * n * N) div L,
    score = sum over the item's terms, repeats included, of weight * ((10^9 * tf) div (1000 * tf + 12 * m))

Items come in blocks of at most about ``BLOCK_TERMS`` terms and ``BLOCK_ITEMS`` items, which bounds what is sent to tasks and
held there; each block reads the texts twice. Every item row and every document row counts for itself, repeated ones too.
Null and empty texts have no terms: such documents count nowhere, such items have no rows. Null document ids come last
among equal scores. ``doc_id`` has to be an integer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import itemgetter
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.llm.best import NO_ID, Best, spans
from scoreloom.llm.common import cut

BLOCK_TERMS, BLOCK_ITEMS = 500_000, 50_000
#: Scores and (document, item) contributions held at a time.
SCORES = 2_000_000
_KEEP = {*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)}
_PLAIN = bytes(b if b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def plain(text: bytes | None) -> bytes:
    """UTF-8 text with blanks for separators and at both ends, A-Z in lower case."""
    return b" " + text.translate(_PLAIN) + b" " if text else b"  "


def n_terms(data: bytes) -> int:
    blank = np.frombuffer(data, np.uint8) == 32
    return int(np.count_nonzero(blank[:-1] & ~blank[1:]))


@dataclass
class Items:
    """A block of items: its terms (bytes), and per term the items that hold it and how often (compressed rows)."""

    key: str
    terms: list[bytes]
    starts: np.ndarray
    item: np.ndarray
    times: np.ndarray
    count: int
    weight: np.ndarray | None = None
    docs: int = 0
    total: int = 0

    @classmethod
    def build(cls, texts: list[bytes | None]) -> Items:
        held: dict[bytes, list[tuple[int, int]]] = {}
        for i, text in enumerate(texts):
            for term, n in Counter(plain(text).split()).items():
                held.setdefault(term, []).append((i, n))
        terms = sorted(held)
        pairs = [p for t in terms for p in held[t]]
        return cls(uuid4().hex, terms, np.cumsum([0, *(len(held[t]) for t in terms)]),
                   np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64), len(texts))

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for number, term in enumerate(self.terms):
            found.add_word(f" {term.decode('latin-1')} ", number)  # one character a byte, as in the texts
        found.make_automaton()
        return found


@lru_cache(maxsize=1)
def _automaton(key: str, sent: Broadcast) -> ahocorasick.Automaton:
    """One automaton for all tasks of a worker process that work on the same block."""
    return sent.value.automaton()


class _Sent:
    """A broadcast block that is told apart by its key."""

    def __init__(self, items: Items, sent: Broadcast):
        self.key, self.sent = items.key, sent

    def open(self) -> tuple[Items, ahocorasick.Automaton]:
        return self.sent.value, _automaton(self.key, self.sent)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.binary()):
        yield plain(text.as_py())


def _frequencies(batches: Iterator[pa.RecordBatch], sent: _Sent) -> Iterator[pa.RecordBatch]:
    """Of this task's rows: documents per term, under -1 the documents with a term, under -2 all terms."""
    items, automaton = sent.open()
    found, docs, total = np.zeros(len(items.terms), np.int64), 0, 0
    second = itemgetter(1)
    for batch in batches:
        for data in _texts(batch):
            n = n_terms(data)
            if n:
                docs, total = docs + 1, total + n
                held = set(map(second, automaton.iter(data.decode("latin-1"))))
                found[np.fromiter(held, np.int64, len(held))] += 1
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(found[at], [docs, total]))], ["term", "n"])


def _scores(batches: Iterator[pa.RecordBatch], sent: _Sent, k: int) -> Iterator[pa.RecordBatch]:
    """Of this task's rows: the first ``k`` documents per item."""
    items, automaton = sent.open()
    best = Best(items.count, k)
    second = itemgetter(1)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    pairs = 0

    def settle() -> None:
        ids = np.array([h[0] for h in held], np.int64)
        doc = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        term, part = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        for a, b in spans(len(held), max(1, SCORES // items.count)):
            lo, hi = np.searchsorted(doc, [a, b])
            low, n = items.starts[term[lo:hi]], np.diff(items.starts)[term[lo:hi]]
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            score = np.zeros((b - a) * items.count, np.int64)
            np.add.at(score, np.repeat((doc[lo:hi] - a) * items.count, n) + items.item[at], np.repeat(part[lo:hi], n) * items.times[at])
            score = score.reshape(b - a, items.count)
            i, j = np.nonzero(score >= np.maximum(best.floor, 1))
            best.offer(j, score[i, j], ids[a:b][i])
        held.clear()

    for batch in batches:
        for doc, data in zip(batch.column("doc_id").fill_null(NO_ID).to_pylist(), _texts(batch)):
            tf = Counter(map(second, automaton.iter(data.decode("latin-1"))))
            if tf:
                m = 75 + 25 * n_terms(data) * items.docs // items.total
                term, times = np.fromiter(tf.keys(), np.int64, len(tf)), np.fromiter(tf.values(), np.int64, len(tf))
                held.append((doc, term, items.weight[term] * (1_000_000_000 * times // (1000 * times + 12 * m))))
                pairs += int(np.diff(items.starts)[term].sum())
                if pairs > SCORES:
                    settle()
                    pairs = 0
    if held:
        settle()
    yield pa.RecordBatch.from_arrays([pa.array(best.owner), pa.array(best.score), pa.array(best.id)], ["item", "score", "doc_id"])


def _blocks(items: DataFrame, terms: int, rows: int) -> Iterator[tuple[list, list[bytes | None]]]:
    """(ids, texts) of the items, a bounded share at a time; a share's size is checked by counting before it is fetched."""
    numbered = cut(items.select("item_id", "text").withColumn("n", F.monotonically_increasing_id()), "items")
    share = F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / 2 + 1)  # no text has more terms
    n, size = numbered.agg(F.count(F.lit(1)), F.sum(share)).first()
    blocks = max(1, -(-n // rows), -(-(size or 0) // (8 * terms)))
    for number in range(blocks):
        own = numbered.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == number).select("item_id", "text").toArrow()
        yield own.column("item_id").to_pylist(), own.column("text").cast(pa.binary()).to_pylist()


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, by score and ascending ``doc_id``.

    Starts a job per block of items: term weights need counts over all documents.
    """
    spark = docs.sparkSession
    kind, name = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = []
    for ids, bodies in _blocks(items, block_terms, block_items):
        block = Items.build(bodies)
        if not block.terms:
            continue
        first = _Sent(block, spark.sparkContext.broadcast(block))
        counted = dict(map(tuple, texts.mapInArrow(lambda batches, s=first: _frequencies(batches, s), "term bigint, n bigint")
                           .groupBy("term").agg(F.sum("n")).collect()))  # a row per term of the block
        block.docs, block.total = counted.get(-1, 0), counted.get(-2, 0)
        block.weight = np.array([math.floor(1000 * math.log((2 * block.docs + 2) / (2 * counted.get(t, 0) + 1)))
                                 for t in range(len(block.terms))], np.int64)
        second = _Sent(block, spark.sparkContext.broadcast(block))
        found = texts.mapInArrow(lambda batches, s=second: _scores(batches, s, k), "item bigint, score bigint, doc_id bigint")
        order = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, item_id {name}")
        parts.append(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(names, "item").select(
            "item_id", F.col("rank").cast("int").alias("rank"),
            F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).cast(kind).alias("doc_id"), "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {name}, rank int, doc_id {kind}, score bigint")
    return reduce(DataFrame.unionByName, parts)
